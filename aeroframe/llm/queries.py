"""The thin registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversation_repair, html_extract, license_scan, ngram_join, packing, pu_classifier, quality_rules, sp_codec, substring_dedup, token_binary, token_counts, topk
from .common import scratch, table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file of this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    forest = quality_rules.fit_rules(documents, table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(documents, forest)


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark, "tokens")
    manifest = token_binary.write_token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), place)
    return token_binary.read_token_files(manifest, place)


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = pu_classifier.fit_classifier(documents, table(spark, sf_dir, "labels"))
    return pu_classifier.classify(documents, net)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op9_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.codec_digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.audit(conversation_repair.damage(conversations), every=conversations)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = token_counts.CountCache(spark, scratch(spark, "token-counts"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), cache)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_main_text": op1_html_main_text,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_topk_search": op4_topk_search,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_files": op6_token_files,
    "op7_pu_quality": op7_pu_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_bm25_packing": op9_bm25_packing,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_counts": op12_token_counts,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op4_topk_search": """
with v as (
  select cast(vec_id as bigint) as vec_id,
         list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 100 = 0
), ranked as (
  select query_id, vec_id, score,
         row_number() over (partition by query_id order by score desc, vec_id) as rank
  from pairs
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
""",
    "op13_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents where text is not null
), worded as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
  select lang, sum(len(w)) as n from worded group by lang
), phrases as (
  select lang, k as words, array_to_string(w[i : i + k - 1], ' ') as phrase
  from worded, lateral (select unnest(range(1, 5)) as k), lateral (select unnest(range(1, len(w) - k + 2)) as i)
), grams as (
  select lang, words, phrase, count(*) as f from phrases group by all having count(*) >= 30
), cuts as (
  select g.lang, g.words, g.phrase, g.f as a, k,
         array_to_string(string_split(g.phrase, ' ')[1 : k], ' ') as head,
         array_to_string(string_split(g.phrase, ' ')[k + 1 : g.words], ' ') as rest
  from grams g, lateral (select unnest(range(1, g.words)) as k) where g.words >= 2
), scored as (
  select c.*, l.f as l, r.f as r, cast((2000000 * cast(c.a as hugeint)) // (cast(l.f as hugeint) + r.f) as bigint) as score
  from cuts c join grams l on l.lang = c.lang and l.phrase = c.head join grams r on r.lang = c.lang and r.phrase = c.rest
), least as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
  select c.lang, array_to_string(string_split(c.phrase, ' ')[i : i + m - 1], ' ') as phrase, max(c.a) as longer
  from least c, lateral (select unnest(range(2, c.words)) as m), lateral (select unnest(range(1, c.words - m + 2)) as i)
  where c.words > 2 group by all
), kept as (
  select c.* from least c left join inside i on i.lang = c.lang and i.phrase = c.phrase
  where i.longer is null or 100 * cast(i.longer as hugeint) < 80 * cast(c.a as hugeint)
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select k.lang, rank, phrase, a, l, r, cast(t.n as bigint) as n, score
from ranked k join totals t on t.lang = k.lang where rank <= 2000
""",
}
