"""Token counts against the library, and what the cache saves."""

import pytest
from pyspark.sql import functions as F

from aeroframe.llm import token_counts as tc
from aeroframe.llm.common import scratch
from aeroframe.llm.queries import QUERIES, tokenizer

from tests.llm.conftest import SCHEMA

PATH = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def fresh(spark):
    return tc.CountCache(spark, scratch(spark, "test-counts"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def expected(pairs, library, limit=512):
    return sorted(((k, len((t or "").encode()), n := library(t), n > limit) for k, t in pairs), key=repr)


def test_counts_equal_the_library(spark, documents, clashing, corpus, library):
    cache = fresh(spark)
    want = expected(corpus.items(), library)
    assert rows(tc.token_counts(documents, PATH, cache)) == want
    assert rows(tc.token_counts(clashing, PATH, cache)) == want  # columns with any names change nothing
    # a limit of 0: only documents without a token are within it
    assert rows(tc.token_counts(documents, PATH, cache, limit=0)) == expected(corpus.items(), library, 0)


def test_only_distinct_misses_are_encoded(spark, documents, corpus, library, monkeypatch):
    cache, asked = fresh(spark), []
    encode = tc.encode_counts
    monkeypatch.setattr(tc, "encode_counts", lambda texts, path: asked.append([r.text for r in texts.collect()]) or encode(texts, path))
    tc.token_counts(documents, PATH, cache).count()
    assert sorted(asked[0]) == sorted({t or "" for t in corpus.values()})  # a text and its copies once
    more = documents.union(spark.createDataFrame([(900, "never seen before", "en", "s", 1), (901, "never seen before", "en", "s", 1)], SCHEMA))
    got = tc.token_counts(more, PATH, cache)
    assert asked[1:] == [["never seen before"]] and got.count() == len(corpus) + 2
    tc.token_counts(more, PATH, cache).count()
    assert len(asked) == 2  # nothing is missing: nothing is encoded


def test_many_misses_are_shuffled(spark, documents, corpus, library, monkeypatch):
    monkeypatch.setattr(tc, "FEW", 1)
    assert rows(tc.token_counts(documents, PATH, fresh(spark))) == expected(corpus.items(), library)


def test_versions_do_not_mix(spark, documents, corpus, library, monkeypatch):
    cache = fresh(spark)
    # what another version, or another job with the same misses, appended
    keys = documents.select(tc.digest().alias("digest")).distinct()
    cache.append(keys.withColumn("n_tokens", F.lit(7).cast("long")), "other")
    want = expected(corpus.items(), library)
    assert rows(tc.token_counts(documents, PATH, cache)) == want
    known = cache.counts(tc.tokenizer_version(PATH))
    cache.append(spark.createDataFrame(known.collect(), "digest binary, n_tokens long"), tc.tokenizer_version(PATH))
    assert rows(tc.token_counts(documents, PATH, cache)) == want


def test_odd_rows(spark, library):
    odd = [(1, "twice"), (1, "twice"), (1, "other"), (None, "no id"), (None, None), (2, None), (3, ""), (4, "a<|endoftext|>b <|endoftext|>"), (5, "x" * 300_000), (6, " word" * 100_000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    assert rows(tc.token_counts(docs, PATH, fresh(spark))) == expected(odd, library)
    assert tc.token_counts(docs.limit(0), PATH, fresh(spark)).count() == 0


def test_query_over_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(QUERIES["op12_token_counts"](spark, sf)) == expected(docs, library)
