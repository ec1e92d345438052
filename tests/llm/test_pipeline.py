"""The pipeline's stages on the fixture corpus and the registered queries at the smallest scale."""

import pytest

import corpus_pipeline
from aeroframe.llm.queries import ORACLE_SQL, QUERIES

from tests.llm.test_operators import brute_links

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, corpus, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "sf/labels.parquet"))
    docs, seen = documents, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path / "sf")).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
    junk, plain = set(range(120, 140)), set(range(60))
    assert not seen[0] & junk and plain <= seen[0]
    assert len(plain & seen[1]) >= 0.98 * len(plain)  # clean documents stay
    # one document of each class stays, by brute force over what the stage was given
    classes = {k: c for k, (c, _) in brute_links({k: t for k, t in corpus.items() if k in seen[1]}).items()}
    assert seen[2] == {k for k, c in classes.items() if k == c} and plain & seen[1] <= seen[2] and not seen[2] & set(range(60, 75))
    assert seen[3] == seen[2] == seen[4]


def _run(documents, labels, folder):
    labels.write.parquet(f"{folder}/labels.parquet")
    documents.write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(documents.sparkSession, str(folder))


def test_run_on_odd_tables(spark, documents, clashing, corpus, labels, tmp_path):
    assert _run(documents.limit(0), labels, tmp_path / "empty").count() == 0
    assert _run(documents, labels.limit(0), tmp_path / "unlabelled").count() > 0
    plain = _run(documents, labels, tmp_path / "plain")
    # columns named as the operators name theirs change nothing
    clash = _run(clashing, labels, tmp_path / "clash")
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, clash.select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(tuple, plain.select("doc_id", "doc_tokens").distinct().collect()))
    # repeated doc_ids stay whole
    twice = _run(documents.union(documents), labels, tmp_path / "twice").select(*key)
    assert {r.doc_id for r in twice.collect()} >= set(range(20))


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_top_k_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    (name,) = ORACLE_SQL
    expected = sorted(c.execute(ORACLE_SQL[name]).fetchall())
    assert sorted(map(tuple, QUERIES[name](spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == expected
