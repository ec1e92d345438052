"""Odd rows of the operators that the other files do not feed them."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe.llm import license_scan, packing, sp_codec, substring_dedup, token_binary
from aeroframe.llm.common import scratch
from aeroframe.llm.queries import tokenizer

from tests.llm.conftest import SCHEMA


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)


def test_licenses_of_odd_rows(spark):
    name, text = license_scan.TEMPLATES[0]
    long = "word " * 60_000 + text + " tail" * 1000
    rows = [(1, text), (1, text), (None, text), (2, long), (3, None), (4, ""), (5, " \n "), (6, text + " " + text)]
    got = license_scan.scan(frame(spark, rows)).where(F.col("license") == name).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (False, 6), (True, 0)]
    assert all(0 <= r.start < r.end for r in got) and next(r for r in got if r.doc_id == 2).start >= 200_000
    assert len({(r.start, r.end) for r in got if r.doc_id in (1, None)}) == 1  # repeats are reported alike
    assert license_scan.scan(frame(spark, rows).limit(0)).count() == 0
    clash = frame(spark, rows).withColumns({n: F.lit("x") for n in ("license", "template", "containment", "start", "end")})
    assert license_scan.scan(clash).count() == license_scan.scan(frame(spark, rows)).count()


ODD = [(1, "twice here"), (1, "twice here"), (1, "another text"), (None, "no id"), (None, None), (2, ""), (3, None), (4, "long " * 30_000)]


def test_token_files_of_odd_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    at = scratch(spark, "odd-tokens")
    manifest = token_binary.write_token_files(frame(spark, ODD), tokenizer("byte_bpe_50k.json"), at, partitions=3)
    got = token_binary.read_token_files(manifest.withColumn("doc_id", F.lit("clash")), at).collect()
    ids = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
    want = sorted((str(k), len(ids(x)), zlib.crc32(ids(x).tobytes())) for k, x in ODD)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()


def test_packing_of_odd_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = packing.pack(frame(spark, ODD), tokenizer("word_bpe_49k.json")).collect()
    size = lambda x: len(t.encode(x or "", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got) == sum(size(x) for _, x in ODD)
    assert max(r.doc_tokens for r in got) == size("long " * 30_000)


def test_decoding_of_odd_rows(spark):
    model = tokenizer("piece_bpe_32k.model")
    rows = [(1, [300, 400]), (1, [300, 400]), (None, [300]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("text", F.lit("clash"))
    got = sp_codec.decode_documents(df, model).collect()
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    assert [r.doc_id for r in got] == [r[0] for r in rows] and got[0].text == got[1].text and got[3].text == got[4].text == ""
    assert got[0].text.strip() == p.decode([300, 400]).strip()
    assert sp_codec.decode_documents(df.limit(0), model).count() == 0


def test_passages_cut_from_odd_rows(spark):
    shared = " ".join(f"w{k}" for k in range(70))
    own = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, shared), (2, own("a", 30) + " " + shared), (None, own("n", 9) + " " + shared), (3, None), (4, own("b", 50_000) + " " + shared + " " + own("c", 5)), (5, shared)]
    got = {r.doc_id: r.text for r in substring_dedup.remove_passages(frame(spark, rows).withColumn("_cut", F.lit(1))).collect()}
    assert got == {1: shared, 2: own("a", 30), None: rows[2][1], 3: None, 4: own("b", 50_000) + " " + own("c", 5), 5: ""} or pytest.fail(str({k: (v or "")[-80:] for k, v in got.items()}))
    assert substring_dedup.remove_passages(frame(spark, rows).limit(0)).count() == 0
