"""Collocations against a plain count of every phrase, and against SQL."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from aeroframe.llm import collocations as co
from aeroframe.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def brute_counts(rows):
    """(lang, words) to a count, and words of each lang."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    return f, n


def brute(rows, threshold=30, percent=80, most=2000):
    f, n = brute_counts(rows)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    out = []
    for (lang, w), a in cand.items():
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        longer = [b for (other, v), b in cand.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= percent * a for b in longer):
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], k, *x[1:]) for k, x in enumerate(own[:most], 1)]
    return sorted(ranked)


def corpus(seed=2, n=400):
    rng = random.Random(seed)
    common = ["the", "Of", "new", "york", "CITY", "é", "Ünder", "a", "b"]
    fixed = ["New York City hall", "as soon as possible", "ha ha ha ha ha", "in  spite\tof", "ÄB äb"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choice(common) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(12))]
        rows.append(("".join(p + rng.choice([". ", ", ", "\n", " ", "\r\n", "\x0b", "; ", "?"]) for p in parts), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", "en"), ("...", "fr"), (" \t ", None), ("x", "fr"), ("\x85\xa0 z", "fr")]


def result(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def test_collocations_equal_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert len(want) > 40
    df = frame(spark, rows)
    assert result(co.collocations(df.repartition(5))) == want
    assert result(co.collocations(df.repartition(1), threshold=7, percent=30, most=20)) == brute(rows, 7, 30, 20)
    clash = df.selectExpr("*", "1 as f", "2 as words", "3 as phrase", "4 as unit", "5 as n", "6 as score", "7 as rank", "8 as row")
    assert result(co.collocations(clash)) == want
    # repeated rows count each
    assert result(co.collocations(df.union(df))) == brute(rows + rows)
    assert result(co.collocations(df.limit(0))) == []


def test_units_and_crowded_sketches_lose_nothing(spark, monkeypatch):
    """However small the units, and however many phrases share a cell, the counts are the same."""
    rows = corpus(4, 150)
    want = {(k[0], " ".join(k[1])): a for k, a in brute_counts(rows)[0].items() if a >= 30}
    for unit, bits, low in ((1, 16, 16), (2000, 3, 2), (1 << 24, 6, 4), (5000, 20, 17)):
        monkeypatch.setattr(co, "UNIT_BYTES", unit)

        class Small(co.Layout):
            def __init__(self, occurrences, bits=bits, low=low):
                self.bits, self.low = bits, low

        monkeypatch.setattr(co, "Layout", Small)
        got = co.frequent_phrases(frame(spark, rows).repartition(3)).where("words > 0").collect()
        assert {(r.lang, r.phrase): r.f for r in got} == want


def test_survivors_are_few(spark, monkeypatch):
    """The sketch does its work: hardly a rare phrase reaches the exact count."""
    rng = random.Random(1)
    rows = [(" ".join(f"w{rng.randrange(100_000)}" for _ in range(500)) + " over and over again", "en") for _ in range(60)]
    seen = []
    survivors = co._survivors
    monkeypatch.setattr(co, "_survivors", lambda *a: seen.append(survivors(*a).persist()) or seen[-1])
    co.frequent_phrases(frame(spark, rows).repartition(2)).count()
    phrases = {r.phrase for r in seen[0].where("words > 0").collect()}
    assert len(phrases) < 400 and "over and over again" in phrases  # of some 120 000 different ones


def test_long_texts_are_cut_between_pieces():
    rng = random.Random(3)
    text = " ".join(rng.choice(["a", "bb", "c.", "é,", "dd\n"]) for _ in range(3000))
    one = "no break at all " * 300
    for sample in (text, one, text + one, one + ". " + one):
        parts = list(co.pieces(pa.array([sample], pa.large_string()), pa.array(["en"]), 100))
        assert "".join(p[0][0].as_py() for p in parts) == sample
        got, want = Counter(), brute_counts([(sample, "en")])[0]
        for texts, langs in parts:
            p = co.Phrases(texts, co.lang_hashes(langs))
            for k in range(1, 5):
                _, at = p.hashes(k)
                got.update(p.strings(np.full(len(at), k), at).to_pylist())
        assert got == {" ".join(k[1]): a for k, a in want.items()}


def test_exact_beyond_64_bits(spark):
    big = 6_000_000_000_000_000
    grams = spark.createDataFrame([("en", 1, "a", big + 3), ("en", 1, "b", big + 1), ("en", 2, "a b", big), ("en", 3, "a b a", big - 1)], "lang string, words int, phrase string, f long")
    got = {r.phrase: r for r in co.score_phrases(grams).collect()}
    assert got["a b"].score == 2_000_000 * big // (2 * big + 4)
    assert {r.phrase for r in co.subsume(co.score_phrases(grams)).collect()} == {"a b a"} or "a b a" not in got


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_against_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = QUERIES["op13_collocations"](spark, sf)
    want = c.execute(ORACLE_SQL["op13_collocations"])
    assert got.columns == [d[0] for d in want.description]
    assert result(got) == sorted(want.fetchall())


def test_query_against_brute_force(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(QUERIES["op13_collocations"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("low", [16, 17, 19, 4, 2])
def test_partial_sketches_are_packed_in_few_bits(low):
    rng = np.random.default_rng(low)
    for n, most in ((1, 30), (3, 30), (1 << low - 1, 30), (1 << low, 30), ((1 << low) // 7 + 1, 3000), (min(100, 1 << low), 1)):
        cells = np.sort(rng.choice(1 << low, min(n, 1 << low), replace=False)).astype(np.uint64)
        counts = np.where(rng.random(len(cells)) < 0.9, 1, rng.integers(1, most + 1, len(cells)))
        data = co.pack(cells + np.uint64(5 << low), counts, low)
        got, own = co.unpack(data, len(cells), low)
        assert got.tolist() == cells.tolist() and own.tolist() == counts.tolist()
        share = 1 << low
        assert len(data) <= 8 + len(cells) * (max(0, np.log2(share / len(cells))) + 4 + 0.1 * (8 if most < 256 else 16) * 1.5) / 8 + (2 * (counts > 1).sum())


def test_partial_sketches_are_written_once(spark, monkeypatch):
    """Only the names of units are kept as a table; partial sketches go to the shuffle and nowhere else."""
    kept = []
    stash = co.c.stash
    monkeypatch.setattr(co.c, "stash", lambda df, name: kept.append((name, df.columns)) or stash(df, name))
    co.frequent_phrases(frame(spark, corpus()).repartition(3)).count()
    assert [name for name, columns in kept if "cells" in columns] == [] and ("unit-names", ["unit"]) in kept
