"""Conversation repair against Dijkstra over whole strings, and its query against a plain rewriting of its contract."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from aeroframe.llm import conversation_repair as cr
from aeroframe.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
STEP = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute_edits(rows):
    """rows: (initial, fault). The least (cost, labels) and what each label writes, by a heap over whole strings."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, labels, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, labels, out
        for w in STEP[last]:
            if w != "s":
                heapq.heappush(heap, (cost + 5, labels + "I", i, w, (*out, (None, w))))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 2, labels + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if initial and initial in STEP[last]:
                    heapq.heappush(heap, (cost + extra, labels + "K", i + 1, initial, (*out, (i, None))))
                for w in STEP[last]:
                    if w != "s":
                        heapq.heappush(heap, (cost + 1 + extra, labels + "R", i + 1, w, (*out, (i, w))))


def brute_audit(rows):
    """rows: (turn, role, text) of one conversation after damage, in any order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
    seen, symbols, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        symbols.append((role[:1], fault))
        if fault:
            n[fault] += 1
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, labels, out = brute_edits(symbols)
    names = {"u": "user", "a": "assistant"}
    lines = [f"{names[w]}:" if i is None else f"{names[w] if w else rows[i][1]}:{rows[i][2]}" for i, w in out]
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def brute_all(rows, ids):
    groups = {k: [] for k in ids}
    for conv, *row in rows:
        groups[conv].append(tuple(row))
    return {k: brute_audit(v) for k, v in groups.items()}


def odd_rows(seed=5, conversations=150):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unit", None])
            text = rng.choice(["Fine.", "Fine.", "No end", "Yes!  \n", " \t\n", "", None, "é?", "a.b", " .\x85", "Why?\x0b"])
            t = rng.choice([turn, turn, turn, turn, turn + 3, 0, None, -2])
            rows += [(conv, t, role, text)] * rng.choice([1, 1, 1, 1, 2, 3])
    return rows


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_shortest_edits_equal_dijkstra(segment):
    rng = random.Random(segment)
    faults = [None, "blank", "duplicate", "truncated"]
    cases = [[(rng.choice(["s", "u", "a", "x"]), rng.choice([None, None, *faults])) for _ in range(rng.randrange(12))] for _ in range(700)]
    coded = [np.array([4 * "sua".find(r) + faults.index(f) if r != "x" else 12 + faults.index(f) for r, f in case], np.uint8) for case in cases]
    for case, (cost, labels, end) in zip(cases, cr.shortest_edits(coded, segment), strict=True):
        text = "".join(cr.LABELS[k] for k in labels) + end
        assert (cost, text) == brute_edits([(r if r != "x" else "", f) for r, f in case])[:2], case
        assert re.fullmatch("(s?(ua)+)?", "".join(x[1] or case[x[0]][0] for x in brute_edits([(r if r != "x" else "", f) for r, f in case])[2]))


def test_audit_equals_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ids = [*range(150), None]
    every = spark.createDataFrame([(k,) for k in ids] * 2, "conv_id long")
    assert got(cr.audit(df, every)) == brute_all(rows, ids)
    assert got(cr.audit(df)) == brute_all(rows, {r[0] for r in rows})
    clash = df.selectExpr("*", "1 as kind", "2 as known", "3 as digest", "4 as fault", "5 as late", "6 as early", "7 as place", "8 as copy", "9 as hit", "10 as `of`", "11 as in_conv")
    assert got(cr.audit(clash, every)) == brute_all(rows, ids)


def test_damage_and_audit(spark):
    rows = odd_rows(6, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(repr, map(tuple, cr.damage(df).collect()))) == sorted(map(repr, brute_damage(rows)))
    ids = {r[0] for r in rows}
    assert got(cr.audit(cr.damage(df), every=df)) == brute_all(brute_damage(rows), ids)


def test_small_batches_and_long_conversations(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Line {t}.", f"cut {t}", " "])) for t in range(3000)]
    rows += [(2, 0, "user", "x" * 2_000_000 + "."), (2, 1, "assistant", "Ok."), (3, 5, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute_all(rows, {1, 2, 3})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert got(cr.audit(df)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # many equal rows at one turn: all but the first are duplicates
    same = spark.createDataFrame([(9, 4, "user", "Again.")] * 5000 + [(9, 5, "assistant", "Done.")], SCHEMA)
    (row,) = cr.audit(same).collect()
    assert (row.duplicate, row.cost, row.audit) == (4999, 9998, "K" + "D" * 4999 + "K")


def test_repair_gives_the_rows(spark):
    rows = odd_rows(9)
    df = spark.createDataFrame(rows, SCHEMA)
    digests = {}
    for r in cr.repair(df).orderBy("conv_id", "place").collect():
        digests.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert (r.turn is None or r.edit in "KR") and r.edit in "KRI"
    for conv, result in brute_all(rows, {r[0] for r in rows}).items():
        assert hashlib.sha256("\n".join(digests.get(conv, [])).encode()).hexdigest() == result[-1]
    assert cr.repair(df.limit(0)).count() == 0 and cr.audit(df.limit(0), df.limit(0)).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = QUERIES["op11_conversation_repair"](spark, sf)
    assert result.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(result) == brute_all(brute_damage(rows), {r[0] for r in rows})
