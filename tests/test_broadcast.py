"""Slow consumers against a ring buffer that is played through."""

import random
from collections import deque

import pytest

from aeroframe.operators import tracks


@pytest.mark.parametrize(("capacity", "bucket"), [(3, 0.00001), (4, 1.0), (256, 0.00005)])
def test_reads_equal_a_ring(spark, capacity, bucket):
    rng = random.Random(capacity)
    times = sorted(rng.randrange(5, 200) for _ in range(120))
    messages = [(k, t) for k, t in enumerate(times)]
    polls = [(c, t) for c in range(4) for t in sorted(rng.sample(range(220), 25))]
    want = set()
    for c in range(4):
        ring, at, joined = deque(maxlen=capacity), 0, False
        for _, t in [p for p in polls if p[0] == c]:
            while at < len(messages) and messages[at][1] <= t:
                ring.append(messages[at][0])
                at += 1
            if not joined:
                got, skipped, joined, last = [], 0, True, at
            else:
                got = [x for x in ring if x >= last]
                skipped, last = at - last - len(got), at
            want.add((c, t, at - 1, skipped, len(got), got[0] if got else None))
    rows = tracks.broadcast_reads(spark.createDataFrame(messages, "seq long, at_us long").repartition(3), spark.createDataFrame(polls, "consumer long, at_us long"), capacity, bucket_s=bucket)
    assert {tuple(r) for r in rows.collect()} == want and rows.count() == len(polls)
    empty = tracks.broadcast_reads(spark.createDataFrame([], "seq long, at_us long"), spark.createDataFrame(polls, "consumer long, at_us long"), capacity)
    assert {(r.newest, r.skipped, r.received) for r in empty.collect()} == {(-1, 0, 0)}
