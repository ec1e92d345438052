"""Exact top-k search by inner product over integer vectors.

Both sides are written as chunks of packed vectors. Queries are dealt to blocks and
candidates to shards of bounded size; a join of their numbers brings each block to
each shard, where they are multiplied tile by tile, every tile keeps each query's
best k, and the lists are merged like a tree: within a group, then across shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as c

#: Bytes of a block of queries and of a shard of candidates, about; bytes of the chunks they are dealt in.
BLOCK_BYTES, CHUNK_BYTES = 32 << 20, 2 << 20
#: Candidates in a tile; a tile of scores holds TILE_ROWS x TILE_QUERIES values.
TILE_ROWS = 8_192
TILE_QUERIES = 256
#: Lists that are merged at once.
FAN = 64


def vectors(batch: pa.RecordBatch, scale: int = 1024) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and floor(scale * x) of the valid vectors, grouped by dimension.

    A vector that is null, empty, or holds a null or non-finite component is left
    out, as is a row without an id. Values of magnitude 2**53 or more cannot be
    told apart as doubles after scaling and raise.
    """
    ids, column = batch.column(0), batch.column(1)
    out = []
    good = pc.fill_null(pc.and_(pc.is_valid(ids), pc.and_(pc.is_valid(column), pc.greater(pc.list_value_length(column), 0))), False)
    batch = batch.filter(good)
    ids, column = np.asarray(batch.column(0)), batch.column(1)
    length = np.asarray(pc.list_value_length(column)) if batch.num_rows else np.zeros(0, int)
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), int(d))  # nulls become NaN
        ok = np.isfinite(x).all(axis=1)
        y = np.floor(x[ok] * scale)
        if len(y) and np.abs(y).max() >= 2**53:
            raise ValueError("vector components are too large for exact scores")
        out.append((ids[rows[ok]].astype(np.int64), y.astype(np.int64)))
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through BLAS where doubles are exact, else in int64."""
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ x.T
    raise ValueError("scores do not fit 64-bit integers")


def best_of_tile(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best ``k`` of a tile: query ids, vector ids, scores. Ties go to smaller ids."""
    scores = products(q, x)
    own = qids[:, None] == ids[None, :]
    scores[own] = np.iinfo(np.int64).min  # lowest in the ascending selection below; never negated
    n = scores.shape[1]
    if n > k:
        edge = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero((scores >= edge[:, None]) & ~own)
    else:
        row, col = np.nonzero(~own)
    return _best(qids[row], ids[col], scores[row, col], k, row)


def _best(a: np.ndarray, v: np.ndarray, s: np.ndarray, k: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` rows of each group (by default: of each query id)."""
    group = a if group is None else group
    order = np.lexsort((v, -s, group))  # scores are above the least int64 here, so the negation is safe
    a, v, s, group = a[order], v[order], s[order], group[order]
    kept = np.arange(len(a)) - np.searchsorted(group, group) < k
    return a[kept], v[kept], s[kept]


def _chunks(rows: DataFrame, name: str) -> DataFrame:
    """The valid vectors as a shared table of chunks of at most CHUNK_BYTES, each with its number and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def emit(d: int) -> Iterator[pa.RecordBatch]:
            nonlocal n
            parts = held.pop(d)
            sizes.pop(d)
            ids, x = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            step = max(1, CHUNK_BYTES // (8 * d))
            for at in range(0, len(ids), step):
                i, y = ids[at : at + step], x[at : at + step]
                yield pa.record_batch({"chunk": pa.array([(part << 32) | n], pa.int64()), "dim": pa.array([d], pa.int32()), "n": pa.array([len(i)], pa.int64()), "ids": pa.array([i.tobytes()], pa.binary()), "v": pa.array([y.tobytes()], pa.binary())})
                n += 1

        for batch in batches:
            for ids, x in vectors(batch):
                d = x.shape[1]
                held.setdefault(d, []).append((ids, x))
                sizes[d] = sizes.get(d, 0) + x.nbytes
                if sizes[d] >= CHUNK_BYTES:
                    yield from emit(d)
        for d in list(held):
            yield from emit(d)

    return c.stash(rows.mapInArrow(run, "chunk long, dim int, n long, ids binary, v binary"), name)


def _load(group: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), np.int64)
    return ids, np.frombuffer(b"".join(group.column("v").to_pylist()), np.int64).reshape(-1, d)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, shards: int | None = None) -> DataFrame:
    """``queries`` and ``candidates``: (id long, vector array). Returns query_id, rank, vec_id, score.

    A query meets every candidate of its dimension but rows with its own id.
    Repeated rows count each (a query id that stands on several rows gets one list
    over all of them). Null vectors, vectors with a null or non-finite component and
    rows without an id take no part; ties go to the smaller id. An empty side gives
    an empty result; other columns are ignored, whatever their names.

    Chunks of both sides are dealt to query blocks and shards of bounded size; each
    (block, shard) pair is one group, so neither side is ever whole in one task.
    """
    candidates, queries = (d.select(d.columns[0], d.columns[1]) for d in (candidates, queries))
    parallel = c.parallelism(candidates.sparkSession)
    x, q = _chunks(candidates, "shards"), _chunks(queries, "queries")
    size = lambda df: df.agg(F.sum(F.length("v"))).first()[0] or 0
    blocks = max(1, -(-size(q) // block_bytes))
    shards = shards or max(parallel, -(-size(x) // block_bytes))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "chunk"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["dim", "block", "shard", "ids", "v"]
    left = q.withColumn("block", dealt(blocks, 1)).withColumn("shard", every(shards)).select(columns)
    right = x.withColumn("shard", dealt(shards, 2)).withColumn("block", every(blocks)).select(columns)

    def tiles(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if mine.num_rows and theirs.num_rows:
            d = key[0].as_py()
            (qids, qs), (ids, y) = _load(mine, d), _load(theirs, d)
            for g in range(0, len(qids), TILE_QUERIES):
                lists: list[tuple] = []
                for at in range(0, len(ids), TILE_ROWS):
                    lists.append(best_of_tile(qids[g : g + TILE_QUERIES], qs[g : g + TILE_QUERIES], ids[at : at + TILE_ROWS], y[at : at + TILE_ROWS], k))
                    if len(lists) >= FAN:  # merged like a tree, so lists do not pile up
                        lists = [_merged(lists, k)]
                found.append(_merged(lists, k))
        a, v, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        return pa.table({"query_id": a, "vec_id": v, "score": s, "shard": pa.array(np.full(len(a), key[2].as_py(), np.int64))})

    keys = ["dim", "block", "shard"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tiles, "query_id long, vec_id long, score long, shard long")
    by = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN:  # a level of the tree
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN))
        lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*by))).where(F.col("r") <= k).drop("r")
    best = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _merged(lists: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _best(*(np.concatenate([x[i] for x in lists]) for i in range(3)), k)
