"""Similarity self-join on word shingles: MinHash LSH forest, then exact verification.

1. One pass gives each text a key (texts of the same words have equal keys) and a
   signature: PATH minima for each tree of the forest.
2. Equal texts become one class with a weight.
3. The forest: a tree is a trie of paths. The longest prefix that all trees must be
   shortened to follows from the recall at the threshold; paths that share it are a
   subtrie, dealt by its hash and sorted by the rest of the path. A walk over the
   sorted paths joins each path with the first one of its longest matched prefix,
   then shortens that prefix level by level; a subtrie stops at the level where it is
   one class. Only pairs whose signatures agree well enough are joined: a pair at the
   threshold fails that with a probability of MISS at most.
4. Candidates are dealt by connected component of such joins; a large component is
   cut into blocks, and tasks compare pairs of blocks. Exact intersections come from
   sparse incidence products, so a group of n near copies is counted without n^2 rows.
5. Links are counted per text, and classes are the components of verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: Trees of the forest, length of a whole path, and the recall a pair at the threshold must have.
TREES, PATH, RECALL = 20, 8, 0.9999
#: Probability that signatures of a pair at the threshold agree too little for the pair to be compared.
MISS = 1e-6
#: Paths of a subtrie that are walked at once, about; a larger one is cut into blocks, and pairs of blocks are walked.
BLOCK_PATHS = 4096
#: Texts and shingles of a block, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Rows of candidates (40 bytes each) that are broadcast to the texts, at most; beyond that the texts are shuffled.
BROADCAST_ROWS = 400_000


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, path: int = PATH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of the given similarity meets in some tree with the target probability."""
    for depth in range(path, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("no prefix length reaches that recall with so few trees")


def agreeing(threshold: float = THRESHOLD, minima: int = TREES * PATH, miss: float = MISS) -> int:
    """How many minima of a pair at the threshold agree at least, but for a probability of ``miss``."""
    total, k = 0.0, -1
    while total <= miss:
        k += 1
        total += math.comb(minima, k) * threshold**k * (1 - threshold) ** (minima - k)
    return k


_RNG = np.random.default_rng(5)
_MULTIPLY = (_RNG.integers(0, 1 << 32, (TREES, PATH), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, (TREES, PATH), dtype=np.uint64).astype(np.uint32)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, c.Words]:
    """Distinct shingle hashes of each text, sorted within it, n + 1 offsets into them, and text keys.

    A text of one to four words has one shingle of all its words.
    """
    w = c.Words(texts)
    g, at = w.grams(SHINGLE, short=True)
    doc = w.doc[at]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[fresh], doc[fresh]
    return g, np.searchsorted(doc, np.arange(len(texts) + 1)), text_keys(w), w


def text_keys(w: c.Words) -> np.ndarray:
    """Two 64-bit hashes of the word sequence of each text, as bytes."""
    place = c.ragged(w.count).astype(np.uint64)
    a = c.per_doc(c.mix(w.hash + place * np.uint64(0x9E3779B97F4A7C15)), w.first)
    b = c.per_doc(c.mix((w.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0xC2B2AE3D27D4EB4F) + place), w.first)
    n = w.count.astype(np.uint64)
    return np.stack([a + n, b], axis=1)


def signatures(g: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text and tree, a 64-bit hash of the first ``depth`` minima of its path; and a byte of each minimum (texts without shingles: 0)."""
    n = len(offs) - 1
    prefix, sketch = np.zeros((n, TREES), np.uint64), np.zeros((n, TREES * PATH), np.uint8)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if not len(full):
        return prefix, sketch
    starts = offs[:-1][full]
    low = (g ^ (g >> np.uint64(32))).astype(np.uint32)
    v, w = np.empty_like(low), np.empty_like(low)
    for t in range(TREES):
        path = np.full(len(full), t + 1, np.uint64)
        for d in range(PATH):
            np.bitwise_xor(low, _ADD[t, d], out=v)
            v *= _MULTIPLY[t, d]
            np.right_shift(v, np.uint32(15), out=w)
            v ^= w
            v *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(v, starts)
            sketch[full, t * PATH + d] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
            if d < depth:
                path = c.mix(path * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64))
        prefix[full, t] = path
    return prefix, sketch


def _sign(texts: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                g, offs, key, _ = shingles(c.text_column(part, "text"))
                prefix, sketch = signatures(g, offs, depth)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n": pa.array(np.diff(offs).astype(np.int64)),
                        "k1": key[:, 0].copy().view(np.int64),
                        "k2": key[:, 1].copy().view(np.int64),
                        "paths": pa.ListArray.from_arrays(pa.array(np.arange(len(prefix) + 1) * TREES, pa.int32()), pa.array(prefix.reshape(-1).view(np.int64))),
                        "sketch": pa.Array.from_buffers(pa.binary(), len(sketch), [None, pa.py_buffer((np.arange(len(sketch) + 1) * TREES * PATH).astype(np.int32)), pa.py_buffer(sketch.tobytes())]),
                    }
                )

    return c.stash(texts.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, paths array<long>, sketch binary"), "signatures")


def walk(trie: np.ndarray, rest: np.ndarray, sketch: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Joins of rows of whole subtries, as pairs of row numbers: a spanning set of all pairs that agree in ``need`` minima.

    ``trie``: the subtrie of each row; ``rest``: what its path has beyond the shared
    prefix. Rows are ordered by both. Each row is compared with the first one of the
    longest prefix it shares with the row before. Where that joins a whole subtrie,
    that is all; of others, every row outside the largest class is compared with all.
    """
    n, levels = rest.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.append(True, trie[1:] != trie[:-1])
    top = np.flatnonzero(fresh)
    parent = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    for level in range(levels):  # rows that go on sharing their prefix have a nearer first row
        fresh[1:] |= rest[1:, level] != rest[:-1, level]
        nearer = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        parent = np.where(fresh, parent, nearer)
    row = np.arange(n)
    joined = np.zeros(n, bool)
    for k in range(0, n, 1 << 14):
        joined[k : k + (1 << 14)] = (sketch[k : k + (1 << 14)] == sketch[parent[k : k + (1 << 14)]]).sum(axis=1) >= need
    a, b = [parent[joined & (parent != row)]], [row[joined & (parent != row)]]
    size = np.diff(np.append(top, n))
    for s, m in zip(top[whole := np.logical_and.reduceat(joined, top) == 0], size[whole], strict=True):
        label = np.arange(m)
        for r in range(m):
            if joined[s + r]:
                label[r] = label[parent[s + r] - s]
        done = np.zeros(m, bool)
        while True:
            kinds, count = np.unique(label, return_counts=True)
            todo = np.flatnonzero(~done & (label != kinds[count.argmax()]))
            if len(kinds) == 1 or not len(todo):
                break
            todo = todo[: max(1, (1 << 23) // (m * sketch.shape[1]))]
            near = (sketch[s + todo][:, None, :] == sketch[None, s : s + m, :]).sum(axis=2) >= need
            done[todo] = True
            for p, hits in zip(todo, near, strict=True):
                for other in np.unique(label[hits]):
                    if other != label[p]:
                        q = int(np.flatnonzero(hits & (label == other))[0])
                        a.append(np.array([s + p]))
                        b.append(np.array([s + q]))
                        label[label == other] = label[p]
    return np.concatenate(a), np.concatenate(b)


def _walk_batches(depth: int, need: int):
    """Rows come ordered by (path, bi, bj, rest); a subtrie may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, TREES * PATH)
            rest = np.frombuffer(b"".join(rows.column("rest").to_pylist()), np.uint8).reshape(len(sketch), PATH - depth)
            a, b = walk(_numbers(rows), rest, sketch, need)
            if len(a):
                ids = rows.column("rep").to_numpy()
                yield pa.record_batch({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

        for batch in batches:
            if not batch.num_rows:
                continue
            number = _numbers(batch)
            last = int(np.searchsorted(number, number[-1]))  # where the subtrie begins that may go on
            if held and (last or _key(held[-1], held[-1].num_rows - 1) != _key(batch, 0)):
                if last:
                    held.append(batch.slice(0, last))
                yield from work()
                held.append(batch.slice(last))
            elif last:
                held.append(batch.slice(0, last))
                yield from work()
                held.append(batch.slice(last))
            else:
                held.append(batch)
        if held:
            yield from work()

    return run


def _key(rows: pa.RecordBatch, k: int) -> tuple:
    return tuple(rows.column(x)[k].as_py() for x in ("path", "bi", "bj"))


def _numbers(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Consecutive numbers of the subtries of ordered rows."""
    new = np.zeros(rows.num_rows, np.int64)
    for k in ("path", "bi", "bj"):
        x = rows.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _candidates(one: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Joins (a, b) of texts that the forest finds; each pair at the threshold is connected by them, but for the stated probability."""
    paths = one.select(F.col("doc_id").alias("rep"), F.posexplode("paths").alias("tree", "path"))
    groups = paths.groupBy("path").agg(F.count("*").alias("m")).where("m > 1")
    members = paths.join(groups, "path").select("path", "tree", "rep", F.ceil(F.col("m") / BLOCK_PATHS).cast("int").alias("blocks"))
    rows = members.join(one.select(F.col("doc_id").alias("rep"), "sketch"), "rep")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = F.substring("sketch", F.col("tree") * PATH + depth + 1, F.lit(PATH - depth))
    rows = rows.select("path", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), rest.alias("rest"), "rep", "sketch")
    ordered = rows.repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj", "rest", "rep")
    return ordered.mapInArrow(_walk_batches(depth, agreeing(threshold)), "a long, b long")


class _Roots:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def of(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, a: int, b: int) -> None:
        a, b = self.of(a), self.of(b)
        self.up[max(a, b)] = min(a, b)


#: Cells of a dense incidence or product matrix, at most.
_CELLS = 1 << 22


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Exact intersection sizes of sets[left] x sets[right], as (rows of left, matrix) strips.

    Shingles that stand in one set only count nowhere; those that stand in the same
    sets are one column with a weight.
    """
    used = np.union1d(left, right)
    where = np.searchsorted(used, np.arange(int(used.max()) + 1)) if len(used) else used
    size = np.array([len(sets[i]) for i in used])
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), size)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    salt = c.mix(np.arange(1, len(used) + 1).astype(np.uint64))
    pattern = np.zeros(len(count), np.uint64)
    np.add.at(pattern, column, salt[owner])
    kinds, first, weight = np.unique(pattern[count > 1], return_index=True, return_counts=True)
    of_column = np.full(len(count), -1, np.int64)
    of_column[np.flatnonzero(count > 1)[first]] = np.arange(len(kinds))
    keep = of_column[column] >= 0
    owner, column = owner[keep], of_column[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a, b = where[left], where[right]
    to_a, to_b = np.full(len(used), -1), np.full(len(used), -1)
    to_b[b] = np.arange(len(b))
    step = max(1, min(len(a), _CELLS // max(1, len(b))))
    for k in range(0, len(a), step):
        to_a[:] = -1
        strip = a[k : k + step]
        to_a[strip] = np.arange(len(strip))
        total = np.zeros((len(strip), len(b)), np.float64)
        width = max(1, _CELLS // (len(strip) + len(b)))
        for lo in range(0, len(kinds), width):
            x, y = np.searchsorted(column, [lo, lo + width])
            o, col = owner[x:y], column[x:y] - lo
            n = min(width, len(kinds) - lo)
            wa = np.zeros((len(strip), n), np.float32)
            wb = np.zeros((len(b), n), np.float32)
            ia, ib = to_a[o] >= 0, to_b[o] >= 0
            wa[to_a[o[ia]], col[ia]] = weight[lo + col[ia]]
            wb[to_b[o[ib]], col[ib]] = 1
            total += wa @ wb.T  # whole numbers far below 2**24 per strip: exact
        yield np.arange(k, k + len(strip)), total


def compare(ids: np.ndarray, copies: np.ndarray, block: np.ndarray, sets: list[np.ndarray], bi: int, bj: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each text within a tile (weighted by copies of the partner), and links that span its classes."""
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    size = np.array([len(s) for s in sets])
    links = np.zeros(len(ids), np.int64)
    roots = _Roots(len(ids))
    for rows, both in overlaps(sets, left, right):
        a = left[rows]
        same = both >= np.ceil(threshold * (size[a][:, None] + size[right][None, :] - both) - 1e-9)
        same &= both > 0
        same &= a[:, None] != right[None, :]
        links[a] += same @ copies[right]
        if bi != bj:
            links[right] += same.T @ copies[a]
        near = np.where(same.any(axis=1), same.argmax(axis=1), -1)
        for k in np.flatnonzero(near >= 0):
            hit = right[np.flatnonzero(same[k])]
            top = {roots.of(int(x)) for x in hit}
            for x in top:
                roots.join(int(a[k]), x)
    spanning = [(int(ids[k]), int(ids[r])) for k in range(len(ids)) if (r := roots.of(k)) != k]
    return links, spanning


def ngram_join(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its class), n_links (other documents at or above the threshold).

    Equal texts are links too. A document without a word (null, empty, white space)
    has no shingle and no link: it is a class of its own. Long texts count whole.
    Rows that repeat a doc_id count once (that with the least text); rows without a doc_id are left out. An
    empty table gives no row; other columns are ignored, whatever their names.
    """
    depth = prefix_length(threshold)
    texts = c.unique_texts(documents)
    signed = _sign(texts, depth)
    real = signed.where("n > 0")
    classes = real.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = c.stash(classes, "classes")
    one = real.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    candidates = components(_candidates(one, depth, threshold))

    # active texts with their candidate component, which is cut into blocks by a hash
    active = candidates.withColumnRenamed("id", "doc_id").join(one.select("doc_id", "k1", "k2", "n"), "doc_id").join(classes.select("k1", "k2", "copies"), ["k1", "k2"]).drop("k1", "k2")
    active = c.stash(active, "active")
    parts = active.groupBy("label").agg(F.count("*").alias("texts"), F.sum("n").alias("total"))
    parts = parts.select("label", F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
    placed = active.join(parts, "label").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = c.stash(placed.select("doc_id", "label", "blocks", "block", "copies"), "placed")
    loaded = texts.join(F.broadcast(placed) if c.small_enough(placed, BROADCAST_ROWS) else placed, "doc_id")
    tiles = loaded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("label", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "doc_id", "copies", "text")

    def tile(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("doc_id").to_numpy()
        order = np.argsort(ids)
        group = group.take(pa.array(order))
        sets: list[np.ndarray] = []
        for batch in group.to_batches():
            for part in c.slices(batch):
                g, offs, _, _ = shingles(c.text_column(part, "text"))
                sets += np.split(g, offs[1:-1])
        links, spanning = compare(group.column("doc_id").to_numpy(), group.column("copies").to_numpy(), group.column("block").to_numpy(), sets, key[1].as_py(), key[2].as_py(), threshold)
        a, b = (np.array(x, np.int64) for x in (zip(*spanning, strict=True) if spanning else ((), ())))
        n = len(links)
        return pa.table({"a": np.concatenate([group.column("doc_id").to_numpy(), a]), "b": pa.array(np.concatenate([np.zeros(n, np.int64), b]), mask=np.arange(n + len(a)) < n), "links": pa.array(np.concatenate([links, np.zeros(len(a), np.int64)]))})

    verified = c.stash(tiles.groupBy("label", "bi", "bj").applyInArrow(tile, "a long, b long, links long"), "verified")
    counts = verified.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    merged = components(verified.where("b is not null").select("a", "b")).select(F.col("id").alias("rep"), F.col("label").alias("class"))
    found = classes.join(counts, "rep", "left").join(merged, "rep", "left")
    found = found.select("k1", "k2", F.coalesce("class", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = real.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "class_id", "n_links")
    alone = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def keep_one(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that stand for their class: the one with the smallest doc_id of each.

    Rows without a doc_id and documents without a word stay, as do all rows of a
    doc_id that stands for its class. Columns stay as they are; an empty table gives none.
    """
    rest = c.stash(ngram_join(documents, threshold).where("class_id <> doc_id").select("doc_id"), "duplicates")
    return documents.join(F.broadcast(rest) if c.small_enough(rest, BROADCAST_ROWS) else rest, "doc_id", "left_anti").select(*documents.columns)
