"""Substring dedup: k-mer seeds, collinear chains, alignment.

1. Texts of the same words are one class; all but the first document of a class are
   whole passages and take no further part.
2. Every text gives a content-chosen sample of its word k-mers as seeds: a k-mer is
   a seed in every copy or in none.
3. A seed held by several documents has one home: its first occurrence in the
   document with the smallest id. Every other occurrence is matched with the home
   only, so a passage in n documents gives n matches a seed, not n^2.
4. Matches of a document with one home document are merged along diagonals and
   chained: ordered in both texts, scored by covered words less a gap cost, with a
   Fenwick tree for the best predecessor. Chains of MIN_SEEDS seeds or more are aligned.
5. Alignment works on all chains of a batch at once: gaps between pieces and a
   bounded stretch beyond both ends. The longest stretches with enough words and
   identity are reported for the later document; the home keeps its copy.
6. Exact passages that the home join leaves, since their seeds have homes in several
   documents: where all seeds of a stretch are shared, every window of ``min_words``
   words is looked up by its hash, and runs of found windows are reported too. Left
   out are windows found equal along a seed's diagonal, which are reported already,
   and windows with MIN_SEEDS seeds that have their home right there: each copy is
   matched with it.
7. Changed passages that the home join leaves for the same reason: two seeds near each
   other that their homes do not hold so near are a pair, which is rarer than either.
   A pair has its home in the first document that holds it, and matches with it are
   chained and aligned as before. Only what lies outside the passages found so far
   makes pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as c
from .ngram_join import text_keys

#: Words of a k-mer, of which one in SAMPLE is a seed, and the seeds a chain must have (one of fewer than three different words will do).
K, SAMPLE, MIN_SEEDS = 5, 4, 2
#: Matches on one diagonal are one piece up to this many words apart.
MERGE = 32
#: A passage: words at least, and share of words that agree.
MIN_WORDS, IDENTITY = 50, 0.8
#: Cost of a skipped word on either side of a gap, and the words beyond an end that are searched at once.
GAP, REACH = 0.25, 48
#: An end is given up where its score has dropped by this much.
DROP = 12
#: A chain is cut where it skips more words than this on either side.
MOST_GAP = 200
#: Bytes around a chain that are looked at.
MARGIN = 1024
#: Documents or passages that are broadcast as ids or spans, at most (some 20 MB).
BROADCAST_ROWS = 400_000

_STEP = np.uint64(0xD6E8FEB86659FD93)


def plain(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which k-mers hold fewer than three different words."""
    words = np.stack([h[at + j] for j in range(K)], axis=1) if len(at) else np.zeros((0, K), np.uint64)
    other = words != words[:, :1]
    second = words[np.arange(len(at)), np.argmax(other, axis=1)]
    return ~(other & (words != second[:, None])).any(axis=1)


def sampled(w: c.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-mers that are seeds, the word each begins at, and which are plain (all of those are seeds, with odd hashes)."""
    g, at = w.grams(K)
    dull = plain(w.hash, at)
    keep = (g % np.uint64(SAMPLE) == 0) | dull
    return g[keep] << np.uint64(1) | dull[keep], at[keep], dull[keep]


def _seeds(texts: DataFrame) -> DataFrame:
    """h, doc, at (word << 32 | byte) and whether it is the first of its kind in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                w = c.Words(c.text_column(part, "text"))
                g, at, dull = sampled(w)
                doc = w.doc[at]
                order = np.lexsort((at, g, doc))
                fresh = np.ones(len(g), bool)
                fresh[1:] = (g[order][1:] != g[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                first = np.empty(len(g), bool)
                first[order] = fresh
                # a run of one or two words gives the same seed over and over: once a text is enough to find it
                keep = first | ~dull
                g, at, doc, first = g[keep], at[keep], doc[keep], first[keep]
                yield pa.record_batch(
                    {
                        "h": pa.array(g.view(np.int64)),
                        "doc": part.column("doc_id").take(pa.array(doc)),
                        "at": pa.array(((at - w.first[doc]) << 32) | (w.start[at] - w.offsets[doc])),
                        "first": pa.array(first),
                    }
                )

    return texts.mapInArrow(run, "h long, doc long, at long, first boolean")


def _keys(texts: DataFrame) -> DataFrame:
    """Per document with a word: two hashes of its words, their number, and the bytes they span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                w = c.Words(c.text_column(part, "text"))
                some = np.flatnonzero(w.count)
                key = text_keys(w)[some].view(np.int64)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(some)),
                        "k1": pa.array(key[:, 0].copy()),
                        "k2": pa.array(key[:, 1].copy()),
                        "start": pa.array(w.start[w.first[some]] - w.offsets[some]),
                        "end": pa.array(w.end[w.first[some + 1] - 1] - w.offsets[some]),
                        "n_words": pa.array(w.count[some].astype(np.int64)),
                    }
                )

    return texts.mapInArrow(run, "doc_id long, k1 long, k2 long, start long, end long, n_words long")


def candidates(w: c.Words, shared: np.ndarray, own: np.ndarray, min_words: int) -> np.ndarray:
    """First words of the windows of ``min_words`` words all of whose seeds are among ``shared``, and not MIN_SEEDS of them at words of ``own``.

    Which k-mers are seeds depends on their words alone, so a repeated passage has the same ones in every copy.
    """
    n = len(w.hash)
    if n < min_words:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[: n - min_words + 1] == w.doc[min_words - 1 :])
    inside = min_words - K + 1  # k-mers within the words
    if inside < 1 or not len(at):
        return at
    g, first, dull = sampled(w)
    bad, home, mine = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    bad[1 + first] = ~np.isin(g, shared)
    mine[own] = True
    home[1 + first] = mine[first] & ~dull
    bad, home = np.cumsum(bad), np.cumsum(home)
    # the search along a diagonal reaches MARGIN bytes, in a copy that may hold more white space
    near = w.end[at + min_words - 1] - w.start[at] <= MARGIN // 2
    return at[(bad[at + inside] == bad[at]) & ~(near & (home[at + inside] - home[at] >= MIN_SEEDS))]


def _pairs(batches: Iterator[pa.RecordBatch], reach: int, slack: int) -> Iterator[pa.RecordBatch]:
    """Pairs of seeds that do not overlap, at most ``reach`` words apart, whose homes are not one place: hash, doc and both places.

    One place: the same document, with the distance changed by ``slack`` words at
    most. Rows come ordered by (doc, at); those that later ones may still meet are carried along.
    """
    names = ("doc", "at", "h", "home", "home_at")
    kept = [np.zeros(0, np.int64)] * len(names)
    for batch in c.tidy(batches):
        fresh = len(kept[0])
        kept = [np.append(v, batch.column(k).to_numpy()) for k, v in zip(names, kept, strict=True)]
        doc, at, h, home, home_at = kept
        x, y, h = home_at >> 32, at >> 32, h.view(np.uint64)
        left, right = [], []
        for s in range(1, len(doc)):
            j = np.arange(max(s, fresh), len(doc))
            i = j - s
            near = (doc[i] == doc[j]) & (y[j] - y[i] <= reach)
            if not near.any():
                break
            i, j = i[near], j[near]
            good = (y[j] - y[i] >= K) & ((home[i] != home[j]) | (np.abs(x[j] - x[i] - y[j] + y[i]) > slack))
            left.append(i[good])
            right.append(j[good])
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            yield pa.record_batch({"h": pa.array(c.mix(h[i] * _STEP + h[j]).view(np.int64)), "doc": pa.array(doc[i]), "at": pa.array(at[i]), "at2": pa.array(at[j])})
        tail = (doc == doc[-1]) & (y >= y[-1] - reach) if len(doc) else slice(0)
        kept = [v[tail] for v in kept]


def paired(matches: DataFrame, spans: DataFrame, min_words: int, identity: float) -> DataFrame:
    """Matches (doc, home, at, home_at, weight) of seeds outside ``spans`` with the first document that holds a pair of them near each other."""
    byte = F.col("at").bitwiseAND(0xFFFFFFFF)
    within = (F.col("doc") == F.col("doc_id")) & (byte >= F.col("start")) & (byte < F.col("end"))
    small = c.small_enough(spans, BROADCAST_ROWS)
    free = matches.where("h % 2 = 0").join(F.broadcast(spans) if small else spans, within, "left_anti")
    reach, slack = min_words - K, int((1 - identity) * min_words)
    ordered = free.select("doc", "at", "h", "home", "home_at").repartition("doc").sortWithinPartitions("doc", "at")
    pairs = c.stash(ordered.mapInArrow(lambda b: _pairs(b, reach, slack), "h long, doc long, at long, at2 long"), "pairs")
    homes = pairs.groupBy("h").agg(F.min("doc").alias("home"), F.max("doc").alias("last"), F.min_by(F.struct("at", "at2"), F.struct("doc", "at", "at2")).alias("there"))
    homes = c.stash(homes.where("home < last").select("h", "home", "there"), "pair-homes")
    both = F.inline(F.array(F.struct("at", F.col("there.at").alias("home_at")), F.struct(F.col("at2").alias("at"), F.col("there.at2").alias("home_at"))))
    found = pairs.join(homes, "h").where("doc <> home").select("doc", "home", both)
    return found.repartition("doc").dropDuplicates().withColumn("weight", F.lit(1))


def _exact(texts: DataFrame, shared: DataFrame, done: DataFrame, min_words: int) -> DataFrame:
    """Runs of words every ``min_words`` of which stand in one earlier document.

    ``shared``: by doc_id, seeds that others hold and words at which one has its
    home; ``done``: by doc_id, equal runs that need no search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                w = c.Words(c.text_column(part, "text"))
                own = part.column("own")
                own = own.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.first[:-1], own.value_lengths().to_numpy(zero_copy_only=False))
                at = candidates(w, part.column("shared").flatten().to_numpy(zero_copy_only=False).view(np.uint64), own, min_words)
                spans = pc.fill_null(pc.list_value_length(part.column("done")), 0).to_numpy(zero_copy_only=False)
                if spans.any():
                    flat = part.column("done").flatten()
                    base = np.repeat(w.offsets[:-1], spans)
                    lo = np.searchsorted(w.start, flat.field("start").to_numpy() + base)
                    hi = np.searchsorted(w.end, flat.field("end").to_numpy() + base) + 1 - min_words
                    depth = np.zeros(len(w.hash) + 2, np.int64)
                    np.add.at(depth, lo, 1)
                    np.add.at(depth, hi + 1, -1)
                    at = at[np.cumsum(depth)[at] == 0]
                if not len(at):
                    continue
                h = np.zeros(len(at), np.uint64)
                for j in range(min_words):
                    h = h * _STEP + w.hash[at + j]
                doc = w.doc[at]
                base = w.offsets[doc]
                yield pa.record_batch(
                    {
                        "h": pa.array(c.mix(h).view(np.int64)),
                        "doc": part.column("doc_id").take(pa.array(doc)),
                        "word": pa.array((at - w.first[doc]).astype(np.int32)),
                        "start": pa.array((w.start[at] - base).astype(np.int32)),
                        "end": pa.array((w.end[at + min_words - 1] - base).astype(np.int32)),
                    }
                )

    windows = c.stash(texts.join(shared, "doc_id").join(done, "doc_id", "left").select("doc_id", "text", "shared", "own", "done").mapInArrow(run, "h long, doc long, word int, start int, end int"), "windows")
    homes = c.stash(windows.groupBy("h").agg(F.min("doc").alias("home"), F.max("doc").alias("last")).where("home < last").drop("last"), "window-homes")
    found = windows.join(homes, "h").where("doc <> home")
    island = F.col("word") - F.row_number().over(Window.partitionBy("doc", "home").orderBy("word"))
    runs = found.withColumn("island", island).groupBy("doc", "home", "island").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.count("*") + min_words - 1).alias("n_words"))
    return runs.select(F.col("doc").alias("doc_id"), F.col("home").alias("source_id"), "start", "end", "n_words", F.lit(1.0).alias("identity"))


class Fenwick:
    """Prefix maxima over ranks, with the item that holds each."""

    def __init__(self, n: int) -> None:
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, rank: int, value: float, item: int) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank][0]:
                self.best[rank] = (value, item)
            rank += rank & -rank

    def top(self, ranks: int) -> tuple[float, int]:
        """Best of the first ``ranks`` ranks."""
        found = (-1e18, -1)
        while ranks:
            if self.best[ranks][0] > found[0]:
                found = self.best[ranks]
            ranks &= ranks - 1
        return found


def chain(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> list[list[int]]:
    """Local collinear chains of segments [x0, x1) x [y0, y1), each as a list of segments in order.

    Score: words covered less GAP for each word skipped on either side. Every
    segment lies in one chain; chains are taken by falling score.
    """
    n = len(x0)
    if n == 1:
        return [[0]]
    weight = (y1 - y0).astype(float)
    ranks = np.argsort(x1, kind="stable")
    rank = np.empty(n, np.int64)
    rank[ranks] = np.arange(n)
    upto = np.searchsorted(x1[ranks], x0, side="right")
    score, before = [0.0] * n, [-1] * n
    tree = Fenwick(n)
    enter = np.argsort(y1, kind="stable")
    at = 0
    for i in np.lexsort((x0, y0)):
        while at < n and y1[enter[at]] <= y0[i]:
            j = int(enter[at])
            tree.put(int(rank[j]), score[j] + GAP * float(x1[j] + y1[j]), j)
            at += 1
        value, j = tree.top(int(upto[i]))
        gain = value - GAP * float(x0[i] + y0[i])
        score[i], before[i] = (weight[i] + gain, j) if j >= 0 and gain > 0 else (weight[i], -1)
    taken = [False] * n
    out = []
    for i in sorted(range(n), key=lambda k: -score[k]):
        if not taken[i]:
            path = []
            while i >= 0 and not taken[i]:
                taken[i] = True
                path.append(i)
                i = before[i]
            out.append(path[::-1])
    return out


def merge_diagonals(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last match of runs along one diagonal, for matches ordered by (diagonal, y)."""
    d = x - y
    cut = np.ones(len(x), bool)
    cut[1:] = (d[1:] != d[:-1]) | (y[1:] - y[:-1] > MERGE)
    first = np.flatnonzero(cut)
    return first, np.append(first[1:], len(x)) - 1


def _chains(doc: int, home: int, at: np.ndarray, home_at: np.ndarray, weight: np.ndarray) -> list[tuple]:
    mask = (1 << 32) - 1
    x, y, bx, by = home_at >> 32, at >> 32, home_at & mask, at & mask
    order = np.lexsort((y, x - y))
    x, y, bx, by, weight = (v[order] for v in (x, y, bx, by, weight))
    weights = np.concatenate([[0], np.cumsum(weight)])
    a, b = merge_diagonals(x, y)
    out = []
    for path in chain(x[a], x[b] + K, y[a], y[b] + K):
        p = np.array(path)
        gap = np.maximum(x[a[p[1:]]] - x[b[p[:-1]]], y[a[p[1:]]] - y[b[p[:-1]]]) - K
        for q in np.split(p, np.flatnonzero(gap > MOST_GAP) + 1):
            i, j = a[q], b[q]
            if (weights[j + 1] - weights[i]).sum() >= MIN_SEEDS:
                pieces = np.stack([bx[i], by[i], y[j] + K - y[i]], axis=1).astype("<i8")
                out.append((doc, home, int(bx[i[0]]), int(bx[j[-1]]), int(by[i[0]]), int(by[j[-1]]), pieces.tobytes()))
    return out


_CHAIN = "doc long, home long, home_from long, home_to long, doc_from long, doc_to long, pieces binary"


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (doc, home). A document's matches, which are no more than its own words, are held until it ends."""
    held: list[pa.RecordBatch] = []

    def work() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        doc, home, at, home_at, weight = (rows.column(k).to_numpy() for k in ("doc", "home", "at", "home_at", "weight"))
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (home[1:] != home[:-1])) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(doc))
        out = []
        for k in np.flatnonzero(np.add.reduceat(weight, starts) >= MIN_SEEDS):
            s, e = starts[k], ends[k]
            out += _chains(int(doc[s]), int(home[s]), at[s:e], home_at[s:e], weight[s:e])
        if out:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "home", "home_from", "home_to", "doc_from", "doc_to", "pieces"])

    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column("doc").to_numpy()
        other = np.flatnonzero(doc != doc[-1])
        last = int(other[-1]) + 1 if len(other) else 0  # where the document begins that may go on
        if last or (held and held[-1].column("doc")[0].as_py() != int(doc[0])):
            if last:
                held.append(batch.slice(0, last))
            yield from work()
        held.append(batch.slice(last))
    if held:
        yield from work()


# ---------------------------------------------------------------- alignment of a batch


class Side:
    """Words of slices of texts, without those cut by a slice's ends. ``lo`` and ``hi``: the words of each slice."""

    def __init__(self, slices: pa.Array, begin: np.ndarray, whole_end: np.ndarray) -> None:
        w = c.Words(slices.cast(pa.large_binary()))
        self.begin, self.offsets, self.start, self.end, self.hash = begin, w.offsets, w.start, w.end, w.hash
        lo, hi = w.first[:-1].copy(), w.first[1:].copy()
        if len(w.start):
            some = hi > lo
            lo += some & (begin > 0) & (w.start[np.minimum(lo, len(w.start) - 1)] == w.offsets[:-1])
            hi -= (hi > lo) & ~whole_end & (w.end[np.maximum(hi - 1, 0)] == w.offsets[1:])
        self.lo, self.hi = lo, hi

    def word(self, which: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The word that begins at a byte of the whole text, within the slice numbered ``which``."""
        return np.searchsorted(self.start, self.offsets[which] + byte - self.begin[which])

    def span(self, which: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the whole text that words ``first`` to ``last`` cover."""
        base = self.begin[which] - self.offsets[which]
        return self.start[first] + base, self.end[last] + base


def agreement(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """For many pairs of places at once: how many words agree from there on, at most ``most``, going by ``step``."""
    out = np.zeros(len(ia), np.int64)
    live = np.flatnonzero(most > 0)
    width = 8
    while len(live):
        n = np.minimum(most[live] - out[live], width)
        k = out[live][:, None] + np.minimum(np.arange(width), n[:, None] - 1)
        differ = a[ia[live][:, None] + step * k] != b[ib[live][:, None] + step * k]
        run = np.where(differ.any(axis=1), np.minimum(differ.argmax(axis=1), n), n)
        out[live] += run
        live = live[(run == n) & (out[live] < most[live])]
        width = min(2 * width, 512)
    return out


def _gather(h: np.ndarray, at: np.ndarray, n: np.ndarray, width: int, step: int, fill: int) -> np.ndarray:
    k = np.arange(width)
    inside = k < n[:, None]
    return np.where(inside, h[np.where(inside, at[:, None] + step * k, 0)], np.uint64(fill)) if len(h) else np.zeros((len(at), width), np.uint64)


def score_table(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, drop: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alignment scores of many short word lists: +1 for a word that agrees, -1 for one that does not or is left out.

    Returns the tables (row, task, column), where words agree, and the best cell of
    each task with its score. With ``drop``, a task ends where the best of a row has
    fallen by more than that, and its later rows stay unset.
    """
    tasks, rows, columns = len(x), x.shape[1], y.shape[1]
    table = np.zeros((rows + 1, tasks, columns + 1), np.int16)
    agree = np.zeros((rows, tasks, columns), bool)
    step = np.arange(columns + 1, dtype=np.int16)
    table[0] = -step
    best, row, column = np.zeros(tasks, np.int64), np.zeros(tasks, np.int64), np.zeros(tasks, np.int64)
    valid = np.arange(columns + 1) <= ny[:, None]
    live = np.arange(tasks)
    for r in range(rows):
        live = live[nx[live] > r]
        if not len(live):
            break
        hit = y[live] == x[live, r][:, None]
        agree[r, live] = hit
        before = table[r, live]
        new = before - np.int16(1)
        np.maximum(new[:, 1:], before[:, :-1] + np.where(hit, np.int16(1), np.int16(-1)), out=new[:, 1:])
        new += step
        np.maximum.accumulate(new, axis=1, out=new)  # words of y left out
        new -= step
        table[r + 1, live] = new
        if drop is not None:
            ranked = np.where(valid[live], new, np.int16(-30000))
            k = ranked.argmax(axis=1)
            top = ranked[np.arange(len(live)), k]
            up = top > best[live]
            better = live[up]
            best[better], row[better], column[better] = top[up], r + 1, k[up]
            live = live[top >= best[live] - drop]
    return table, agree, best, row, column


def trace(table: np.ndarray, agree: np.ndarray, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of words that agree on a best path from the origin to each task's cell: task, word of x, word of y."""
    task = np.flatnonzero((row > 0) & (column > 0))
    r, k = row[task], column[task]
    out: list[tuple] = []
    while len(task):
        hit = agree[r - 1, task, k - 1]
        here = table[r, task, k]
        diagonal = here == table[r - 1, task, k - 1] + np.where(hit, 1, -1)
        up = ~diagonal & (here == table[r - 1, task, k] - 1)
        found = diagonal & hit
        out.append((task[found], r[found] - 1, k[found] - 1))
        r, k = r - (diagonal | up), k - (diagonal | ~up)
        live = (r > 0) & (k > 0)
        task, r, k = task[live], r[live], k[live]
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


#: Cells of the score tables that are held at once, at most.
_CELLS = 4 << 20


def extend(a: np.ndarray, ia: np.ndarray, na: np.ndarray, b: np.ndarray, ib: np.ndarray, nb: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alignments that go on from places (``ia``, ``ib``) within the next ``na`` and ``nb`` words: pairs of words that agree.

    Agreeing words are followed exactly; from the first difference the best-scoring
    stretch is searched within REACH words at a time, as long as that gains and until
    the score has dropped by DROP below its best. Returns task and word numbers.
    """
    i, j = np.zeros(len(ia), np.int64), np.zeros(len(ia), np.int64)
    out: list[tuple] = []
    live = np.arange(len(ia))
    while len(live):
        run = agreement(a, ia[live] + step * i[live], b, ib[live] + step * j[live], np.minimum(na[live] - i[live], nb[live] - j[live]), step)
        task, k = np.repeat(live, run), c.ragged(run)
        out.append((task, ia[task] + step * (i[task] + k), ib[task] + step * (j[task] + k)))
        i[live] += run
        j[live] += run
        live = live[(i[live] < na[live]) & (j[live] < nb[live])]
        more = []
        for part in np.array_split(live, max(1, -(-len(live) * (REACH + 1) ** 2 // _CELLS))):
            nx, ny = np.minimum(na[part] - i[part], REACH), np.minimum(nb[part] - j[part], REACH)
            x = _gather(a, ia[part] + step * i[part], nx, REACH, step, 0)
            y = _gather(b, ib[part] + step * j[part], ny, REACH, step, 1)
            table, agree, best, row, column = score_table(x, y, nx, ny, DROP)
            gains = best >= 3
            row, column = np.where(gains, row, 0), np.where(gains, column, 0)
            t, u, v = trace(table, agree, row, column)
            t = part[t]
            out.append((t, ia[t] + step * (i[t] + u), ib[t] + step * (j[t] + v)))
            i[part] += row
            j[part] += column
            more.append(part[gains])
        live = np.concatenate(more) if more else live[:0]
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


def fill_gaps(a: np.ndarray, ia: np.ndarray, na: np.ndarray, b: np.ndarray, ib: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best alignments of whole gaps, by classes of size: task and pairs of words that agree."""
    out: list[tuple] = []
    longest = np.maximum(na, nb)
    todo = (na > 0) & (nb > 0)
    low = 0
    for width in (1, 2, 4, 8, 16, 32, 64, 128, 256):
        mine = np.flatnonzero(todo & (longest > low) & (longest <= width))
        low = width
        for part in np.array_split(mine, max(1, -(-len(mine) * (width + 1) ** 2 // _CELLS))):
            if len(part):
                x, y = _gather(a, ia[part], na[part], width, 1, 0), _gather(b, ib[part], nb[part], width, 1, 1)
                table, agree, *_ = score_table(x, y, na[part], nb[part], None)
                t, u, v = trace(table, agree, na[part], nb[part])
                t = part[t]
                out.append((t, ia[t] + u, ib[t] + v))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


def good_spans(i: np.ndarray, j: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, float]]:
    """The longest stretch of an alignment with that identity, and those beside it: (first pair, last pair, share).

    ``i`` and ``j``: the pairs of words that agree. Between two of them stand as many
    columns that do not as the longer side skips words.
    """
    column = np.concatenate([[0], np.cumsum(np.maximum(np.diff(i), np.diff(j)))]) if len(i) else np.zeros(0, np.int64)
    level = np.arange(len(i)) - identity * column
    out, todo = [], [(0, len(i))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < identity * min_words or i[hi - 1] - i[lo] + 1 < min_words:
            continue
        part = level[lo:hi]
        # for each last pair, the earliest first pair from which the stretch is good enough
        first = lo + np.searchsorted(-np.minimum.accumulate(part), -(part + 1 - identity + 1e-9))
        words = i[lo:hi] - i[np.minimum(first, np.arange(lo, hi))] + 1
        e = int(np.argmax(words))
        s, e = int(min(first[e], lo + e)), lo + e
        if i[e] - i[s] + 1 < min_words:
            continue
        out.append((s, e, (e - s + 1) / float(max(i[e] - i[s], j[e] - j[s]) + 1)))
        todo += [(lo, s), (e + 1, hi)]
    return sorted(out)


def align_batch(mine: Side, theirs: Side, pieces: np.ndarray, count: np.ndarray, min_words: int, identity: float) -> list[tuple[np.ndarray, ...]]:
    """Passages of the chains of a batch as (chain, first word, last word, identity, whether it is an equal run) arrays.

    ``pieces``: home byte, document byte and words of each piece, one chain after the
    other; ``count``: pieces of each chain.
    """
    a, b = mine.hash, theirs.hash
    owner = np.repeat(np.arange(len(count)), count)
    i, j = mine.word(owner, pieces[:, 1]), theirs.word(owner, pieces[:, 0])
    lo, hi, lo_b, hi_b = mine.lo[owner], mine.hi[owner], theirs.lo[owner], theirs.hi[owner]
    size = np.minimum(pieces[:, 2], np.minimum(hi - i, hi_b - j))
    good = (i >= lo) & (j >= lo_b) & (size > 0)  # all, but where a slice cuts a very long word
    owner, i, j, size, lo, hi, lo_b, hi_b = (v[good] for v in (owner, i, j, size, lo, hi, lo_b, hi_b))
    if not len(owner):
        return []
    out = []

    # equal runs along the diagonals of the pieces
    back = agreement(a, i - 1, b, j - 1, np.minimum(np.minimum(i - lo, j - lo_b), min_words), -1)
    on = agreement(a, i + size, b, j + size, np.minimum(np.minimum(hi - i, hi_b - j) - size, min_words), 1)
    length = back + size + on
    piece, k = np.repeat(np.arange(len(i)), length), c.ragged(length)
    word, other = (i - back)[piece] + k, (j - back)[piece] + k
    equal = a[word] == b[other]
    edge = np.ones(len(equal) + 1, bool)
    edge[1:-1] = (equal[1:] != equal[:-1]) | (piece[1:] != piece[:-1])
    cut = np.flatnonzero(edge)
    runs = np.flatnonzero(equal[cut[:-1]] & (np.diff(cut) >= min_words))
    if len(runs):
        found = np.unique(np.stack([owner[piece[cut[runs]]], word[cut[runs]], word[cut[runs + 1] - 1]], axis=1), axis=0)
        out.append((found[:, 0], found[:, 1], found[:, 2], np.ones(len(found)), np.ones(len(found), bool)))

    # pairs of words that agree: in the pieces, in the gaps between them, beyond the ends
    inside = equal & (k >= back[piece]) & (k < (back + size)[piece])
    pairs = [(owner[piece[inside]], word[inside], other[inside])]
    first = np.append(True, owner[1:] != owner[:-1])
    last = np.append(first[1:], True)
    p, q = np.flatnonzero(~last), np.flatnonzero(~first)
    t, u, v = fill_gaps(a, (i + size)[p], i[q] - (i + size)[p], b, (j + size)[p], j[q] - (j + size)[p])
    pairs.append((owner[p][t], u, v))
    t, u, v = extend(a, i[first] - 1, (i - lo)[first], b, j[first] - 1, (j - lo_b)[first], -1)
    pairs.append((owner[first][t], u, v))
    t, u, v = extend(a, (i + size)[last], (hi - i - size)[last], b, (j + size)[last], (hi_b - j - size)[last], 1)
    pairs.append((owner[last][t], u, v))
    t, u, v = (np.concatenate([x[n] for x in pairs]) for n in range(3))
    order = np.lexsort((u, t))
    t, u, v = t[order], u[order], v[order]
    cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(t)], strict=True):
        if spans := good_spans(u[s:e], v[s:e], min_words, identity):
            x, y, share = (np.array(z) for z in zip(*spans, strict=True))
            out.append((np.full(len(x), t[s]), u[s + x], u[s + y], share, np.zeros(len(x), bool)))
    return out


def _aligned(texts: DataFrame, matches: DataFrame, min_words: int, identity: float) -> DataFrame:
    """Passages that align along chains of ``matches`` (doc, home, at, home_at, weight), and whether each is an equal run."""
    ordered = matches.repartition("doc").sortWithinPartitions("doc", "home", "at", "home_at")
    chains = c.stash(ordered.mapInArrow(_chain_batches, _CHAIN), "chains")
    ids = chains.select("doc").union(chains.select("home")).distinct()
    ids = ids.select(F.col("doc").alias("doc_id"))
    needed = texts.join(F.broadcast(ids), "doc_id", "left_semi") if c.small_enough(ids, BROADCAST_ROWS) else texts.join(ids, "doc_id", "left_semi")
    raw = F.col("text").cast("binary")

    def cut(low: str, high: str) -> list:
        start = F.greatest(F.col(low) - MARGIN, F.lit(0))
        return [F.substring(raw, (start + 1).cast("int"), (F.col(high) + MARGIN - start).cast("int")), start, F.col(high) + MARGIN >= F.length(raw)]

    mine, begin, ends = cut("doc_from", "doc_to")
    got = chains.join(needed, chains.doc == needed.doc_id).select(*chains.columns, mine.alias("mine"), begin.alias("mine_at"), ends.alias("mine_end"))
    theirs, begin, ends = cut("home_from", "home_to")
    got = got.join(needed, got.home == needed.doc_id).select(*got.columns, theirs.alias("theirs"), begin.alias("theirs_at"), ends.alias("theirs_end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch, "mine", 2 * c.SLICE_BYTES):
                a, b = (Side(part.column(k), part.column(f"{k}_at").to_numpy(), part.column(f"{k}_end").to_numpy(zero_copy_only=False)) for k in ("mine", "theirs"))
                data, offs = c.buffers(part.column("pieces").cast(pa.large_binary()))
                for which, first, last, share, equal in align_batch(a, b, data.view("<i8").reshape(-1, 3), np.diff(offs) // 24, min_words, identity):
                    start, end = a.span(which, first, last)
                    take = pa.array(which)
                    yield pa.record_batch({"doc_id": part.column("doc").take(take), "source_id": part.column("home").take(take), "start": pa.array(start), "end": pa.array(end), "n_words": pa.array(last - first + 1), "identity": pa.array(share.astype(np.float64)), "equal": pa.array(equal)})

    return c.stash(got.mapInArrow(run, "doc_id long, source_id long, start long, end long, n_words long, identity double, equal boolean"), "found")


def passages(documents: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """Passages that an earlier document holds: doc_id, source_id, start, end (bytes of the text), n_words, identity.

    One row per stretch that aligns and per run of exact windows, but those that lie
    within another of their document; rows of one document may overlap. Every exact
    repeat of ``min_words`` words is within the rows. The document
    with the smallest id keeps its copy. Texts that are null, empty or shorter than
    ``min_words`` words have none; very long ones are treated whole. Rows that repeat a
    doc_id count once (that with the least text); rows without one are left out. Of
    equally good homes the smallest doc_id is taken, and of rows with equal start and
    end that of the smaller source_id. An empty table gives no row;
    other columns are ignored, whatever their names.
    """
    texts = c.unique_texts(documents)
    keys = c.stash(_keys(texts), "keys")
    firsts = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("source_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = c.stash(keys.join(firsts, ["k1", "k2"]).where("doc_id <> source_id").select("doc_id", "source_id", "start", "end", "n_words"), "copies")
    whole = copies.where(F.col("n_words") >= min_words).withColumn("identity", F.lit(1.0))
    again = copies.select("doc_id")
    texts = texts.join(F.broadcast(again) if c.small_enough(again, BROADCAST_ROWS) else again, "doc_id", "left_anti")

    seeds = _seeds(texts)
    homes = seeds.where("first").groupBy("h").agg(F.min("doc").alias("home"), F.min_by("at", "doc").alias("home_at"), F.count("*").alias("n")).where("n > 1").drop("n")
    homes = c.stash(homes, "homes")  # a table of its own, so that the join can split a very common seed
    matches = c.stash(seeds.join(homes, "h").select("h", "doc", "home", "at", "home_at", "first"), "matches")
    own = F.when(F.col("doc") == F.col("home"), F.shiftrightunsigned("at", 32))
    shared = matches.where("first").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("h").alias("shared"), F.collect_list(own).alias("own"), F.max(F.col("doc") != F.col("home")).alias("other"))
    shared = shared.where("other").drop("other")  # a document that is the home of all its seeds has no windows left
    direct = matches.where("doc <> home").select("doc", "home", "at", "home_at", F.when(F.col("h") % 2 != 0, MIN_SEEDS).otherwise(1).alias("weight"))
    found = _aligned(texts, direct, min_words, identity)
    done = found.where("equal").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("done"))
    found = found.drop("equal").union(c.stash(_exact(texts, shared, done, min_words), "runs"))
    second = paired(matches, found.select("doc_id", "start", "end"), min_words, identity)
    found = found.union(_aligned(texts, second, min_words, identity).drop("equal")).union(whole)
    ahead = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "source_id").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_reach", F.max("end").over(ahead)).where("_reach is null or end > _reach").drop("_reach")


def remove_passages(documents: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """``documents`` with the reported passages cut out of their texts (and n_chars brought up to date).

    Of rows that repeat a doc_id only those with the least text are cut, and rows without one are left as they are.
    All rows stay; a text that is one passage becomes empty, a null one stays null. Very long texts are cut whole, passages
    that overlap as one. White space left at a cut becomes one space, or a line break if a line ended there. An
    empty table gives no row; all columns go along, whatever their names.
    """
    mark = "_cut"
    while mark in documents.columns:
        mark += "_"
    found = passages(documents, min_words, identity).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias(mark))
    # of rows that repeat a doc_id, the cuts fit only the text they were made for
    sums = c.unique_texts(documents).join(found, "doc_id").select("doc_id", mark, F.xxhash64("text").alias(mark + "sum")) if c.repeats(documents) else found.withColumn(mark + "sum", F.lit(None).cast("long"))
    spans = c.stash(sums, "passages").withColumnRenamed("doc_id", mark + "id")
    small = c.small_enough(spans, BROADCAST_ROWS)
    same = (F.col("doc_id") == F.col(mark + "id")) & (F.col(mark + "sum").isNull() | (F.col(mark + "sum") == F.xxhash64("text")))
    joined = documents.join(F.broadcast(spans) if small else spans, same, "left").select(*documents.columns, mark)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column("text").to_pylist(), batch.column(mark).to_pylist()
            out = [cut_spans(t, [(s["start"], s["end"]) for s in k]) if k and t is not None else t for t, k in zip(texts, cuts, strict=True)]
            columns = {k: batch.column(k) for k in names}
            columns["text"] = pa.array(out, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if not k or t is None else len(t) for n, k, t in zip(columns["n_chars"].to_pylist(), cuts, out, strict=True)], pa.int64())
            yield pa.record_batch(columns)

    return joined.mapInArrow(run, documents.schema)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode("utf-8")
    parts, at = [], 0
    for start, end in sorted(spans):
        if start > at:
            parts.append(raw[at:start])
        at = max(at, end)
    parts.append(raw[at:])
    out = ""
    for part in parts:
        piece = part.decode("utf-8")
        if out and piece:
            left, right = out.rstrip(), piece.lstrip()
            gap = out[len(left) :] + piece[: len(piece) - len(right)]
            out = left + ("\n" if "\n" in gap else " ") + right if left and right else left + right
        else:
            out += piece
    return out.strip()
