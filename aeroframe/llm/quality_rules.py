"""Quality rules: exact document statistics, then gradient-boosted trees over them.

The trees are grown here (second-order boosting on binned features with monotonic
constraints), flattened into numpy node arrays and scored for a batch at a time.
Only a bounded, documented sample of labelled rows is gathered to fit them;
statistics and verdicts cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Labelled rows the trees are fitted on, at most. Rows are taken in order of a hash of doc_id.
FIT_ROWS = 20_000
#: Words in a window that counts as repeated when a text holds it twice.
WINDOW = 5
#: Documents whose estimated probability of being good is below this are rejected.
KEEP_AT = 0.5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(x) for x in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord("!"), ord("?")]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point

#: Feature name and the sign of its allowed effect on quality (0: free).
FEATURES = {
    "log_words": 0,
    "word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "same_as_previous": -1,
    "upper_share": -1,
    "digit_share": 0,
    "marks_per_word": -1,
    "lone_symbol_share": -1,
    "distinct_share": 0,
    "words_per_line": 0,
}


@dataclass
class Stats:
    """Exact statistics of a batch of texts and the features derived from them."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray  # float32, one row per text

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)


def _first_of_kind(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: values whose (doc, key) occurred before, and values whose (doc, key) occurs more than once."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    both = c.mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    again, twice = np.zeros(len(s), bool), np.zeros(len(s), bool)
    again[order] = same
    more = same.copy()
    more[:-1] |= same[1:]
    twice[order] = more
    return again, twice


def _lines(w: c.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those equal to an earlier one of the text."""
    n, raw = len(w.offsets) - 1, w.raw
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(raw)]
    doc = np.searchsorted(w.offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    # a line ends before its \n; the next line start is one past it unless the text ends
    ends = np.where((ends > starts) & (raw[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(starts) else ends
    words = np.searchsorted(w.start, ends, side="left") - np.searchsorted(w.start, starts, side="left")
    real = words > 0
    starts, ends, doc = starts[real], ends[real], doc[real]
    again, _ = _first_of_kind(doc, c.span_hashes(raw, starts, ends))
    return np.bincount(doc, minlength=n), np.bincount(doc[again], minlength=n), doc


def statistics(texts: pa.Array) -> Stats:
    w = c.Words(texts)
    n = len(texts)
    words = w.count.astype(np.int64)
    chars = np.zeros(len(w.raw) + 1, np.int64)
    np.cumsum(_LEAD[w.raw], out=chars[1:])
    length = chars[w.end] - chars[w.start]
    word_chars = c.per_doc(length, w.first)
    symbols = c.count_bytes(w.raw, w.offsets, _SYMBOLS)
    lines, dup_lines, _ = _lines(w)

    g, at = w.grams(WINDOW)
    _, twice = _first_of_kind(w.doc[at], g)
    cover = np.zeros(len(w.hash) + 1, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    repeat = c.per_doc(covered.astype(np.int64), w.first)

    again, _ = _first_of_kind(w.doc, w.hash)
    previous = np.zeros(len(w.hash), bool)
    previous[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    lone = (w.end - w.start == 1) & _SYMBOLS[w.raw[w.start]] if len(w.start) else np.zeros(0, bool)
    letters = c.count_bytes(w.raw, w.offsets, _UPPER | _LOWER)
    some = np.maximum(words, 1)
    part = lambda x: c.per_doc(x.astype(np.int64), w.first) / some
    features = np.stack(
        [
            np.log1p(words),
            word_chars / some,
            symbols / some,
            dup_lines / np.maximum(lines, 1),
            repeat / some,
            part(previous),
            c.count_bytes(w.raw, w.offsets, _UPPER) / np.maximum(letters, 1),
            c.count_bytes(w.raw, w.offsets, _DIGIT) / np.maximum(word_chars, 1),
            c.count_bytes(w.raw, w.offsets, _MARKS) / some,
            part(lone),
            1 - part(again),
            words / np.maximum(lines, 1),
        ],
        axis=1,
    ).astype(np.float32)
    return Stats(words, word_chars, symbols, dup_lines.astype(np.int64), repeat, features.reshape(n, len(FEATURES)))


# ---------------------------------------------------------------- boosted trees


@dataclass
class Forest:
    """Trees as flat node arrays. A leaf has feature -1 and points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaf values: all rows and all trees step down one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return self.bias + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 64, ridge: float = 1.0) -> Forest:
    """Fit boosted trees with log loss. ``signs`` constrain the direction of each feature's effect.

    A split on a constrained feature is taken only if its leaf values are ordered
    that way, and both sides are then held on their own side of the midpoint in
    all later splits, so the whole sum is monotonic.
    """
    x = np.asarray(x, np.float32)
    y = np.asarray(y, np.float64)
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) if len(x) else np.zeros(0, np.float32) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(cut, x[:, f], side="left") for f, cut in enumerate(cuts)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    score = np.full(len(y), bias)

    def leaf(v: float) -> int:
        feature.append(-1), threshold.append(0.0), left.append(len(value)), right.append(len(value)), value.append(v)
        return len(value) - 1

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        gs, hs = g[rows].sum(), h[rows].sum()
        top, found = 1e-6, None
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            gl = np.cumsum(np.bincount(codes[rows, f], g[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[rows, f], h[rows], len(cut) + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2)
            gain[(hl < 1) | (hr < 1)] = -np.inf
            if signs[f]:
                gain[(vr - vl) * signs[f] < 0] = -np.inf
            k = int(np.argmax(gain))
            own = -(gs * (v := np.clip(-gs / (hs + ridge), low, high)) + 0.5 * (hs + ridge) * v**2)
            if gain[k] - own > top:
                top, found = gain[k] - own, (f, cut[k], k, float(vl[k] + vr[k]) / 2)
        return found

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        found = best(rows, g, h, low, high) if level < depth and len(rows) > 1 else None
        if not found:
            v = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high)) * rate
            score[rows] += v
            return leaf(v)
        f, t, k, middle = found
        node = leaf(0.0)
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[f]]
        goes = codes[rows, f] <= k
        a = build(rows[goes], g, h, level + 1, *bounds[0])
        b = build(rows[~goes], g, h, level + 1, *bounds[1])
        feature[node], threshold[node], left[node], right[node] = f, float(t), a, b
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(build(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    return Forest(np.array(feature, np.int32), np.array(threshold, np.float32), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32), depth, bias)


# ---------------------------------------------------------------- Spark operators


def labelled_features(documents: DataFrame, labels: DataFrame, compute, width: int, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, on the driver.

    The sample is the labelled ids with the smallest hashes; the ids (at most
    ``rows`` longs) are broadcast, so no text is shuffled.
    """
    ids = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                x = compute(c.text_column(part, "text")).astype(np.float32)
                yield pa.record_batch({"y": part.column("quality").cast(pa.int32()), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = chosen.mapInArrow(run, "y int, x binary").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), width) if got else np.zeros((0, width), np.float32)
    return x, np.array([r.y for r in got], np.float64)


def fit_rules(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Trees fitted on at most ``rows`` labelled documents; where a document has several labels the highest counts. Without labels every score is one half."""
    x, y = labelled_features(documents, labels, lambda t: statistics(t).features, len(FEATURES), rows)
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows came in
    return grow(x[order], y[order], list(FEATURES.values()))


def quality_rules(documents: DataFrame, forest: Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """Per document: doc_id, exact statistics, base_failed, score and kept.

    A null or empty text has no words: base_failed true, kept false. Very long texts
    count whole. Lines, windows and words are told apart by 64-bit hashes. A score of
    exactly ``keep_at`` is kept. Repeated rows are scored each on their own, as are
    rows without a doc_id. An empty table gives no row; other columns are ignored,
    whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                s = statistics(c.text_column(part, "text"))
                score = forest.probability(s.features)
                failed = s.base_failed
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_words": s.n_words,
                        "word_chars": s.word_chars,
                        "n_symbols": s.n_symbols.astype(np.int64),
                        "n_dup_lines": s.n_dup_lines,
                        "n_repeat_words": s.n_repeat_words,
                        "base_failed": failed,
                        "score": score,
                        "kept": ~failed & (score >= keep_at),
                    }
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def keep_good(documents: DataFrame, forest: Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with all their columns: one pass, no shuffle.

    Null and empty texts are rejected, a score of exactly ``keep_at`` is kept,
    repeated rows are judged alike, rows without a doc_id by their text. An empty
    table gives an empty one.
    """
    kind = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                s = statistics(c.text_column(part, "text"))
                kept = ~s.base_failed & (forest.probability(s.features) >= keep_at)
                yield part.filter(pa.array(kept))

    return documents.mapInArrow(run, kind)
