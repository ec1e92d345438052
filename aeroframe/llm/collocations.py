"""Phrase collocations: count-min sketches, an exact second pass over survivors, scores, subsumption.

1. Each task reads its texts a unit (some 4 MB) at a time and keeps the unit's pieces in a file of the
   shared folder; only the names of the files are kept as rows. From the files, which are the same whenever
   a task runs again, come the units' partial sketches: for each of DEPTH rows the sorted cells that
   its 1- to 4-word phrases touch, with counts that end at the threshold. Rows of the sketch are as
   wide as the corpus needs, since no task ever holds one, and partial sketches go straight to the shuffle.
2. Partial sketches are merged a range of cells at a time. The owner of a range answers each unit with
   one bit a cell: whether its merged count reaches the threshold. Nothing is broadcast.
3. Each unit is read again with its answers. A phrase survives if all its cells do; the merged
   sketch never underestimates, so no frequent phrase is lost. Survivors are counted exactly, as
   strings, in Spark; those that turn out rare are dropped.

All that scores need (parts of a frequent phrase are as frequent) is in that one table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as c

#: Words of the longest phrase.
LONGEST = 4
#: Rows of the sketch.
DEPTH = 2
#: Phrase occurrences for each cell of a row, at most: what makes rare phrases pass is chance above this mean.
LOAD = 16
#: Bytes of text in a unit: a worker holds some 25 bytes of hashes and places for each.
UNIT_BYTES = 4 << 20
#: Bytes of text that one task of the exact count takes, about: the more, the fewer rows a phrase is shuffled as.
TASK_BYTES = 128 << 20
#: Ranges of cells that a row is merged in, once they have as many cells as a 16-bit place can tell apart.
RANGES = 1 << 14

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_SALT = np.random.default_rng(13).integers(1, 1 << 63, LONGEST + DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- phrases of a slice of texts


class Phrases:
    """Phrases of 1 to LONGEST words inside pieces of a list of texts, of one language each.

    ``norm`` has the lower-cased words with one space between; ``start``/``end`` are their places in it.
    """

    def __init__(self, texts: pa.Array, lang: np.ndarray) -> None:
        """``lang``: a 64-bit hash of each text's language."""
        raw, offsets = c.buffers(texts)
        raw = _LOWER[raw]
        n = len(raw)
        black = ~_GAP[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = ~black[:-1] | edge[1:n]
        after[:-1] = ~black[1:] | edge[1:n]
        start, end = np.flatnonzero(black & before), np.flatnonzero(black & after) + 1
        first = np.searchsorted(start, offsets, side="left")
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
        breaks = np.cumsum(_BREAK[raw], dtype=np.int32)
        piece = breaks[start] if n else np.zeros(0, np.int32)
        self.linked = (self.doc[1:] == self.doc[:-1]) & (piece[1:] == piece[:-1])  # a word and the next are in one piece
        keep = black.copy()
        gap = end[end < n]
        keep[gap[~black[gap]]] = True
        raw[~black] = 0x20
        self.norm = raw[keep]
        place = np.concatenate([[0], np.cumsum(keep)])
        self.start, self.end = place[start], place[end]
        del place, before, after, black, keep, breaks
        self.word = c.span_hashes(raw, start, end) if n else np.zeros(0, np.uint64)
        self.lang = lang

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of k-word phrases with their language, and the word each begins at."""
        n = len(self.word)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32)
        ok = np.ones(n - k + 1, bool)
        for j in range(k - 1):
            ok &= self.linked[j : n - k + 1 + j]
        at = np.flatnonzero(ok)
        h = self.lang[self.doc[at]] + _SALT[k - 1]
        for j in range(k):
            h *= c._STEP
            h += self.word[j : n - k + 1 + j][ok]
        return c.mix(h), at.astype(np.int32)

    def strings(self, k: np.ndarray, at: np.ndarray) -> pa.Array:
        """Phrases of k words that begin at words ``at``, one space between words."""
        a, b = self.start[at], self.end[at + k - 1]
        offsets = np.concatenate([[0], np.cumsum(b - a)])
        flat = self.norm[np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat))


def lang_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    names = [x.encode() for x in coded.dictionary.to_pylist()]
    raw = np.frombuffer(b"".join(names), np.uint8)
    ends = np.cumsum([len(x) for x in names], dtype=np.int64)
    table = c.span_hashes(raw, ends - [len(x) for x in names], ends) if names else np.zeros(0, np.uint64)
    return table[np.asarray(coded.indices)] if len(langs) else np.zeros(0, np.uint64)


def pieces(texts: pa.Array, langs: pa.Array, most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts in slices of about ``most`` bytes. A longer text is cut where a piece ends, which parts no phrase."""
    batch = pa.record_batch({"text": texts, "lang": langs})
    for part in c.slices(batch, most=most):
        rows, names = c.text_column(part, "text"), part.column("lang")
        if len(rows) == 1 and (size := pc.binary_length(rows)[0].as_py()) > 2 * most:
            raw, at = c.buffers(rows)[0], 0
            while at < size:
                stop = min(at + most, size)
                if stop < size and len(ends := np.flatnonzero(_BREAK[raw[at:stop]])):
                    stop = at + int(ends[-1]) + 1
                elif stop < size:  # a piece of this size: on to its end
                    ends = np.flatnonzero(_BREAK[raw[stop:]])
                    stop = stop + int(ends[0]) + 1 if len(ends) else size
                yield pa.array([raw[at:stop].tobytes().decode()], pa.large_string()), names
                at = stop
        else:
            yield rows, names


# ---------------------------------------------------------------- the sketch


class Layout:
    """Width of the sketch's rows for a corpus, and the ranges in which they are merged."""

    def __init__(self, occurrences: float) -> None:
        self.bits = max(16, int(np.ceil(np.log2(max(occurrences, 1) / LOAD))))
        self.low = max(16, self.bits - int(np.log2(RANGES)))  # a range is 2^low cells

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        if row:
            h = c.mix(h ^ _SALT[LONGEST + row])
        return h >> np.uint64(64 - self.bits)

    def ranges(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the ranges that sorted cells lie in, and n + 1 offsets."""
        number = (cells >> np.uint64(self.low)).astype(np.int64)
        at = np.flatnonzero(np.diff(number, prepend=-1))
        return number[at], np.append(at, len(cells))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of equal values in a sorted array, and how many there are."""
    if not len(x):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    at = np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)).astype(np.int32)
    return at[:-1], np.diff(at)


def pack(cells: np.ndarray, counts: np.ndarray, low: int) -> bytes:
    """Sorted cells of one range and their counts, in few bits each.

    A byte says how many low bits b the cells have written out; their high bits are one bit string, in which
    cell i sets bit (cell >> b) + i, so a cell takes b + 2 bits or so whatever the width of the sketch (Elias and Fano).
    Counts are mostly one: a bit for each tells which are not, and those follow.
    """
    n = len(cells)
    inside = (cells & np.uint64((1 << low) - 1)).astype(np.uint32)
    b = max(0, low - (n - 1).bit_length()) if n else 0
    high = np.zeros((1 << low - b) + n, bool)
    high[(inside >> np.uint32(b)).astype(np.int64) + np.arange(n)] = True
    rest = (inside[:, None] >> np.arange(b, dtype=np.uint32)).astype(np.uint8) & np.uint8(1)
    many = counts > 1
    return bytes([b]) + b"".join(np.packbits(x).tobytes() for x in (rest, high, many)) + counts[many].astype("<u2" if (counts > 255).any() else np.uint8).tobytes()


def unpack(data: bytes, n: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    b, at = data[0], 1
    raw = np.frombuffer(data, np.uint8)

    def bits(k: int) -> np.ndarray:
        nonlocal at
        at += (k + 7) // 8
        return np.unpackbits(raw[at - (k + 7) // 8 : at], count=k)

    rest = bits(n * b).reshape(n, b)
    cells = np.flatnonzero(bits((1 << low - b) + n)) - np.arange(n)
    cells <<= b
    for k in range(b):
        cells |= rest[:, k].astype(np.int64) << k
    counts, many = np.ones(n, np.uint16), bits(n).astype(bool)
    some = int(many.sum())
    counts[many] = np.frombuffer(data, "<u2" if len(data) - at == 2 * some else np.uint8, some, at) if some else 0
    return cells, counts


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.Array, pa.Array]]]:
    held, size = [], 0
    for batch in batches:
        for texts, langs in pieces(c.text_column(batch, "text"), c.text_column(batch, "lang"), 2 * c.SLICE_BYTES):
            held.append((texts, langs))
            size += pc.sum(pc.binary_length(texts)).as_py() or 0
            if size >= UNIT_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _unit_hashes(unit: list[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[int, Phrases, int, np.ndarray, np.ndarray]]:
    """(slice, its phrases, words, hashes, places) for each slice and length."""
    for k, (texts, langs) in enumerate(unit):
        p = Phrases(texts, lang_hashes(langs))
        for words in range(1, LONGEST + 1):
            yield k, p, words, *p.hashes(words)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _keep_units(rows: DataFrame, folder: str) -> DataFrame:
    """Names of the units that texts are kept as, in files of ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        schema = pa.schema([("text", pa.large_string()), ("lang", pa.large_string())])
        for unit in _units(c.tidy(batches)):
            name = uuid.uuid4().hex  # a task that runs again has units of its own; only those of rows that stay count
            with filesystem.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for texts, langs in unit:
                    stream.write_batch(pa.record_batch([texts, langs.cast(pa.large_string())], schema))
            yield pa.record_batch({"unit": pa.array([name])})

    return rows.mapInArrow(run, "unit string")


def _read_unit(folder: str, name: str) -> list[tuple[pa.Array, pa.Array]]:
    filesystem, base = _filesystem(folder)
    with filesystem.open_input_stream(f"{base}/{name}") as f:
        return [(b.column(0), b.column(1)) for b in pa.ipc.open_stream(f)]


def _sketch_units(units: DataFrame, layout: Layout, folder: str, threshold: int) -> DataFrame:
    """Partial sketches of kept units: (unit, row, part, n, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (n for batch in c.tidy(batches) for n in batch.column("unit").to_pylist()):
            h = np.concatenate([part[3] for part in _unit_hashes(_read_unit(folder, name))])
            h.sort()
            at, counts = _runs(h)
            h, counts = h[at], np.minimum(counts, threshold)
            for row in range(DEPTH):
                cells = layout.cells(h, row)
                order = np.argsort(cells) if row else slice(None)
                cells, own = cells[order], counts[order]
                at, _ = _runs(cells)
                own = np.minimum(np.add.reduceat(own, at), threshold) if len(at) else own
                cells = cells[at]
                number, offs = layout.ranges(cells)
                yield pa.record_batch({
                    "unit": pa.array([name] * len(number)),
                    "row": pa.array([row] * len(number), pa.int32()),
                    "part": pa.array(number, pa.int64()),
                    "n": pa.array(np.diff(offs), pa.int64()),
                    "cells": pa.array([pack(cells[a:b], own[a:b], layout.low) for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary()),
                })

    return units.mapInArrow(run, "unit string, row int, part long, n long, cells binary")


def _answers(partials: DataFrame, layout: Layout, threshold: int) -> DataFrame:
    """Merge partial sketches a range at a time; (unit, row, part, n, bits): which of a unit's cells reach the threshold.

    A task holds one range: its counters, and the partial sketches of that range, some LOAD entries a cell at most.
    """
    spark = partials.sparkSession
    dealt = partials.repartition(c.parallelism(spark), "row", "part").sortWithinPartitions("row", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in c.tidy(batches):
                yield from zip(*(batch.column(n).to_pylist() for n in ("row", "part", "unit", "n", "cells")), strict=True)

        for (row, part), group in groupby(rows(), key=lambda r: r[:2]):
            sums = np.zeros(1 << layout.low, np.uint32)
            held = []
            for _, _, unit, n, data in group:
                cells, counts = unpack(data, n, layout.low)
                sums[cells] += counts  # a partial sketch has each cell once
                np.minimum(sums, threshold, out=sums) if len(held) % 4096 == 4095 else None
                held.append((unit, n, data))
            heavy = sums >= threshold
            for k in range(0, len(held), 1024):
                some = held[k : k + 1024]
                bits = [np.packbits(heavy[unpack(data, n, layout.low)[0]]).tobytes() for _, n, data in some]
                yield pa.record_batch({"unit": pa.array([u for u, _, _ in some]), "row": pa.array([row] * len(some), pa.int32()), "part": pa.array([part] * len(some), pa.int64()), "n": pa.array([n for _, n, _ in some], pa.int64()), "bits": pa.array(bits, pa.binary())})

    return dealt.mapInArrow(run, "unit string, row int, part long, n long, bits binary")


def _survivors(answers: DataFrame, layout: Layout, folder: str, tasks: int) -> DataFrame:
    """(lang, words, phrase, f) of each unit's surviving phrases; words = 0 has the unit's words of a language."""
    dealt = answers.repartition(tasks, "unit").sortWithinPartitions("unit", "row", "part")

    def count(name: str, bits: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        unit = _read_unit(folder, name)
        slices, parts, hashes = {}, [], []
        for piece, p, words, found, place in _unit_hashes(unit):
            slices[piece] = p
            parts.append((piece, words, place))
            hashes.append(found)
        sizes = [len(x) for x in hashes]
        every = np.concatenate(hashes)
        del hashes
        order = np.argsort(every).astype(np.int32)
        every = every[order]
        at, counts = _runs(every)
        h = every[at]
        del every
        alive = np.ones(len(h), bool)
        for row in range(DEPTH):
            cells = layout.cells(h, row)
            by = np.argsort(cells) if row else np.arange(len(h))
            _, width = _runs(cells[by])
            alive[by] &= np.repeat(bits[row], width)
            del cells, by, width
        one = order[at[alive]].astype(np.int64)  # an occurrence of each
        counts = counts[alive]
        del order, at, alive, h
        ends = np.cumsum(sizes)
        source = np.searchsorted(ends, one, side="right")
        for k, (piece, words, place) in enumerate(parts):
            mine = np.flatnonzero(source == k)
            if len(mine):
                where = place[one[mine] - (ends[k] - sizes[k])]
                p = slices[piece]
                yield pa.record_batch({
                    "lang": unit[piece][1].take(pa.array(p.doc[where])).cast(pa.string()),
                    "words": pa.array(np.full(len(mine), words, np.int32)),
                    "phrase": p.strings(np.full(len(mine), words), where).cast(pa.string()),
                    "f": pa.array(counts[mine].astype(np.int64)),
                })
        for piece, (_, langs) in enumerate(unit):
            p = slices[piece]
            own = pa.table({"lang": langs.cast(pa.string()), "f": np.bincount(p.doc, minlength=len(langs)).astype(np.int64)}).group_by("lang").aggregate([("f", "sum")])
            yield pa.record_batch({"lang": own["lang"].combine_chunks(), "words": pa.array(np.zeros(len(own), np.int32)), "phrase": pa.array([""] * len(own)), "f": own["f_sum"].combine_chunks()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in c.tidy(batches):
                yield from zip(*(batch.column(n).to_pylist() for n in ("unit", "row", "n", "bits")), strict=True)

        for name, group in groupby(rows(), key=lambda r: r[0]):
            bits: list[list] = [[np.zeros(0, bool)] for _ in range(DEPTH)]
            for _, row, n, data in group:
                bits[row].append(np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool))
            yield from count(name, [np.concatenate(b) for b in bits])

    return dealt.mapInArrow(run, "lang string, words int, phrase string, f long")


# ---------------------------------------------------------------- counts, scores, subsumption


def frequent_phrases(documents: DataFrame, threshold: int = 30) -> DataFrame:
    """(lang, words, phrase, f): exact counts of all phrases of 1 to LONGEST words found ``threshold`` times or
    more in a language; words = 0 has all words of it."""
    spark = documents.sparkSession
    rows = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    rows = rows.where("text <> ''")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout(LONGEST * size / 6)  # some six bytes a word; the width decides how many rare phrases pass, no result
    folder = c.scratch(spark, "phrase-units")
    tasks = max(2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    units = c.stash(_keep_units(rows, folder), "unit-names").repartition(4 * tasks)
    partials = _sketch_units(units, layout, folder, threshold)
    counted = _survivors(_answers(partials, layout, threshold), layout, folder, tasks)
    exact = counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return c.stash(exact.where((F.col("f") >= threshold) | (F.col("words") == 0)), "phrases")


def score_phrases(grams: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, words, phrase, a, l, r, score (all exact)."""
    big = "decimal(38,0)"
    many = grams.where("words >= 2").withColumn("w", F.split("phrase", " "))
    cut = many.select("lang", "words", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "words", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    parts = grams.where("words between 1 and 3")
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    whole = cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    score = F.expr(f"cast(2000000 * cast(a as {big}) div (cast(l as {big}) + cast(r as {big})) as bigint)")
    least = whole.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("least"))
    return least.select("lang", "words", "phrase", "a", "least.l", "least.r", "least.score")


def subsume(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates without those whose words lie inside a longer one that is at least ``percent`` as frequent."""
    w = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    inside = candidates.where("words > 2").withColumn("w", w).select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(most, ["lang", "phrase"], "left")
    big = "decimal(38,0)"
    return kept.where(F.expr(f"longer is null or 100 * cast(longer as {big}) < {percent} * cast(a as {big})")).drop("longer")


def collocations(documents: DataFrame, threshold: int = 30, percent: int = 80, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``documents``: (text, lang), other columns are ignored, whatever their names. A null text is empty, a null
    language is ``und``. Rows that repeat count each. Texts of any length are read whole, cut at ends of
    pieces only. Equal scores and counts are ordered by the phrase's bytes. An empty table gives no row.
    """
    grams = frequent_phrases(documents, threshold)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = subsume(score_phrases(grams), percent).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= most)
    totals = grams.where("words = 0").select("lang", F.col("f").alias("n"))  # one row a language
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
