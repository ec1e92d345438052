"""Shared pieces of the training-data operators.

Two things live here: where intermediate tables go (a folder every executor can
reach), and a vectorised view of a batch of texts as word positions and 64-bit
word hashes, which never builds a Python object per word.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker holds as numpy arrays at once (longer single texts are taken whole).
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch that goes to a Python worker, about.
BATCH_BYTES = 4 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_aeroframe_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="aeroframe-")
        spark.sparkContext._aeroframe_dir = found
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/aeroframe-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop, spark, path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches between the JVM and Python workers by bytes; texts make the default ones very large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, for operators that run on it."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def repeats(documents: DataFrame) -> bool:
    """Whether any doc_id stands on more than one row (ids only are read)."""
    ids = documents.select("doc_id").where("doc_id is not null")
    return bool(ids.groupBy("doc_id").count().where("count > 1").limit(1).count())


def unique_texts(documents: DataFrame) -> DataFrame:
    """doc_id and text of the rows with a doc_id; of rows that repeat one, that with the least text."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text")) if repeats(documents) else rows


# ---------------------------------------------------------------- texts as arrays


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty texts."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``most`` bytes of text (one row at least)."""
    sizes = np.nan_to_num(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)))
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The input batches of a task; once they end, memory that was freed goes back to the system.

    Workers are reused by later stages, so what an allocator keeps would add up.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls, and n + 1 offsets into them."""
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(o) and o[-1] > o[0] else np.zeros(0, np.uint8)
    return raw, o - o[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        step = np.full(max(n, SLICE_BYTES + 64), _BASE if which == "up" else _BASE_INV, np.uint64)
        step[0] = 1
        grown = np.multiply.accumulate(step)
        if n > 4 * SLICE_BYTES:  # an outsized text: not kept
            return grown[:n]
        _powers[which] = grown
    return _powers[which][:n]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one running polynomial sum over the whole buffer."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    x = raw.astype(np.uint64)
    x += np.uint64(1)
    x *= _power("up", len(raw))  # in place: these arrays set a worker's peak
    np.cumsum(x, out=sums[1:])
    del x
    down = _power("down", len(raw) + 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def span_checks(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Second 64-bit hashes of byte spans, independent of ``span_hashes``: a keyed byte table summed by place."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    x = _TABLE[raw]
    x *= _power("up", len(raw))
    np.cumsum(x, out=sums[1:])
    del x
    down = _power("down", len(raw) + 1)
    return (sums[end] - sums[start]) * down[start]


class Words:
    """Words (runs of anything but ASCII white space) of a list of texts.

    ``start``/``end`` are byte positions in ``raw``; ``first`` has n + 1 offsets
    into the word arrays; ``doc`` is the text each word belongs to.
    """

    def __init__(self, texts: pa.Array, hashed: bool = True) -> None:
        self.raw, self.offsets = buffers(texts)
        n = len(self.raw)
        black = ~_WHITE[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = ~black[:-1] | edge[1:n]
        after[:-1] = ~black[1:] | edge[1:n]
        self.start = np.flatnonzero(black & before)
        self.end = np.flatnonzero(black & after) + 1
        self.first = np.searchsorted(self.start, self.offsets, side="left")
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.count)
        self.hash = span_hashes(self.raw, self.start, self.end) if hashed else None

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of windows of ``k`` words and the word each begins at.

        With ``short``, a text of 1 to k - 1 words has one window of all its words.
        """
        return grams(self.hash, self.doc, self.first, k, short)


def grams(h: np.ndarray, doc: np.ndarray, first: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    g, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        g = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            g *= _STEP
            g += h[j : n - k + 1 + j]
        at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        g = mix(g[at])
    if short and n:
        count = np.diff(first)
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            own = []
            for d in few:
                x = np.uint64(int(count[d]))
                for y in h[first[d] : first[d + 1]]:
                    x = np.uint64((int(x) * int(_STEP) + int(y)) & 0xFFFFFFFFFFFFFFFF)
                own.append(x)
            g, at = np.concatenate([g, mix(np.array(own, np.uint64))]), np.concatenate([at, first[few]])
            order = np.argsort(at, kind="stable")
            g, at = g[order], at[order]
    return g, at


def per_doc(values: np.ndarray, first: np.ndarray, op=np.add, empty=0) -> np.ndarray:
    """``op.reduceat`` over each text's values, with ``empty`` where a text has none."""
    n = len(first) - 1
    out = np.full(n, empty, values.dtype)
    if len(values):
        full = np.flatnonzero(first[1:] > first[:-1])
        out[full] = op.reduceat(values, first[:-1][full])
    return out


def count_bytes(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Per text, how many of its bytes are set in the 256-entry table ``wanted``."""
    sums = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(wanted[raw], out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)
