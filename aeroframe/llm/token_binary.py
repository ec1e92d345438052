"""Token ids as files of Simple-8b words.

A 64-bit word holds a 4-bit selector and as many ids of one width as fit the
other 60 bits; ids of more than 60 bits are escapes kept beside the words. Ids
are cut into blocks of fixed length; each block starts on a word of its own, and
a file ends with the offsets of its blocks, so any run of blocks is decoded by
whole-array operations.

File layout (little-endian):
    magic | words (u64) | escapes (u64) | block word offsets (u64, n + 1) |
    block escape offsets (u64, n + 1) | doc ids (i64) | ids per doc (u64) |
    counts: words, escapes, blocks, docs, ids (5 x u64) | magic
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as c
from . import segments

MAGIC = b"AFS8B\x00\x00\x01"
BLOCK = 1024
#: Ids in a word for selectors 0 to 13; selector 15 marks an escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 15
_COUNT_OF = np.array([*COUNTS, 0, 1])
#: A task starts another file beyond this many ids.
FILE_IDS = 16 << 20
#: Blocks that are encoded or decoded at once: what a worker holds as wide arrays.
GROUP = 256


_SMALL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of uint64 values."""
    out = np.zeros(len(x), np.uint8)
    top = int(x.max()) if len(x) else 0
    if top < len(_SMALL):
        return _SMALL[x]
    if top < 1 << 52:
        return np.frexp(x.astype(np.float64))[1].astype(np.uint8)
    for s in (32, 16, 8, 4, 2, 1):
        big = x >= (np.uint64(1) << np.uint64(s))
        out[big] += s
        x = np.where(big, x >> np.uint64(s), x)
    return out + (x > 0)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, and per block the offsets of both (n + 1 each); GROUP blocks are worked on at a time."""
    parts = [encode_blocks(values[k : k + GROUP * BLOCK]) for k in range(0, max(len(values), 1), GROUP * BLOCK)]
    words, escapes = (np.concatenate([p[i] for p in parts]) for i in (0, 1))

    def joined(i: int) -> np.ndarray:
        base = np.concatenate([[0], np.cumsum([p[i][-1] for p in parts])]).astype(np.uint64)
        return np.concatenate([*(p[i][:-1] + b for p, b in zip(parts, base[:-1], strict=True)), base[-1:]])

    return words, escapes, joined(2), joined(3)


def encode_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for a few blocks, as whole arrays."""
    values = np.asarray(values).astype(np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK + 64), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = values
    padded[:, :BLOCK] = full.reshape(blocks, BLOCK)
    bits = np.zeros((blocks, BLOCK + 64), np.uint8)
    bits[:, :BLOCK] = _bits(full).reshape(blocks, BLOCK)
    # widest of the next k values, for each k a word can hold; past a block's end lie zeros
    widest = {1: bits}
    for k in (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):
        half = next(h for h in (30, 20, 15, 10, 8, 7, 6, 5, 4, 3, 2, 1) if h < k <= 2 * h)
        m = widest[half].copy()
        m[:, : m.shape[1] - (k - half)] = np.maximum(widest[half][:, : m.shape[1] - (k - half)], widest[half][:, k - half :])
        widest[k] = m
    # what fits a selector fits all later ones, so the first that fits is how many do not
    selector = np.zeros(bits.shape, np.uint8)
    for s in range(len(COUNTS)):
        selector += widest[int(COUNTS[s])] > WIDTHS[s]
    selector[selector == len(COUNTS)] = ESCAPE
    length = np.minimum(BLOCK, n - BLOCK * np.arange(blocks)) if blocks else np.zeros(0, np.int64)
    at = np.zeros(blocks, np.int64)
    rows, cols, sels = [], [], []
    live = np.flatnonzero(length > 0)
    while len(live):  # one word of every unfinished block a step
        s = selector[live, at[live]]
        rows.append(live), cols.append(at[live]), sels.append(s)
        at[live] += _COUNT_OF[s]
        live = live[at[live] < length[live]]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.uint64)
    row, col, sel = np.concatenate(rows), np.concatenate(cols), np.concatenate(sels)
    order = np.argsort(row * (BLOCK + 1) + col)
    row, col, sel = row[order], col[order], sel[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    flat = padded.reshape(-1)
    where = row * (BLOCK + 64) + col
    for s in range(len(COUNTS)):
        if len(mine := np.flatnonzero(sel == s)):
            for j in range(COUNTS[s]):
                words[mine] |= flat[where[mine] + j] << np.uint64(j * WIDTHS[s])
    escaped = sel == ESCAPE
    sums = lambda x: np.concatenate([[0], np.cumsum(np.bincount(x, minlength=blocks))]).astype(np.uint64)
    return words, flat[where[escaped]], sums(row), sums(row[escaped])


def decode(words: np.ndarray, escapes: np.ndarray, word_at: np.ndarray, n: int) -> np.ndarray:
    """The n values of whole blocks, all words of one selector at a time."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT_OF[sel]
    before = np.concatenate([[0], np.cumsum(count)])
    first = word_at[:-1].astype(np.int64)
    block = np.repeat(np.arange(len(first)), np.diff(word_at.astype(np.int64)))
    inside = before[:-1] - before[first][block]
    out = np.zeros(len(first) * BLOCK, np.uint64)
    target = block * BLOCK + inside
    room = BLOCK - inside
    for s in range(len(COUNTS)):
        if len(mine := np.flatnonzero(sel == s)):
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for j in range(COUNTS[s]):
                ok = mine[room[mine] > j]
                out[target[ok] + j] = (words[ok] >> np.uint64(j * WIDTHS[s])) & mask
    out[target[sel == ESCAPE]] = escapes
    return out[:n]


def write_file(out, values: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> int:
    """Write one file to a binary stream; returns its length."""
    words, escapes, word_at, escape_at = encode(values)
    parts = [words, escapes, word_at, escape_at, np.asarray(doc_ids, "<i8"), np.asarray(counts, "<u8"), np.array([len(words), len(escapes), len(word_at) - 1, len(doc_ids), len(values)], "<u8")]
    size = 2 * len(MAGIC)
    out.write(MAGIC)
    for p in parts:
        p = p.astype(p.dtype.newbyteorder("<"), copy=False)
        out.write(memoryview(np.ascontiguousarray(p)).cast("B") if p.nbytes else b"")
        size += p.nbytes
    out.write(MAGIC)
    return size


def file_bytes(values: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    out = io.BytesIO()
    write_file(out, values, doc_ids, counts)
    return out.getvalue()


class TokenFile:
    """A file open for reading at any place: ids per document, and its ids a group of blocks at a time.

    Raises ValueError if the file is not whole.
    """

    def __init__(self, stream, size: int) -> None:
        self.stream = stream
        if size < 56 or self._bytes(0, 8) != MAGIC or self._bytes(size - 8, 8) != MAGIC:
            raise ValueError("not a whole token file")
        words, escapes, blocks, docs, self.n = (int(x) for x in np.frombuffer(self._bytes(size - 48, 40), "<u8"))
        if size != 56 + 8 * (words + escapes + 2 * blocks + 2 + 2 * docs):
            raise ValueError("token file has a wrong length")
        self.escapes_at = 8 + 8 * words
        at = self.escapes_at + 8 * escapes
        self.word_at = self._array(at, blocks + 1, "<u8").astype(np.int64)
        self.escape_at = self._array(at + 8 * (blocks + 1), blocks + 1, "<u8").astype(np.int64)
        at += 16 * (blocks + 1)
        self.docs, self.counts = self._array(at, docs, "<i8"), self._array(at + 8 * docs, docs, "<u8").astype(np.int64)

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def _array(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._bytes(at, 8 * n), kind)

    def ids(self) -> Iterator[np.ndarray]:
        blocks = len(self.word_at) - 1
        for k in range(0, blocks, GROUP):
            to = min(k + GROUP, blocks)
            w, e = self.word_at[k : to + 1], self.escape_at[[k, to]]
            words = self._array(8 + 8 * int(w[0]), int(w[-1] - w[0]), "<u8")
            escapes = self._array(self.escapes_at + 8 * int(e[0]), int(e[1] - e[0]), "<u8")
            yield decode(words, escapes, w - w[0], min(self.n, to * BLOCK) - k * BLOCK)

    def digests(self) -> np.ndarray:
        """Unsigned crc32 of each document's ids as little-endian 32-bit integers, however many groups it lies in."""
        out = np.zeros(len(self.docs), np.int64)
        ends = np.cumsum(self.counts)
        done = doc = 0
        for ids in self.ids():
            data = memoryview(ids.astype("<u4")).cast("B")
            base, done = done, done + len(ids)
            while doc < len(ends):
                start = max(base, int(ends[doc] - self.counts[doc]))
                stop = min(done, int(ends[doc]))
                out[doc] = zlib.crc32(data[4 * (start - base) : 4 * (stop - base)], int(out[doc]))
                if ends[doc] > done:
                    break
                doc += 1
        return out


def parse_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, doc ids and ids per document of a file; raises ValueError if it is not whole."""
    f = TokenFile(io.BytesIO(data), len(data))
    return np.concatenate([np.zeros(0, np.uint64), *f.ids()]), f.docs, f.counts


def _open(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def write_token_files(documents: DataFrame, tokenizer: str, out_dir: str, end_id: int = 0, partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the manifest.

    Range-partitioned by doc_id, so any number of tasks write disjoint, ordered
    files. A file counts only if it is in the manifest, which holds the files of
    tasks that succeeded: what a lost executor left behind is ignored. A null text
    is empty (only the end id); rows with equal doc_ids are each written, ordered by
    a text hash; rows without a doc_id come first. An empty table gives an empty
    manifest and no file; other columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(partitions or c.parallelism(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = segments.library_encoder(tokenizer, segments.cut_before_space)
        filesystem, base = _open(out_dir)
        filesystem.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        files = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, files
            ids, docs, counts = (np.concatenate([h[i] for h in held]) for i in range(3))
            held = []
            name = f"{base}/tokens-{part:06d}-{files:04d}-{uuid.uuid4().hex[:8]}.s8b"
            with filesystem.open_output_stream(name) as f:
                size = write_file(f, ids, docs, counts)
            files += 1
            return pa.record_batch({"part": pa.array([part], pa.int64()), "seq": pa.array([files - 1], pa.int64()), "file": [name[len(base) + 1 :]], "n_docs": pa.array([len(docs)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

        total = 0
        for batch in c.tidy(batches):
            for piece in c.slices(batch, most=segments.SLICE_BYTES):
                flat, offs = encoder(c.text_column(piece, "text"))
                counts = np.diff(offs) + 1
                ids = np.full(len(flat) + len(counts), end_id, np.uint32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts - 1)] = flat
                held.append((ids, piece.column("doc_id").fill_null(-(2**63)).to_numpy(), counts))
                total += len(ids)
                if total >= file_ids:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    manifest = dealt.mapInArrow(run, "part long, seq long, file string, n_docs long, n_ids long, n_bytes long")
    return c.stash(manifest, "token-manifest")


def read_token_files(manifest: DataFrame, in_dir: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    Documents are those that were written, repeated doc_ids and null ones each on
    their own; a missing or torn file fails the job. An empty manifest gives no row. Columns of
    the manifest beside its own are ignored; files that it does not name are not read.
    """
    ahead = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))  # one row a file
    dealt = placed.select("file", "base").repartition(max(1, c.parallelism(manifest.sparkSession)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open(in_dir)
        for batch in batches:
            for name, ahead_of in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with filesystem.open_input_file(f"{base}/{name}") as stream:
                    f = TokenFile(stream, stream.size())
                    crc = f.digests()
                yield pa.record_batch({"doc_id": pa.array(f.docs, mask=f.docs == -(2**63)), "start": np.cumsum(f.counts) - f.counts + ahead_of, "n_tokens": f.counts, "ids_crc32": crc})

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
