"""Packing by lexical retrieval.

Texts are tokenised once into a table in the shared folder. Document frequencies
of all tokens are counted over the whole corpus (a table bounded by the
vocabulary). Documents are placed by content: the terms that weigh most in BM25 are
their topic, and documents of one topic lie next to each other in one partition,
wherever they were stored; a frequent topic is dealt to several. Each task reads its
part as shards of bounded size, builds a BM25 inverted index over each shard's token ids, and fills windows:
a seed document, then its best unused neighbours, the last of which is cut; the
rest of it seeds the next window. What is left at the end of a task is cut into
sequences whose lengths are powers of two, so no padding is needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import segments

WINDOW = 4096
#: Documents and tokens of a shard, about (a single longer document is a shard).
SHARD_DOCS, SHARD_TOKENS = 512, 1 << 20
K1, B = 1.2, 0.75


def tokenise(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and ids (little-endian, 2 bytes where the vocabulary allows it) with the end id, as a shared table."""
    from tokenizers import Tokenizer

    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = segments.library_encoder(tokenizer, segments.cut_at_words)
        for batch in c.tidy(batches):
            for part in c.slices(batch, most=segments.SLICE_BYTES):
                flat, offs = encoder(c.text_column(part, "text"))
                n = np.diff(offs)
                ids = np.full(len(flat) + len(n), end_id, kind)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                at = (np.concatenate([[0], np.cumsum(n + 1)]) * ids.itemsize).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.record_batch({"doc_id": part.column("doc_id"), "width": pa.array(np.full(len(n), ids.itemsize, np.int32)), "ids": data})

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return c.stash(rows.mapInArrow(run, "doc_id long, width int, ids binary"), "tokens")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of token rows and n + 1 offsets."""
    kind = f"<u{batch.column('width')[0].as_py()}"
    column = batch.column("ids").cast(pa.large_binary())
    raw, offs = c.buffers(column)
    return raw.view(kind) if len(raw) else np.zeros(0, kind), offs // int(kind[2])


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Documents that hold each token, documents, and mean length: counted over all rows.

    Tasks send one row per distinct token, summed before and after the shuffle;
    the driver gets one row per token of the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        docs = length = 0
        for batch in c.tidy(batches):
            for part in c.slices(batch, "ids", 1 << 20):
                ids, offs = _ids(part)
                n = np.diff(offs)
                pairs = np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | ids.astype(np.uint64)
                found = (np.unique(pairs) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                if len(found) and found.max() >= len(total):
                    total = np.concatenate([total, np.zeros(int(found.max()) + 1 - len(total), np.int64)])
                total += np.bincount(found, minlength=len(total))
                docs, length = docs + len(n), length + len(ids)
        some = np.flatnonzero(total)
        yield pa.record_batch({"token": np.concatenate([[-2, -1], some]), "n": np.concatenate([[length, docs], total[some]])})

    got = tokens.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    by = {r.token: r.n for r in got}
    length, docs = by.pop(-2, 0), by.pop(-1, 0)
    df = np.zeros(max(by, default=0) + 1, np.int64)
    df[list(by)] = list(by.values())
    return df, docs, length / max(docs, 1)


def topics(ids: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two terms of each document that weigh most for a window of its own length (-1: none). ``idf`` is 0 for terms of one document."""
    n = len(offs) - 1
    pairs = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), np.diff(offs)) | ids.astype(np.uint64)
    pairs, tf = np.unique(pairs, return_counts=True)
    doc, token = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    weight = idf[token] * (tf * (K1 + 1) / (tf + K1)).astype(np.float32)
    out = []
    for _ in range(2):
        top = c.per_doc(weight, np.searchsorted(doc, np.arange(n + 1)), np.maximum, np.float32(0))
        hits = np.flatnonzero((weight == top[doc]) & (weight > 0))
        at = np.searchsorted(doc[hits], np.arange(n))
        some = np.flatnonzero(top > 0)
        best = np.full(n, -1, np.int64)
        best[some] = token[hits[at[some]]]
        weight[hits[at[some]]] = 0
        out.append(best)
    return out[0], out[1]


def place(tokens: DataFrame, df: np.ndarray, docs: int, parts: int) -> DataFrame:
    """``tokens`` ordered by topic within partitions. No topic fills a partition: document frequencies bound how many parts it is dealt to."""
    idf = np.where(df >= 2, np.log1p((docs - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
    split = (df * parts // max(docs, 1) + 1).astype(np.int64)
    shared = tokens.sparkSession.sparkContext.broadcast((idf, split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch, "ids", 1 << 20):
                weights, splits = shared.value
                first, second = topics(*_ids(part), weights)
                number = c.mix(part.column("doc_id").fill_null(0).to_numpy().astype(np.uint64))
                share = (number % splits[np.maximum(first, 0)].astype(np.uint64)).astype(np.int64)
                yield pa.record_batch([*part.columns, pa.array(first), pa.array(second), pa.array(share)], [*part.schema.names, "first", "second", "share"])

    keyed = tokens.mapInArrow(run, "doc_id long, width int, ids binary, first long, second long, share long")
    order = ["first", "share", "second", "doc_id"]
    return keyed.repartition(parts, "first", "share").sortWithinPartitions(*order, F.xxhash64("ids")).select("doc_id", "width", "ids")


class Index:
    """BM25 over the documents of one shard: postings by token, with final weights."""

    def __init__(self, ids: np.ndarray, offs: np.ndarray, idf: np.ndarray, mean: float) -> None:
        n = np.diff(offs)
        pairs = ids.astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(n), dtype=np.uint64), n)
        pairs, tf = np.unique(pairs, return_counts=True)
        token, self.doc = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)
        self.weight = (idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[self.doc] / max(mean, 1e-9)))).astype(np.float32)
        self.tokens, first = np.unique(token, return_index=True)
        self.first = np.append(first, len(token))
        # the same pairs by document: the terms a document asks for
        order = np.argsort(self.doc, kind="stable")
        self.terms = np.searchsorted(self.tokens, token[order])
        self.term_at = np.searchsorted(self.doc[order], np.arange(len(n) + 1))
        self.n = len(n)

    def neighbours(self, d: int, used: np.ndarray) -> np.ndarray:
        """Unused documents by falling score for the terms of ``d`` (ties: input order)."""
        mine = self.terms[self.term_at[d] : self.term_at[d + 1]]
        start, size = self.first[mine], self.first[mine + 1] - self.first[mine]
        at = np.repeat(start, size) + c.ragged(size)
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        free = np.flatnonzero(~used)
        return free[np.argsort(-score[free], kind="stable")]


class Packer:
    """Fills windows with pieces; keeps the open window from shard to shard."""

    def __init__(self, part: int) -> None:
        self.part, self.sequence, self.room = part, 0, WINDOW
        self.rows: list[tuple] = []
        self.open: list[tuple] = []  # pieces of the window that is being filled

    def _emit(self, pieces: list[tuple]) -> None:
        offset, name = 0, (self.part << 40) | self.sequence
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4")), total, name, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray, start: int, total: int) -> int:
        """Put as much as fits into the window; returns how many ids went in."""
        k = min(self.room, len(ids))
        self.open.append((doc_id, start, ids[:k], total))
        self.room -= k
        if not self.room:
            self._emit(self.open)
            self.open, self.room = [], WINDOW
        return k

    def finish(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two."""
        size, left = WINDOW - self.room, self.open
        power = WINDOW
        while power:
            if size & power:
                taken, need = [], power
                while need:
                    doc_id, start, ids, total = left.pop(0)
                    k = min(need, len(ids))
                    taken.append((doc_id, start, ids[:k], total))
                    if k < len(ids):
                        left.insert(0, (doc_id, start + k, ids[k:], total))
                    need -= k
                self._emit(taken)
            power >>= 1
        self.open, self.room = [], WINDOW


def pack_shard(packer: Packer, doc_ids: list, ids: np.ndarray, offs: np.ndarray, idf: np.ndarray, mean: float) -> None:
    n = len(doc_ids)
    index = Index(ids, offs, idf, mean)
    used = np.zeros(n, bool)
    seed = 0
    follow: np.ndarray | None = None  # neighbours of the window's seed, best first
    at = 0
    while True:
        while seed < n and used[seed]:
            seed += 1
        if seed == n:
            return
        if follow is None:
            d = seed
        else:
            while at < len(follow) and used[follow[at]]:
                at += 1
            d = int(follow[at])
        used[d] = True
        own = ids[offs[d] : offs[d + 1]]
        done = 0
        fresh = follow is None
        while done < len(own):
            was = packer.room
            done += packer.add(doc_ids[d], own[done:], done, len(own))
            fresh = fresh or packer.room == WINDOW or packer.room > was
        if packer.room == WINDOW:
            follow, at = None, 0  # the window ended with the document: the next seed is the next unused one
        elif fresh:
            follow, at = index.neighbours(d, used), 0


def pack(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id (with the end id of each document) lies in exactly one piece. A null
    or empty text is its end id alone; rows that repeat a doc_id are packed each, as
    are rows without one. A text longer than a window goes on in the next. Ties of
    neighbours go by order of placement. An empty table gives no row; other columns
    are ignored, whatever their names.
    """
    tokens = tokenise(documents, tokenizer, end_id)
    df, docs, mean = frequencies(tokens)
    idf = np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32)  # bounded by the vocabulary
    shared = documents.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId())
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

        for batch in c.tidy(batches):
            for part in c.slices(batch, "ids", SHARD_TOKENS * 2):
                for k in range(0, part.num_rows, SHARD_DOCS):
                    shard = part.slice(k, SHARD_DOCS)
                    ids, offs = _ids(shard)
                    pack_shard(packer, shard.column("doc_id").to_pylist(), ids, offs, shared.value, mean)
                    if packer.rows:
                        yield out()
        packer.finish()
        if packer.rows:
            yield out()

    placed = place(tokens, df, docs, c.parallelism(documents.sparkSession))
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
