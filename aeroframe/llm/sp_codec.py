"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

One pass over a segment follows the automaton; at every position the output links
give all pieces that end there, and each relaxes the state of that position:

* unigram models keep the best sum of piece scores (Viterbi);
* BPE models keep the one piece that can come last there. Scores alone do not
  reproduce merge order, so a piece is admitted after another only if merging
  their joined text gives exactly those two pieces; adjacent admissible pieces
  are the encoding, so the same single pass is exact. Segments that start with a
  run of space marks are merged directly (pieces of equal rank are ordered by
  place there).

Characters without a piece fall back to byte pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import segments

MARK = "▁"
_UNKNOWN = -1


class PieceModel:
    """Pieces, scores and kinds of a model file, and the automaton over them."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int, kind: str, special: set[int] = frozenset()) -> None:
        import ahocorasick

        self.pieces, self.scores, self.byte_ids, self.unknown, self.kind = pieces, scores, byte_ids, unknown, kind
        self.normal = {p: i for i, p in enumerate(pieces) if i not in special and i not in set(byte_ids.values()) and p}
        self.machine = ahocorasick.Automaton()
        for p, i in self.normal.items():
            self.machine.add_word(p, (len(p), i))
        self.machine.make_automaton()
        self.follows: dict[tuple[int, int], bool] = {}
        self.penalty = min((scores[i] for i in self.normal.values()), default=0.0) - 10.0
        back = {i: bytes([b]) for b, i in byte_ids.items()}
        self.table = [back[i] if i in back else b" \xe2\x81\x87 " if i == unknown else b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(x) for x in self.table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.table), np.uint8)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        ids = range(n)
        byte_ids = {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}
        special = {i for i in ids if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        return cls([p.id_to_piece(i) for i in ids], [p.get_score(i) for i in ids], byte_ids, p.unk_id(), _model_kind(p.serialized_model_proto()), special)

    def merged(self, s: str) -> list[int]:
        """BPE by its definition: join the adjacent pair whose piece scores best, leftmost first."""
        n = len(s)
        end = list(range(1, n + 1))  # of the part that begins here; parts are linked both ways
        before = list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (i := self.normal.get(s[a : end[b]])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, end[b]))

        alive = [True] * n
        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a] if alive[a] else n
            if b >= n or end[b] != stop:
                continue  # one of the two has been joined since
            alive[b] = False
            end[a] = stop
            if stop < n:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            out.append(self.normal.get(s[a : end[a]], _UNKNOWN))
            a = end[a]
        return out

    def admits(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.follows:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            self.follows[key] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return self.follows[key]

    def _whole(self, i: int) -> bool:
        key = (i, _UNKNOWN)
        if key not in self.follows:
            self.follows[key] = self.merged(self.pieces[i]) == [i]
        return self.follows[key]

    def segment(self, s: str) -> list[int]:
        """Ids of one segment (spaces already written as marks)."""
        n = len(s)
        if self.kind == "bpe" and n > 1 and s[0] == MARK and s[1] == MARK:
            return self._bytes(s, self.merged(s))
        last: list = [None] * (n + 1)
        begin = [0] * (n + 1)
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        done = 0

        def fill(upto: int) -> None:
            # positions no piece ends at: the character is unknown and stands alone
            nonlocal done
            while done < upto:
                done += 1
                if last[done] is None:
                    last[done], begin[done], best[done] = _UNKNOWN, done - 1, best[done - 1] + self.penalty

        if self.kind == "bpe":
            for end, (size, i) in self.machine.iter(s):
                fill(end)
                if last[end + 1] is None:
                    a = end + 1 - size
                    before = last[a] if a else None
                    if (before is None or before == _UNKNOWN or self.admits(before, i)) and self._whole(i):
                        last[end + 1], begin[end + 1] = i, a
        else:
            for end, (size, i) in self.machine.iter(s):
                fill(end)
                a = end + 1 - size
                if (v := best[a] + self.scores[i]) > best[end + 1]:
                    last[end + 1], begin[end + 1], best[end + 1] = i, a, v
                if best[end] + self.penalty > best[end + 1]:
                    last[end + 1], begin[end + 1], best[end + 1] = _UNKNOWN, end, best[end] + self.penalty
        fill(n)
        out = []
        at = n
        while at > 0:
            out.append((last[at], begin[at]))
            at = begin[at]
        ids: list[int] = []
        for i, a in reversed(out):
            if i == _UNKNOWN:
                ids += self._unknown(s[a])
            else:
                ids.append(i)
        return ids

    def _unknown(self, ch: str) -> list[int]:
        return [self.byte_ids[b] for b in ch.encode("utf-8")] if self.byte_ids else [self.unknown]

    def _bytes(self, s: str, ids: list[int]) -> list[int]:
        if _UNKNOWN not in ids:
            return ids
        out, at = [], 0
        for i in ids:
            if i == _UNKNOWN:
                out += self._unknown(s[at])
                at += 1
            else:
                out.append(i)
                at += len(self.pieces[i])
        return out

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and n + 1 offsets; the space put before each text is taken off again."""
        size = self.lengths[flat]
        raw = self.bytes[np.repeat(self.starts[flat], size) + c.ragged(size)]
        sums = np.concatenate([[0], np.cumsum(size)])
        offs = sums[offsets]
        full = np.flatnonzero(offs[1:] > offs[:-1])
        lead = offs[:-1][full]
        lead = lead[raw[lead] == 0x20]
        keep = np.ones(len(raw), bool)
        keep[lead] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        return raw[keep], kept[offs]


def _model_kind(proto: bytes) -> str:
    """Model type from the trainer settings of a serialised model (field 2, then field 3: 2 means BPE)."""

    def fields(b: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                x = b[at]
                at += 1
                value |= (x & 127) << shift
                shift += 7
                if x < 128:
                    return value

        while at < len(b):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(key & 7) or number()
                yield key >> 3, b[at : at + size]
                at += size

    for field, value in fields(proto):
        if field == 2:
            return "bpe" if dict(fields(value)).get(3) == 2 else "unigram"
    return "unigram"


_models: dict[str, tuple[PieceModel, segments.SegmentEncoder]] = {}


def codec(path: str) -> tuple[PieceModel, segments.SegmentEncoder]:
    if path not in _models:
        model = PieceModel.load(path)
        _models[path] = (model, segments.SegmentEncoder(segments.cut_before_gap, lambda parts: [model.segment(x.decode("utf-8").replace(" ", MARK)) for x in parts], len(model.pieces)))
    return _models[path]


def encode_texts(encoder: segments.SegmentEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts, each with the space before it that the format asks for (none before an empty text)."""
    raw, offs = c.buffers(texts)
    size = np.diff(offs)
    grown = np.where(size > 0, size + 1, 0)
    at = np.concatenate([[0], np.cumsum(grown)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.cumsum(size > 0), size)] = raw
    return encoder(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)]))


def encode_documents(documents: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text, however long; null and empty texts have no ids.

    Repeated rows and rows without a doc_id are encoded each. Equal scores go to the
    piece that begins first. An empty table gives no row; other columns are ignored,
    whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = codec(model)
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                flat, offs = encode_texts(encoder, c.text_column(part, "text"))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int32()))})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of ids (null or empty: an empty text). Bytes that are no valid UTF-8 become U+FFFD.

    Rows that repeat a doc_id, and those without one, are decoded each; very long ones whole. An empty table gives
    no row; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = codec(model)
        for batch in batches:
            ids = batch.column("ids")
            length = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
            raw, offs = pieces.decode(np.asarray(ids.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(length)]))
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def codec_digest(documents: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32, decoded_crc32 and round_trip.

    ``round_trip`` compares the decoded bytes with the text (a mark written in the
    text reads as a space). Encoding and decoding run in the same pass. Null and
    empty texts have no ids, repeated rows and rows without a doc_id give a row each,
    very long texts are encoded whole. An empty table gives no row; other columns are
    ignored, whatever their names.
    """
    mark = MARK.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, encoder = codec(model)
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                texts = c.text_column(part, "text")
                flat, offs = encode_texts(encoder, texts)
                back, at = pieces.decode(flat, offs)
                ids = flat.astype("<u4")
                raw, ro = c.buffers(texts)
                same = []
                for k in range(len(texts)):
                    x, y = raw[ro[k] : ro[k + 1]], back[at[k] : at[k + 1]]
                    same.append(bool(np.array_equal(x, y)) or x.tobytes().replace(mark, b" ") == y.tobytes())
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_tokens": np.diff(offs),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.int64()),
                        "decoded_crc32": pa.array([zlib.crc32(back[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                        "round_trip": pa.array(same, pa.bool_()),
                    }
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
