"""Encoding texts by their distinct segments.

A tokenizer that never looks across certain boundaries gives the same ids for a
text as for its segments one after the other. Segments repeat a lot, so a batch
is cut at safe boundaries (numpy over the raw bytes), its distinct segments are
found by Arrow, and only those unseen by this worker reach the tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as c

_SPACE = 0x20
#: Segments that go to the tokenizer in one text.
FENCED = 128
#: Bytes of text that are cut into segments at once: the more, the more of them repeat.
SLICE_BYTES = 2 << 20


def _doc_starts(n: int, offsets: np.ndarray) -> np.ndarray:
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    return cut


def cut_before_space(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Boundaries for byte-level BPE with the usual pattern: before a space that follows a visible character.

    No branch of the pattern goes on across such a place. After a byte that could
    end a multi-byte white-space character nothing is cut, which is always safe.
    """
    n = len(raw)
    cut = _doc_starts(n, offsets)
    at = np.flatnonzero(raw == _SPACE)
    at = at[at > 0]
    b1 = raw[at - 1]
    b2, b3 = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    control = (b1 <= _SPACE) | (b1 == 0x7F)
    wide = (b2 == 0xC2) & ((b1 == 0xA0) | (b1 == 0x85))
    wide |= ((b3 == 0xE1) & (b2 == 0x9A)) | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE3) & (b2 == 0x80))
    cut[at[~control & ~wide]] = True
    return cut


def cut_at_words(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Boundaries for tokenizers that drop white space: where a word begins after ASCII white space."""
    n = len(raw)
    cut = _doc_starts(n, offsets)
    black = ~c._WHITE[raw]
    cut[1:n] |= black[1:] & ~black[:-1]
    return cut


def cut_before_gap(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Boundaries for word-piece models with a space mark: before a run of spaces.

    The mark itself (U+2581) written in a text counts as a space there.
    """
    n = len(raw)
    cut = _doc_starts(n, offsets)
    at = np.flatnonzero(raw == _SPACE)
    at = at[at > 0]
    b1, b2, b3 = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    cut[at[(b1 != _SPACE) & ~((b3 == 0xE2) & (b2 == 0x96) & (b1 == 0x81))]] = True
    return cut


class SegmentEncoder:
    """Ids of texts through a bounded cache of segment ids, kept for the life of a worker.

    The cache is a few numpy arrays ordered by a 64-bit hash of the segment, with a
    second, independent hash beside it: should the first ever collide, the slice is
    encoded without the cache. So a worker remembers millions of segments without a
    Python object for each.
    """

    def __init__(self, cutter: Callable, encode: Callable[[list[bytes]], Sequence[Sequence[int]]], ids: int, most: int = 1_500_000, marks: Sequence[str] = (), whole: Callable[[list[str]], Sequence[Sequence[int]]] | None = None) -> None:
        """``ids``: size of the vocabulary, which sets the width of stored ids. Texts that hold one of ``marks`` are encoded by ``whole``."""
        self.cutter, self.encode, self.most = cutter, encode, most
        self.marks, self.whole = marks, whole
        self.kind = np.uint16 if ids <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.levels = [none, none]  # (hash, check, row), both ordered by hash; the second is small and new
        self.ids, self.n_ids = np.zeros(1 << 16, self.kind), 0
        self.start, self.length, self.n = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint32), 0

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts, and how many each has. ``encode`` may give both at once, or a sequence of ids for each part."""
        got = self.encode(parts)
        if isinstance(got, tuple):
            return got
        return np.concatenate([np.zeros(0, self.kind), *(np.asarray(x, self.kind) for x in got)]), np.fromiter(map(len, got), np.int64, len(got))

    def _learn(self, new: list[bytes], key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Rows of new segments."""
        flat, lengths = self._encoded(new)
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x) // 2), x.dtype)])
        self.ids = grown(self.ids, self.n_ids + len(flat))
        self.start, self.length = grown(self.start, self.n + len(new)), grown(self.length, self.n + len(new))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.length[self.n : self.n + len(new)] = lengths
        self.start[self.n : self.n + len(new)] = self.n_ids + np.cumsum(lengths) - lengths
        rows = np.arange(self.n, self.n + len(new), dtype=np.int32)
        self.n += len(new)
        self.n_ids += len(flat)
        self.levels[1] = self._merge(self.levels[1], (key, check, rows))
        if len(self.levels[1][0]) > max(1 << 15, len(self.levels[0][0]) >> 3):
            none = tuple(x[:0] for x in self.levels[1])
            self.levels = [self._merge(*self.levels), none]
        return rows

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        order = np.argsort(keys := np.concatenate([a[0], b[0]]), kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]

    def _rows(self, raw: np.ndarray, cuts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """The cache row of every segment, or None if two different ones have the same hash."""
        key, check = c.span_hashes(raw, cuts, ends), c.span_checks(raw, cuts, ends)
        coded = pa.array(key).dictionary_encode()
        index, kinds = np.asarray(coded.indices), np.asarray(coded.dictionary)
        if self.n + len(kinds) > self.most and self.n:
            self._clear()
        first = np.empty(len(kinds), np.int64)
        first[index[::-1]] = np.arange(len(index) - 1, -1, -1)
        own = check[first]
        if (own[index] != check).any():
            return None
        order = np.argsort(kinds)  # a sorted search walks the known hashes once, in order
        kinds, own, first = kinds[order], own[order], first[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = np.full(len(kinds), -1, np.int32)
        for known, checks, rows in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, kinds), len(known) - 1)
                hit = known[at] == kinds
                if (checks[at[hit]] != own[hit]).any():
                    return None
                row[hit] = rows[at[hit]]
        if len(new := np.flatnonzero(row < 0)):
            data = raw.tobytes()
            where = first[new]
            row[new] = self._learn([data[x:y] for x, y in zip(cuts[where].tolist(), ends[where].tolist(), strict=True)], kinds[new], own[new])
        return row[place][index]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and n + 1 offsets into them. ``texts``: large_string without nulls."""
        marked = np.zeros(len(texts), bool)
        for mark in self.marks:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._segmented(texts)
        flat, offs = self._segmented(pc.if_else(pa.array(marked), pa.scalar("", pa.large_string()), texts))
        got = iter(self.whole(texts.filter(pa.array(marked)).to_pylist()))
        parts = [np.asarray(next(got), self.kind) if m else flat[offs[k] : offs[k + 1]] for k, m in enumerate(marked)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _segmented(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = c.buffers(texts)
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        cuts = np.flatnonzero(self.cutter(raw, offsets)[:-1])
        ends = np.append(cuts[1:], len(raw))
        row = self._rows(raw, cuts, ends)
        if row is None:
            data = raw.tobytes()
            flat, length = self._encoded([data[x:y] for x, y in zip(cuts.tolist(), ends.tolist(), strict=True)])
        else:
            length = self.length[row].astype(np.int64)
            flat = self.ids[np.repeat(self.start[row].astype(np.int64), length) + c.ragged(length)]
        sums = np.concatenate([[0], np.cumsum(length)])
        return flat, sums[np.searchsorted(cuts, offsets, side="left")]


_encoders: dict = {}


def library_encoder(path: str, cutter: Callable) -> SegmentEncoder:
    """An encoder over a tokenizer file of the tokenizers library; one per worker and file."""
    if (key := (path, cutter.__name__)) not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding(), t.no_truncation()
        fence = "<|endoftext|>"
        stop, marks = t.token_to_id(fence), [x.content for x in t.get_added_tokens_decoder().values()]

        def encode(parts: list[bytes]) -> list | tuple[np.ndarray, np.ndarray]:
            """Ids of all parts and how many each has. Many parts go to the library as one text, fenced by a special token,
            which it never joins with its neighbours."""
            if stop is None:
                return whole([x.decode("utf-8") for x in parts])
            between = fence.encode()
            got = t.encode_batch_fast([between.join(parts[k : k + FENCED]).decode("utf-8") for k in range(0, len(parts), FENCED)], add_special_tokens=False)
            flat = np.concatenate([np.array([*e.ids, stop], np.int32) for e in got])
            ends = np.flatnonzero(flat == stop)
            return flat[flat != stop].astype(np.uint32), np.diff(ends, prepend=-1) - 1

        def whole(texts: list[str]) -> list:
            """The library's own ids of whole texts, with the special tokens they hold."""
            return [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

        _encoders[key] = SegmentEncoder(cutter, encode, t.get_vocab_size(), marks=marks, whole=whole)
    return _encoders[key]
