"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Windows come in a few sizes; one of size w slides by w / 2, so any stretch of at
most w / 2 words lies whole in one of them. A template of m words is looked for in
windows of the least size w >= 2 m. Bands have one row each: a window and a
template meet in a band with probability J, their Jaccard similarity, and the
number of bands is set so that a window that holds the least acceptable part of
the template meets it with probability RECALL at least. A window can only meet a
template whose shingle it holds, so windows without any template shingle are
passed over before hashing; that loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SHINGLE = 5
CONTAINMENT = 0.8
RECALL = 0.9999
SIZES = (16, 32, 64, 128, 256, 512, 1024)

# Public licence notices and grants, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def plain_words(texts: pa.Array) -> c.Words:
    """Lower-case alphanumeric words (ASCII letters folded, other ASCII characters split words)."""
    raw, offs = c.buffers(texts)
    folded = _FOLD[raw]
    folded[~_LETTER[folded]] = 0x20
    return c.Words(pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(folded)]))


def bands_needed(shingles: int, window_shingles: int, containment: float = CONTAINMENT, recall: float = RECALL) -> int:
    """One-row bands so that a window holding ``containment`` of a template meets it with probability ``recall``."""
    held = math.ceil(containment * shingles)
    j = held / (window_shingles + shingles - held)
    return 1 if j >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - j))


@dataclass
class Library:
    """Templates with their shingles, the window sizes that look for them, and their band minima."""

    templates: list[tuple[str, str]]
    containment: float = CONTAINMENT
    recall: float = RECALL
    shingles: list[np.ndarray] = field(default_factory=list)
    by_size: dict[int, list[int]] = field(default_factory=dict)
    bands: dict[int, int] = field(default_factory=dict)
    minima: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        w = plain_words(pa.array([t for _, t in self.templates], pa.large_string()))
        g, at = w.grams(SHINGLE, short=True)
        for k, m in enumerate(w.count):
            self.shingles.append(np.unique(g[w.doc[at] == k]))
            size = next((s for s in SIZES if s >= 2 * m), max(SIZES[-1], 1 << int(2 * m - 1).bit_length()))
            self.by_size.setdefault(size, []).append(k)
        for size, ks in self.by_size.items():
            self.bands[size] = max(bands_needed(len(self.shingles[k]), size - SHINGLE + 1, self.containment, self.recall) for k in ks)
            self.minima[size] = np.array([[hashed(self.shingles[k], b).min() for b in range(self.bands[size])] for k in ks])
        self.all = np.unique(np.concatenate(self.shingles)) if self.shingles else np.zeros(0, np.uint64)
        # a table of hash prefixes answers most lookups without a search
        self.hint = np.zeros(1 << 16, bool)
        self.hint[(self.all >> np.uint64(48)).astype(np.int64)] = True


def hashed(g: np.ndarray, band: int) -> np.ndarray:
    return c.mix(g ^ np.uint64((0x9E3779B97F4A7C15 * (band + 1)) & 0xFFFFFFFFFFFFFFFF))


def scan_slice(texts: pa.Array, library: Library) -> list[tuple[int, int, float, int, int]]:
    """(text, template, containment, first byte, last byte + 1) of every text and template found in it.

    The window with the most of the template is reported, the first of equals.
    """
    w = plain_words(texts)
    g, at = w.grams(SHINGLE, short=True)
    if not len(g):
        return []
    maybe = np.flatnonzero(library.hint[(g >> np.uint64(48)).astype(np.int64)])
    hits = maybe[np.isin(g[maybe], library.all)]
    if not len(hits):
        return []
    best: dict[tuple[int, int], tuple] = {}
    doc_of = w.doc[at]
    first_gram = np.searchsorted(doc_of, np.arange(len(texts) + 1))
    for size, ks in library.by_size.items():
        half = size // 2
        # windows [s, s + size) of words, s a multiple of half, that hold a hit
        local = at[hits] - w.first[doc_of[hits]]
        last = local // half
        windows = np.unique(np.concatenate([np.stack([doc_of[hits], s], axis=1) for s in (last, last - 1)], axis=0), axis=0)
        for d, s in windows[windows[:, 1] >= 0].tolist():
            lo = w.first[d] + s * half
            hi = min(lo + size, w.first[d + 1])
            a, b = first_gram[d], first_gram[d + 1]
            x = a + np.searchsorted(at[a:b], lo)
            y = max(x + 1, a + int(np.searchsorted(at[a:b], hi - SHINGLE, side="right")))
            own = g[x:y]
            if not len(own):
                continue
            low = np.array([hashed(own, k).min() for k in range(library.bands[size])])
            for k in np.flatnonzero((library.minima[size] == low).any(axis=1)):
                template = ks[int(k)]
                inside = np.isin(own, library.shingles[template])
                share = len(np.unique(own[inside])) / len(library.shingles[template])
                if share >= library.containment and share > best.get((d, template), (0,))[0]:
                    pos = at[x:y][inside]
                    end = min(int(pos[-1]) + SHINGLE, int(w.first[d + 1])) - 1
                    best[d, template] = (share, int(w.start[pos[0]] - w.offsets[d]), int(w.end[end] - w.offsets[d]))
    return [(d, t, *v) for (d, t), v in sorted(best.items())]


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, template, containment, start, end (bytes of the text) for every template a document holds.

    The templates are a fixed, small list, shipped with the task; documents are
    read once and never shuffled. Null, empty and wordless texts hold none; rows
    that repeat, and those without a doc_id, are scanned each. Very long texts are
    scanned whole. Of windows that hold equally much of a template the first is
    reported; templates that share text are reported each. An empty table gives no
    row; other columns are ignored, whatever their names.
    """
    templates = TEMPLATES if templates is None else templates
    made: list[Library] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Library(list(templates), containment))
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                if found := scan_slice(c.text_column(part, "text"), made[0]):
                    d, t, share, start, end = zip(*found, strict=True)
                    yield pa.record_batch(
                        {
                            "doc_id": part.column("doc_id").take(pa.array(d)),
                            "license": pa.array([templates[k][0] for k in t]),
                            "template": pa.array(t, pa.int32()),
                            "containment": pa.array(share, pa.float64()),
                            "start": pa.array(start, pa.int64()),
                            "end": pa.array(end, pa.int64()),
                        }
                    )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, license string, template int, containment double, start long, end long")

