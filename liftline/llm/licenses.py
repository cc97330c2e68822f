"""Licence texts found by winnowed fingerprints and banded alignment.

Templates are cut into overlapping word n-grams; of every few neighbouring hashes the smallest is kept. These
fingerprints form an inverted index, which is broadcast: its size is that of the templates, and more than
``MOST_WORDS`` words of templates are refused. A document's fingerprints are picked by the same rule, so any run of
``GRAM + PICK - 1`` words shared with a template gives a common fingerprint. Fingerprints of one template that lie near
one diagonal are a candidate; a banded alignment of the words around it, with gaps and substitutions, reports which
template words are matched: coverage, and the span in the document. Documents are read once, whole, without a shuffle.

Null texts have no words. Null and repeated ids are carried through, one set of results per row. Without templates or
rows the result is empty. Other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm import words as W
from liftline.llm.frames import column

GRAM, PICK, BAND, COVERAGE, MOST_WORDS = 3, 3, 8, 0.6, 2_000_000

# Public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
                  "to deal in the Software without restriction",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def scan(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, word hashes."""
    data = W.LOWER[np.frombuffer(text, dtype=np.uint8)]
    starts, ends = W.word_ranges(data, W.ALNUM)
    return data, starts, ends, W.word_hashes(data, starts, ends)


def winnow(hashes: np.ndarray, pick: int = PICK) -> np.ndarray:
    """The places of the smallest of every pick neighbouring hashes; of all if there are fewer."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    pick = min(pick, len(hashes))
    n = len(hashes) - pick + 1
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, pick):
        other = hashes[j:n + j]
        less = other <= best
        np.copyto(best, other, where=less)
        np.copyto(at, np.arange(j, n + j), where=less)
    return np.unique(at)


class Index:
    """Templates' words, and where each of their fingerprints stands."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, pick: int = PICK) -> None:
        self.gram, self.pick = gram, pick
        self.names = sorted(templates)
        self.words: list[list[int]] = []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, name in enumerate(self.names):
            hashes = scan(templates[name].encode())[3]
            self.words.append(hashes.tolist())
            grams = W.window_hashes(hashes, gram)
            for i in winnow(grams, pick).tolist():
                self.places[int(grams[i])].append((k, i))
        self.keys = np.array(sorted(self.places), dtype=np.uint64)

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Template, first and last diagonal (place in the text less place in the template) of near fingerprints."""
        grams = W.window_hashes(hashes, self.gram)
        if not len(grams) or not len(self.keys):
            return
        at = np.searchsorted(self.keys, grams)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == grams
        if not hit.any():
            return
        chosen = winnow(grams, self.pick)
        by_template = defaultdict(set)
        for i in chosen[hit[chosen]].tolist():
            for k, j in self.places[int(grams[i])]:
                by_template[k].add(i - j)
        for k, diagonals in sorted(by_template.items()):
            run: list[int] = []
            for d in sorted(diagonals):
                if run and (d - run[-1] > BAND or d - run[0] > len(self.words[k])):
                    yield k, run[0], run[-1]
                    run = []
                run.append(d)
            yield k, run[0], run[-1]


def align(template: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Most template words matched in order on diagonals low to high: their number, and first and last text word matched.

    A band of the alignment matrix; matches count 3, a skipped or replaced word costs 1.
    """
    none = (0, 0, -1, -1)  # score, matches, first, last
    previous: dict[int, tuple] = {}
    best = none
    for i, word in enumerate(template):
        row: dict[int, tuple] = {}
        left = none
        for j in range(max(0, i + low), min(len(text), i + high + 1)):
            up, corner = previous.get(j, none), previous.get(j - 1, none)
            if text[j] == word:
                cell = (corner[0] + 3, corner[1] + 1, corner[2] if corner[1] else j, j)
            else:
                cell = max((corner[0] - 1, *corner[1:]), (up[0] - 1, *up[1:]), (left[0] - 1, *left[1:]))
                if cell[0] <= 0:
                    cell = none
            row[j] = left = cell
            if cell > best:
                best = cell
        previous = row
    return best[1], best[2], best[3]


def find(text: bytes, index: Index, least: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """Template, coverage, start and end (in code points) of each licence in the text.

    Of matches that overlap, the one with more matched words stays, then the better covered.
    """
    data, starts, ends, hashes = scan(text)
    found = []
    words = hashes.tolist()
    for k, low, high in index.candidates(hashes):
        own = index.words[k]
        matched, a, b = align(own, words, low - BAND, high + BAND)
        if matched and matched >= least * len(own):
            found.append((-matched, -matched / len(own), index.names[k], a, b))
    kept: list[tuple] = []
    for m in sorted(found):
        if all(m[4] < o[3] or m[3] > o[4] for o in kept):
            kept.append(m)
    at = lambda i: len(text[:i].decode())
    return [(name, -cover, at(int(starts[a])), at(int(ends[b]))) for _, cover, name, a, b in sorted(kept, key=lambda m: m[3])]


def _finder(shared, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1)):
                for m in find(text.as_py() or b"", shared.value, least):
                    rows.append(i)
                    out.append(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([m[0] for m in out], pa.string()), pa.array([m[1] for m in out], pa.float64()),
                 pa.array([m[2] for m in out], pa.int64()), pa.array([m[3] for m in out], pa.int64())], names=["doc", "license", "coverage", "start", "end"])
    return run


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                  least: float = COVERAGE) -> DataFrame:
    """One row per licence text found: doc, license, coverage (share of the template's words), start, end."""
    index = Index(TEMPLATES if templates is None else templates)
    if sum(map(len, index.words)) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words are not broadcast; scan with parts of them")
    rows = docs.select(column(docs, id_col).alias("doc"), F.encode(column(docs, text_col), "UTF-8").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return rows.mapInArrow(_finder(shared, least), f"doc {dict(rows.dtypes)['doc']}, license string, coverage double, start long, end long")
