"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are lower-case words (A-Z folded) in shingles of ``SHINGLE`` words.
For every template length m, a text is cut into windows of m shingles that start every
m // 4 shingles. Signatures of ``BANDS`` bands of ``ROWS`` MinHash values retrieve the
templates that share a band. A text part with a containment of ``CONTAINED`` lies in
some window that shares at least ``similarity_bound()`` of its shingles with the
template, and the bands find such a window with probability ``collision_bound()`` or
more. Candidates are verified exactly: the share of the template's shingles that occur
in the window and a quarter of a window around it. The match is the shortest part of that
with the same shingles of the template. Licenses of one family share nearly all words, so a
match must also tell the same license: the word pairs of ``TELLING`` in it (version numbers,
Lesser, NC, SA, ND and their like) are those of the template, and a whole license text holds
its phrase of ``PHRASES``. A notice whose version or terms match no template is reported
under the name of its family, without a number. Of overlapping matches whole license texts
come first, then the highest containment, then the longest, then the first name.

Windows with fewer shingles of a template than its containment needs can match nothing and
get no signature; that leaves nothing out. Templates are the argument of every function;
the default are ``TEMPLATES`` and the whole texts in the folder ``licenses``. Defined cases: a null or empty text has no matches; a text shorter than a
window is one window; repeated rows give repeated results; only ``doc_id`` and ``text``
are read. Spans count words of the text, end exclusive.
"""

from __future__ import annotations

import functools
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import wordbytes as wb
from tollgate.llm.wu_manber import Folded

SHINGLE = 2
#: The least containment, as a fraction of whole numbers.
CONTAINED = (4, 5)
BANDS, ROWS = 32, 2
PARTS = 4
#: Shingles of windows that are compared at a time.
CELLS = 1 << 17

CC = "This work is licensed under a Creative Commons"
GNU = "This work is licensed under the GNU"
PROGRAM = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation"
LATER = "{0}, either version {1} of the License, or (at your option) any later version"
GPL, AGPL, LGPL, LIBRARY = (f"{x}General Public License" for x in ("", "Affero ", "Lesser ", "Library "))
CC_TERMS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

# The wording of common license notices.
TEMPLATES = {
    "apache": 'Licensed under the Apache License',
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc": CC,
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "Released under the MIT License",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
for _terms, _long in CC_TERMS.items():
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _kind = "International" if _version == "4.0" else "Unported" if _version == "3.0" else "Generic"
        TEMPLATES[f"cc-{_terms}-{_version}" + ("" if _terms == "by" else "-notice")] = f"{CC} {_long} {_version} {_kind} License"
        TEMPLATES[f"cc-{_terms}-{_version}" + ("-line" if _terms == "by" else "")] = f"Licensed under CC {_terms.upper()} {_version}"
for _family, _long, _versions in (("gpl", GPL, ("1", "2", "3")), ("agpl", AGPL, ("3",)), ("lgpl", LGPL, ("2.1", "3")), ("lgpl", LIBRARY, ("2",))):
    _name = "lgpl-library" if _long is LIBRARY else _family
    _notice = PROGRAM.format("This library" if _family == "lgpl" else "This program", ";" if _versions == ("2",) else ":", _long)
    TEMPLATES[_name] = f"{GNU} {_long}"
    TEMPLATES[f"{_name}-notice"] = _notice
    for _version in _versions:
        _number = _version if "." in _version else f"{_version}.0"
        TEMPLATES[f"{_family}-{_number}"] = f"{GNU} {_long}, version {_version}"
        TEMPLATES[f"{_family}-{_number}-notice"] = LATER.format(_notice, _version)

#: A phrase that only this license text has.
PHRASES = {
    "apache-2.0-text": "Apache License Version 2.0",
    "bsd-3-clause-text": "Neither the name of",
    "cc0-1.0-text": "CC0 1.0 Universal",
    "gpl-1.0-text": "GNU GENERAL PUBLIC LICENSE Version 1",
    "gpl-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2",
    "gpl-3.0-text": "refers to version 3 of the GNU General Public License",
    "lgpl-2.0-text": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2",
    "lgpl-2.1-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1",
    "lgpl-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3",
    "mit-license-text": "THE SOFTWARE IS PROVIDED AS IS",
    "mpl-1.1-text": "MOZILLA PUBLIC LICENSE Version 1.1",
    "mpl-2.0-text": "Mozilla Public License Version 2.0",
    "unlicense-text": "released into the public domain",
}
_TERMS = {"by": ["nc", "sa", "nd"], "nc": ["sa", "nd"], "attribution": ["noncommercial", "sharealike", "noderivatives", "noderivs"], "noncommercial": ["sharealike", "noderivatives", "noderivs"]}
_NUMBERED = ["version", "v", "by", "nc", "sa", "nd", "attribution", "noncommercial", "sharealike", "noderivatives", "noderivs", *map(str, range(10))]
#: The word pairs that tell the licenses of a family apart, and what each tells.
TELLING = {
    **{f"{a} {b}": f"{a} {b}" for a, others in _TERMS.items() for b in others},
    **{f"{a} {n}": f"{a} {n}" for a in _NUMBERED for n in range(10)},
    **{f"{a} {b}": x for x in ("lesser", "affero", "library") for a, b in (("gnu", x), (x, "general"))},
}


@functools.cache
def whole_texts() -> dict[str, str]:
    """The license texts of the folder ``licenses``, by name; read by the driver only."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


MULTIPLIERS = wb.mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64)) | wb.U(1)


def similarity_bound() -> float:
    """The least Jaccard similarity of a template and the window nearest to a part that contains enough of it."""
    common = CONTAINED[0] / CONTAINED[1] - 1 / (2 * PARTS)
    return common / (2 - common)


def collision_bound() -> float:
    """The least probability that such a window shares a band with the template."""
    return 1 - (1 - similarity_bound() ** ROWS) ** BANDS


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and the first shingle of each text (one more than texts)."""
    folded = Folded(column)
    starts = folded.word_starts
    # a word ends at the space after it: hash the bytes from its start to the next start or end mark
    ends = np.append(starts[1:], len(folded.bytes))
    last = folded.firsts[1:][np.diff(folded.firsts) > 0] - 1
    ends[last] = folded.offsets[1:][np.diff(folded.firsts) > 0] - 1
    words = hashed(folded.bytes, starts, ends)
    counts = np.maximum(np.diff(folded.firsts) - SHINGLE + 1, 0)
    at = wb.ranges(folded.firsts[:-1], counts)
    out = words[at]
    for i in range(1, SHINGLE):
        out = wb.mix(out * wb.U(5)) + words[at + i]
    return wb.mix(out), np.concatenate([[0], np.cumsum(counts)])


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.take(wb.BYTE_VALUES, data, out=sums[1:], mode="clip")
    sums[1:] *= wb.powers(wb.MULTIPLIER, len(data))
    np.cumsum(sums[1:], out=sums[1:])
    return wb.mix((sums[ends] - sums[starts]) * wb.powers(wb.INVERSE, len(data) + 1)[starts])


def signatures(rows: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Band keys of windows, given as a matrix of shingle hashes."""
    out = np.zeros((len(rows), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.where(valid, (rows * MULTIPLIERS[k]) >> wb.U(16), wb.U(0xFFFFFFFFFFFFFFFF)).min(1)
        out[:, k // ROWS] = wb.mix(out[:, k // ROWS] * wb.U(7) + least + wb.U(k // ROWS))
    return out


class Scanner:
    """The templates of one scan, by length."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.sets: list[np.ndarray] = []
        self.telling = dict(zip(shingles(pa.array(list(TELLING), pa.string()))[0].tolist(), TELLING.values(), strict=True))
        self.told: list[set[str] | None] = []
        self.phrases: list[np.ndarray | None] = []
        sizes: dict[int, list[int]] = {}
        for number, name in enumerate(self.names):
            values, _ = shingles(pa.array([templates[name]], pa.string()))
            self.sets.append(np.unique(values))
            whole = name in PHRASES and templates[name] == whole_texts().get(name)
            self.told.append(None if whole else self.telling_of(values))
            self.phrases.append(shingles(pa.array([PHRASES[name]], pa.string()))[0] if whole else None)
            if len(values):
                sizes.setdefault(len(values), []).append(number)
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.small = np.zeros(1 << 16, bool)
        self.small[(self.all >> wb.U(48)).astype(np.int64)] = True
        self.classes = []
        for size, numbers in sorted(sizes.items()):
            keys, owners = [], []
            for number in numbers:
                own = self.sets[number][None, :]
                keys.append(signatures(own, np.ones(own.shape, bool))[0])
                owners += [number] * BANDS
            keys = np.concatenate(keys)
            order = np.argsort(keys)
            own = np.unique(np.concatenate([self.sets[n] for n in numbers]))
            least = min(-(-CONTAINED[0] * len(self.sets[n]) // CONTAINED[1]) for n in numbers)
            self.classes.append((size, keys[order], np.asarray(owners)[order], own, least))

    def hits(self, values: np.ndarray) -> np.ndarray:
        """Which shingles occur in some template."""
        out = self.small[(values >> wb.U(48)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        out[maybe] = np.isin(values[maybe], self.all)
        return out

    def matches(self, column: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
        """(first word, end word, template) of the matches of each text, in text order."""
        values, firsts = shingles(column)
        found: dict[int, list[tuple]] = {}
        hit = self.hits(values)
        if not hit.any():
            return {}
        spots = np.flatnonzero(hit)
        of_row = np.searchsorted(firsts, spots, "right") - 1
        for size, keys, owners, mine, least in self.classes:
            step = max(1, size // PARTS)
            own_hit = np.isin(values[spots], mine)
            counts = np.bincount(of_row[own_hit], minlength=len(firsts) - 1)
            rows = np.flatnonzero(counts >= least)
            if not len(rows):
                continue
            before = np.zeros(len(values) + 1, np.int64)
            before[spots[own_hit] + 1] = 1
            np.cumsum(before, out=before)
            counts = -(-np.maximum(firsts[rows + 1] - firsts[rows] - size, 0) // step) + 1
            row = np.repeat(rows, counts)
            start = np.repeat(firsts[rows], counts) + step * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
            end = np.minimum(start + size, firsts[row + 1])
            some = before[np.minimum(end + step, firsts[row + 1])] - before[np.maximum(start - step, firsts[row])] >= least
            row, start, end = row[some], start[some], end[some]
            block = max(1, CELLS // size)
            for at in range(0, len(row), block):
                some = slice(at, at + block)
                place = start[some, None] + np.arange(size)[None, :]
                valid = place < end[some, None]
                bands = signatures(values[np.minimum(place, len(values) - 1)], valid)
                low, high = np.searchsorted(keys, bands, "left"), np.searchsorted(keys, bands, "right")
                window, band = np.nonzero(high > low)
                pairs = {(w, int(owners[i])) for w, b in zip(window.tolist(), band.tolist(), strict=True) for i in range(low[w, b], high[w, b])}
                for w, number in sorted(pairs):
                    own = int(row[at + w])
                    low_, high_ = max(firsts[own], start[at + w] - step), min(firsts[own + 1], end[at + w] + step)
                    inside = np.isin(values[low_:high_], self.sets[number])
                    common = len(np.unique(values[low_:high_][inside]))
                    if CONTAINED[1] * common >= CONTAINED[0] * len(self.sets[number]):
                        a, b = shortest(values[low_:high_], inside, common)
                        # a phrase may stand before the shortest part, where its shingles occur again
                        part = values[low_:high_] if self.told[number] is None else values[low_ + a : low_ + b]
                        if self.tells(part, number):
                            share = common / len(self.sets[number])
                            shift = int(low_ - firsts[own])
                            found.setdefault(own, []).append((self.told[number] is not None, -share, -len(self.sets[number]), number, a + shift, b + shift + SHINGLE - 1))
        return {row_: self.best(spans) for row_, spans in found.items()}

    def telling_of(self, values: np.ndarray) -> set[str]:
        return {self.telling[x] for x in values.tolist() if x in self.telling}

    def tells(self, part: np.ndarray, number: int) -> bool:
        """Whether a part names the very license of a template."""
        phrase = self.phrases[number]
        if phrase is not None:
            return any((part[at : at + len(phrase)] == phrase).all() for at in np.flatnonzero(part[: len(part) - len(phrase) + 1] == phrase[0]))
        return self.telling_of(part) == self.told[number]

    @staticmethod
    def best(spans: list[tuple]) -> list[tuple[int, int, int]]:
        """Of overlapping matches whole texts first, then the highest containment, then the longest, then the first name."""
        kept: list[tuple[int, int, int]] = []
        for *_, number, low, high in sorted(set(spans)):
            if all(high <= a or low >= b for a, b, _ in kept):
                kept.append((low, high, number))
        return sorted(kept)


def shortest(values: np.ndarray, inside: np.ndarray, common: int) -> tuple[int, int]:
    """The shortest part, end exclusive, that holds all ``common`` values that are ``inside``; of equals the first."""
    at = np.flatnonzero(inside).tolist()
    own = values[at].tolist()
    held: dict[int, int] = {}
    out, low = (0, len(values) + 1), 0
    for high, value in enumerate(own):
        held[value] = held.get(value, 0) + 1
        while len(held) == common:
            if at[high] + 1 - at[low] < out[1] - out[0]:
                out = (at[low], at[high] + 1)
            held[own[low]] -= 1
            if not held[own[low]]:
                del held[own[low]]
            low += 1
    return out


RESULT = "doc_id long, n_matches long, licenses string, spans string"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """The license notices of every document: their number, distinct names, and spans as name:start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES | whole_texts() if templates is None else templates))
    names = [x.split()[0] for x in RESULT.split(", ")]

    @wb.sparing
    def task(batches):
        scanner = shared.value
        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                part = batch.slice(first, rows)
                found = scanner.matches(part.column("text"))
                listed = [[(scanner.names[n], a, b) for a, b, n in found.get(i, ())] for i in range(rows)]
                columns = [
                    part.column("doc_id"),
                    pa.array([len(x) for x in listed], pa.int64()),
                    pa.array([",".join(sorted({n for n, _, _ in x})) for x in listed]),
                    pa.array([",".join(f"{n}:{a}:{b}" for n, a, b in x) for x in listed]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, RESULT)
