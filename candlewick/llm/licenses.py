"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Rolling, spread, text_buffer, text_pieces, word_bounds, word_hashes

#: The public wording of common notices and licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
#: Words of a gram and grams of a winnowing window: shared runs of GRAM + WINNOW - 1 words always share a fingerprint.
GRAM, WINNOW = 3, 3
#: Words that an alignment may drift from its diagonal, and the share of a template that must match.
BAND, COVERAGE = 8, 0.8
PIECE = 1 << 20
#: Diagonals that are aligned together.
BATCH = 1024
_FOLD = np.full(256, 0x20, np.uint8)
for _b in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = LOWER[_b]


def _tokens(buf: np.ndarray, off: np.ndarray):
    """Words of letters, digits and bytes above 127, lower-cased: starts, ends, counts and hashes."""
    folded = _FOLD[buf]
    start, end, counts = word_bounds(folded, off)
    return start, end, counts, word_hashes(folded, start, end, 21)


def _grams(words: np.ndarray) -> np.ndarray:
    return Rolling(words, 23).windows(GRAM) if len(words) >= GRAM else np.zeros(0, U64)


class Index:
    """The inverted index: fingerprint to (template, place), for templates of at least GRAM words."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words, prints = list(templates), [], []
        for t, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            words = _tokens(raw, np.array([0, len(raw)]))[3]
            if len(words) < GRAM:
                raise ValueError(f"template {name} has fewer than {GRAM} words")
            self.words.append(words)
            grams = _grams(words)
            picked = {int(k + np.argmin(grams[k : k + WINNOW])) for k in range(max(1, len(grams) - WINNOW + 1))}
            prints += [(int(grams[k]), t, k) for k in sorted(picked)]
        prints.sort()
        self.keys = np.array([p[0] for p in prints], U64)
        self.template = np.array([p[1] for p in prints], np.int64)
        self.place = np.array([p[2] for p in prints], np.int64)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, template, place) of all grams that are a fingerprint."""
        low, high = np.searchsorted(self.keys, grams, "left"), np.searchsorted(self.keys, grams, "right")
        at = np.flatnonzero(high > low)
        k = spread(low[at], (high - low)[at])
        return np.repeat(at, (high - low)[at]), self.template[k], self.place[k]


def aligned_many(template: np.ndarray, words: np.ndarray, diagonal: np.ndarray, low: np.ndarray, high: np.ndarray, band: int = BAND) -> np.ndarray:
    """(matched words, first, end) of the best local alignment near each diagonal, inside words low .. high - 1: +2 a match, -1 a gap or mismatch.

    All diagonals go through the rows of their bands together.
    """
    n, wide = len(diagonal), 2 * band + 1
    before, steps = np.zeros((n, wide + 2), np.int32), np.zeros((len(template), n, wide), np.int8)
    best, row, column = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    slope, at = np.arange(wide, dtype=np.int32), np.arange(n)
    for i, t in enumerate(template):
        j = diagonal[:, None] + i + slope - band
        inside = (j >= low[:, None]) & (j < high[:, None])
        same = words[np.clip(j, 0, max(len(words) - 1, 0))] == t
        straight, down = before[:, 1:-1] + np.where(same, 2, -1).astype(np.int32), before[:, 2:] - 1
        most = np.where(inside, np.maximum(np.maximum(straight, down), 0), 0)
        score = np.where(inside, np.maximum.accumulate(most + slope, axis=1) - slope, 0)  # gaps in the template
        steps[i] = np.where(score == 0, 0, np.where(score > most, 4, np.where(straight >= down, np.where(same, 1, 2), 3)))
        before[:, 1:-1] = score
        b = score.argmax(axis=1)
        higher = score[at, b] > best
        best, row, column = np.where(higher, score[at, b], best), np.where(higher, i, row), np.where(higher, b, column)
    out = np.zeros((n, 3), np.int64)
    for k in np.flatnonzero(best):
        i, b, matched = int(row[k]), int(column[k]), 0
        first = end = int(diagonal[k]) + i + b - band
        while i >= 0 and 0 <= b < wide and (m := steps[i, k, b]):
            if m <= 2:
                matched += m == 1
                first = int(diagonal[k]) + i + b - band
                i -= 1
            elif m == 3:
                i, b = i - 1, b + 1
            else:
                b -= 1
        out[k] = matched, first, end + 1
    return out


def aligned(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """As ``aligned_many``, for one diagonal and all words."""
    matched, first, end = aligned_many(template, words, np.array([diagonal]), np.array([0]), np.array([len(words)]), band)[0].tolist()
    return matched, first, end


def found_in(index: Index, words: np.ndarray, first: np.ndarray, counts: np.ndarray, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(text, template, matched, first word, end word) of each place where a template matches well enough, without overlaps of one template in a text."""
    position, template, place = index.hits(_grams(words))
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[position] == text[position + GRAM - 1]
    position, template, place = position[inside], template[inside], place[inside]
    out = []
    for t in np.unique(template):
        own = template == t
        pairs = np.unique(np.stack([text[position[own]], position[own] - place[own]], 1), axis=0)
        picked, last = [], (-1, 0)
        for x, d in pairs.tolist():  # one diagonal stands for those close behind it
            if x != last[0] or d - last[1] > BAND // 2:
                picked.append((x, d))
                last = (x, d)
        size, seen = len(index.words[t]), []
        for a in range(0, len(picked), BATCH):
            x, d = np.array(picked[a : a + BATCH], np.int64).reshape(-1, 2).T
            found = aligned_many(index.words[t], words, d, first[x], first[x] + counts[x])
            seen += [(int(x[k]), -int(m), int(b), int(e)) for k, (m, b, e) in enumerate(found) if m >= coverage * size]
        taken: list[tuple[int, int]] = []
        of = -1
        for x, m, b, e in sorted(seen):
            if x != of:
                of, taken = x, []
            k = bisect.bisect(taken, (b, e))
            if (k == 0 or taken[k - 1][1] <= b) and (k == len(taken) or taken[k][0] >= e):
                taken.insert(k, (b, e))
                out.append((x, int(t), -m, b, e))
    return sorted(out)


SCHEMA = "doc_id long, template string, matched long, coverage double, start_char long, end_char long"


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, template, matched, coverage, start_char, end_char) for every license passage in ``docs`` (doc_id, text).

    ``matched`` counts the template's words in the alignment, ``coverage`` is their share, and the span is given in code
    points of the whole text. One row for each place; null and empty texts have none, repeated rows have theirs again, a null doc_id stays
    null, and further columns are ignored. Of places of one template that overlap, the one with most matched words counts, of equal ones the first. The templates
    are a parameter and their index goes to every task with the code; documents are read once and nothing is shuffled.
    """
    templates = templates or TEMPLATES

    def run(batches):
        index = Index(templates)
        for batch in batches:
            for piece in text_pieces(batch, "text", PIECE):
                buf, off = text_buffer(piece.column("text"))
                start, end, counts, words = _tokens(buf, off)
                first = np.cumsum(counts) - counts
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                out = []
                for d, t, matched, a, b in found_in(index, words, first, counts, coverage):
                    spans = [int(chars[byte] - chars[off[d]]) for byte in (start[a], end[b - 1])]
                    out.append((d, index.names[t], matched, matched / len(index.words[t]), *spans))
                ids = piece.column("doc_id").take(pa.array([x[0] for x in out], pa.int64()))
                kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([x[k + 1] for x in out], kind) for k, kind in enumerate(kinds)]], names=["doc_id", "template", "matched", "coverage", "start_char", "end_char"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, SCHEMA)
