"""License scans: winnowed template fingerprints pick candidates, a banded alignment measures them.

Template words are hashed in runs of ``K`` words; of every ``W`` neighbouring runs the least hash is kept. An inverted index
from hash to (template, place) travels as a broadcast: templates are a parameter table, at most ``MAX_TEMPLATE_WORDS`` words
in all, which is checked. Every text is read whole and winnowed the same way, so a shared stretch of K + W - 1 words always
shares a fingerprint; of a template shorter than that all its runs (or its one run of all words) are kept and looked up at
every place. Hits on near diagonals form a candidate place; around it the words are aligned inside a band, and the aligned
words of the template give the coverage. Nothing is shuffled.

Null and empty texts have no matches; equal templates are all reported; repeated rows are scanned each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.llm.registry import query
from workgraph.llm.tokens import ALNUM, window_hashes, word_hashes

K, W = 3, 4
#: Words an alignment may drift from the diagonal of its hits.
BAND = 8
#: Share of a template's words that must be matched.
COVERAGE = 0.75
MAX_TEMPLATE_WORDS = 1_000_000

#: License notices as their licenses word them.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                  "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
                  "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
                  "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                    "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
               "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
               "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
               "FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
               "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the kept hashes: the least of every ``window`` neighbours, the rightmost of equals; all of a shorter list."""
    if len(hashes) <= window:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views, axis=1))


class Index:
    """Templates as word hashes, and an inverted index of their fingerprints by run length."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [word_hashes(templates[n], ALNUM) for n in self.names]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have over {MAX_TEMPLATE_WORDS} words; scan them in several tables")
        #: run length -> (sorted hashes, template, place); short templates are looked up at every place, long ones where texts are winnowed.
        self.short: dict[int, tuple] = {}
        self.long: dict[int, tuple] = {}
        for kept, table in ((False, self.long), (True, self.short)):
            rows: dict[int, list] = {}
            for t, words in enumerate(self.words):
                if not len(words) or (len(words) < K + W - 1) != kept:
                    continue
                k = min(K, len(words))
                hashes = window_hashes(words, k)
                for p in (np.arange(len(hashes)) if kept else winnowed(hashes, W)).tolist():
                    rows.setdefault(k, []).append((int(hashes[p]), t, p))
            for k, found in rows.items():
                found.sort()
                table[k] = (np.array([r[0] for r in found], np.uint64), np.array([r[1] for r in found]), np.array([r[2] for r in found]))

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Rows (template, place in the text, place in the template)."""
        out = []
        for table, all_places in ((self.short, True), (self.long, False)):
            for k, (hashes, template, place) in table.items():
                own = window_hashes(words, k)
                at = np.arange(len(own)) if all_places else winnowed(own, W)
                first = np.searchsorted(hashes, own[at], side="left")
                last = np.searchsorted(hashes, own[at], side="right")
                for p, a, b in zip(at[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist()):
                    out.extend((template[i], p, place[i]) for i in range(a, b))
        return np.array(sorted(set(out)), np.int64).reshape(-1, 3)


def aligned(text: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Banded alignment (longest common subsequence near a diagonal): matched words, begin and end in the text.

    Row i of the band holds the text places i + diagonal - band .. i + diagonal + band for template word i; the moves left
    in a row are a running maximum, so that a row is a few vector operations. Of equal alignments the shortest span wins.
    """
    width = 2 * band + 1
    far = len(text) + 1
    # score packs (matches, minus begin): more matches first, then a later begin.
    best = np.zeros(width + 1, np.int64)
    top, end = 0, 0
    for i, word in enumerate(template.tolist()):
        places = np.arange(i + diagonal - band, i + diagonal + band + 1)
        inside = (places >= 0) & (places < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[places[inside]] == np.uint64(word)
        step = np.where(best[:width] == 0, far + np.clip(places, 0, far - 1), best[:width] + far)
        row = np.where(same, step, 0)
        row = np.maximum(row, best[1:])
        row = np.maximum.accumulate(row)
        fresh = same & (row == step)
        if fresh.any():
            k = int(np.argmax(np.where(fresh, row, -1)))
            if row[k] // far > top // far or (row[k] // far == top // far and row[k] > top):
                top, end = int(row[k]), int(places[k]) + 1
        best = np.append(row, 0)
    return top // far, top % far, end


def scan_text(text: str | None, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, begin, end) in word places, by begin; overlapping finds of one template give the best."""
    words = word_hashes(text, ALNUM)
    hits = index.hits(words) if len(words) else np.empty((0, 3), np.int64)
    found: dict[tuple[int, int, int], tuple[int, int]] = {}
    order = np.lexsort((hits[:, 1], hits[:, 1] - hits[:, 2], hits[:, 0]))
    last = None
    for t, p, q in hits[order].tolist():
        d = p - q
        if last is not None and last[0] == t and abs(last[1] - d) <= min(BAND, len(index.words[t]) // 3) // 2:
            continue
        last = (t, d)
        # A band narrower than the template cannot slip to another copy of it.
        matched, begin, end = aligned(words, index.words[t], d, min(BAND, max(1, len(index.words[t]) // 3)))
        if matched >= coverage * len(index.words[t]):
            found[(t, begin, end)] = (matched, begin)
    best: list[tuple[int, int, int, int]] = []
    for (t, begin, end), (matched, _) in sorted(found.items(), key=lambda x: (x[0][0], -x[1][0], x[0][2] - x[0][1], x[0][1])):
        if all(o[0] != t or end <= o[2] or begin >= o[3] for o in best):
            best.append((t, matched, begin, end))
    return sorted(((index.names[t], matched / len(index.words[t]), matched, begin, end) for t, matched, begin, end in best), key=lambda r: (r[3], r[4], r[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Per document row: id, n_words, and ``matches``, an array of (template, coverage, matched, begin, end) by begin."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))
    plain = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    match = pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = [scan_text(t.as_py(), index, coverage) for t in batch.column("text")]
            rows = [[dict(zip(["template", "coverage", "matched", "begin", "end"], m)) for m in ms] for ms in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(match))], ["doc_id", "matches"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(read, f"doc_id {kind}, matches array<struct<template:string,coverage:double,matched:bigint,begin:bigint,end:bigint>>")


@query("op1_license_scan")
def op1(spark, read):
    found = scan(read("documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.template")), ",").alias("templates"),
                        F.coalesce(F.round(F.array_max("matches.coverage"), 6), F.lit(0.0)).alias("coverage"),
                        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["begin"], m["end"])), ",").alias("spans"))
