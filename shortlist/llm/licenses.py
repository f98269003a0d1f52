"""License scan by patience alignment of documents with license texts.

Words that occur once in the text and once in the template are anchors; their longest increasing
subsequence fixes the alignment, and the gaps between anchors are aligned the same way, after common
words at their ends are matched. Coverage is the share of the template's words that are matched.

A template of L words is compared with the stretches of 3 L words that begin every L words, so each
occurrence of up to 2 L words lies whole in one. A stretch is skipped only if it cannot reach the
coverage: it lacks all of a set of template words of which a match needs one, or shares too few words
counted with repeats. Templates are a bounded parameter.

Defined results: null or wordless texts match nothing; repeated documents are each returned; a null
doc_id is returned as null; of equally good stretches the first is reported; no rows give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shortlist.llm.common import read
from shortlist.llm.registry import query

MIN_COVERAGE = 0.8

# Public license notices and the opening terms of public licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License",
}

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops, top_at, before = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(top_at[pile - 1] if pile else None)
        if pile == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = v, i
    out, at = [], top_at[-1] if top_at else None
    while at is not None:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (in text, in template), increasing in both."""
    matched = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if mine[w] == 1 and theirs.get(w) == 1}
        anchors = [(where[w], j) for j, w in enumerate(template[c:d], c) if w in where]
        if not anchors:
            continue
        last_a, last_c = a, c
        for k in _increasing([i for i, _ in anchors]):
            i, j = anchors[k]
            matched.append((i, j))
            gaps.append((last_a, i, last_c, j))
            last_a, last_c = i + 1, j + 1
        gaps.append((last_a, b, last_c, d))
    return sorted(matched)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        total = Counter(w for t in templates.values() for w in words_of(t))
        self.templates = []
        for name, text in templates.items():
            words = words_of(text)
            if not words:
                continue
            spare = len(words) - int(-(-len(words) * coverage // 1)) + 1  # a match misses fewer words than this
            # long words that few templates use are rare in prose; any choice is exact
            needed = set(sorted(words, key=lambda w: (total[w], -len(w), w))[:spare])
            counts = Counter(words)
            needed |= {w for w in words if counts[w] > 1 and w in needed}
            self.templates.append((name, words, counts, frozenset(needed)))
        self.any_needed = frozenset(w for *_, needed in self.templates for w in needed)

    def scan(self, text: str | None) -> list[tuple]:
        """(license, coverage, first word, words spanned, matched words) of each license found."""
        words = words_of(text)
        if self.any_needed.isdisjoint(words):
            return []
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.any_needed:
                at.setdefault(w, []).append(i)
        out = []
        for name, template, counts, needed in self.templates:
            size = len(template)
            stretches = {k for w in needed for i in at.get(w, ()) for k in (i // size, i // size - 1, i // size - 2) if k >= 0}
            best = None
            for k in sorted(stretches):
                part = words[k * size : (k + 3) * size]
                have = Counter(part)
                if sum(min(n, have[w]) for w, n in counts.items()) < self.coverage * size:
                    continue
                pairs = align(part, template)
                share = len(pairs) / size
                if share >= self.coverage and (best is None or share > best[1]):
                    first, last = pairs[0][0], pairs[-1][0]
                    best = (name, share, k * size + first, last - first + 1, len(pairs))
            if best:
                out.append(best)
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per document and license found; a single pass over whole texts."""
    scanner = Scanner(templates, coverage)
    names = ["doc_id", "license", "coverage", "first_word", "span_words", "matched_words"]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in scanner.scan(t)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, license string, coverage double, first_word long, span_words long, matched_words long"
    )


@query("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))
