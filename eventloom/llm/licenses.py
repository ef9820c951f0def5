"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import with_key
from eventloom.llm.textvec import ALNUM_WORD, LOWER, buffers, chunks, grams, hashes, mix, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 1
#: Template tables are sent to every task, so they are bounded: this many code points in all are an error to exceed.
MOST_CHARS = 64_000_000

#: Short forms of public licenses.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-line-licensed": "Licensed under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-sentence": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, index of its first word, word starts, word ends, document of each word), for lower-cased alphanumeric words."""
    starts, ends, doc = words(data, off, ALNUM_WORD)
    g, at = grams(hashes(LOWER[data], starts, ends), doc, n)
    return g, at, starts, ends, doc


def seeds(bands: int, rows: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)


def signatures(g: np.ndarray, lo: np.ndarray, hi: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys [windows, bands] of the shingles g[lo:hi] of each window, from the least of each permutation."""
    out = np.zeros((len(lo), bands), np.uint64)
    flat = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi)])
    first = np.cumsum(hi - lo) - (hi - lo)
    for k, s in enumerate(seeds(bands, rows)):
        out[:, k // rows] = mix(out[:, k // rows] + np.minimum.reduceat(mix(g[flat] ^ s), first) + np.uint64(k))
    return out


class Templates:
    """The templates' shingle sets and band keys, in one length class for each number of shingles."""

    def __init__(self, texts: dict[str, str], n: int, bands: int, rows: int):
        if sum(map(len, texts.values())) > MOST_CHARS:
            raise ValueError(f"templates of more than {MOST_CHARS} code points")
        self.names = sorted(texts)
        self.sets: list[np.ndarray] = []
        self.classes: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, name in enumerate(self.names):
            raw = np.frombuffer(texts[name].encode(), np.uint8)
            g = shingles(raw, np.array([0, len(raw)]), n)[0]
            if not len(g):
                raise ValueError(f"template {name} has fewer than {n} words")
            self.sets.append(np.unique(g))
            for band, key in enumerate(signatures(g, np.array([0]), np.array([len(g)]), bands, rows)[0]):
                self.classes[len(g)][band, int(key)].append(t)
        self.all = np.unique(np.concatenate(self.sets))
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.all & np.uint64(0xFFFF)).astype(np.int64)] = True

    def known(self, g: np.ndarray) -> np.ndarray:
        """Whether each shingle is of some template."""
        out = self.low[(g & np.uint64(0xFFFF)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = self.all[np.minimum(np.searchsorted(self.all, g[at]), len(self.all) - 1)] == g[at]
        return out


def template_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(name, text) of the templates: the short forms given here, or a table of full license texts at a path."""
    if path is not None:
        return spark.read.parquet(path).select("name", "text")
    return spark.createDataFrame(sorted(TEMPLATES.items()), "name string, text string")


def given(templates: dict[str, str] | DataFrame) -> dict[str, str]:
    """Templates by name; a table of them is gathered only if its counted code points are within MOST_CHARS."""
    if isinstance(templates, dict):
        return templates
    rows = templates.select("name", "text").where("name IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MOST_CHARS:
        raise ValueError(f"templates of more than {MOST_CHARS} code points")
    return {r.name: r.text for r in rows.orderBy("name", "text").collect()}


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, n: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, template, start, end (code points of the first word's start and the last word's end) and containment of every match, and _k_id, _k_rid.

    For each number of shingles among the templates, windows of so many shingles overlap by three quarters or more (all starts, for
    up to eight). A window that agrees in a band with a template of its class retrieves it: with 24 bands of one row a pair of
    Jaccard similarity 0.3 is retrieved with probability above 0.9998, and a window that has no shingle of any template can agree
    with none and is not hashed. A retrieved template matches if the share of its distinct shingles in the window, moved to the
    start that holds most of them, is at least `similarity`. Of matches that overlap, of one template or of several, the one with
    the most shingles of its template stays, then the one with the higher share, then the first by name. Null and empty texts match
    nothing, null ids are ids like others; rows equal in id and text give equal matches; columns other than doc_id and text are not
    used; an empty table gives no rows. templates: by name, or a table of (name, text) of bounded size.
    """
    known = Templates(given(templates), n, bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(2))
            out: list[tuple] = []
            for lo, hi in chunks(off):
                d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                g, at, starts, ends, doc = shingles(d, o, n)
                hit = np.flatnonzero(known.known(g)) if len(g) else np.zeros(0, np.int64)
                if len(hit):
                    for k, t, x, y, share in matches(known, g, doc[at], hit, similarity, bands, rows):
                        base = o[k]
                        chars = np.cumsum((d[base : o[k + 1]] & 0xC0) != 0x80)
                        first, last = starts[at[x]] - base, ends[at[y - 1] + n - 1] - base
                        out.append((lo + k, known.names[t], int(chars[first]) - 1, int(chars[last - 1]), share))
            rows_ = [r[0] for r in out]
            cols = [b.column(0).take(pa.array(rows_, pa.int64())), b.column(1).take(pa.array(rows_, pa.int64()))]
            cols += [pa.array([r[k] for r in out], t) for k, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["_k_id", "_k_rid", "template", "start", "end", "containment"])

    found = with_key(docs).select("_k_id", "_k_rid", "text").mapInArrow(run, "_k_id long, _k_rid long, template string, start long, end long, containment double")
    return found.withColumn("doc_id", F.when(F.col("_k_id") != -(2**63), F.col("_k_id")))


def matches(known: Templates, g: np.ndarray, doc: np.ndarray, hit: np.ndarray, similarity: float, bands: int, rows: int) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, template, first shingle, end of shingles, containment) in documents of concatenated shingles."""
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))), [len(doc)]))
    found: list[tuple[int, int, int, int, float]] = []
    for size, index in known.classes.items():
        step = 1 if size <= 8 else max(1, size // 4)
        # The windows that hold a known shingle; they start at multiples of the step in their document, or end with it.
        first = edge[np.searchsorted(edge, hit, "right") - 1]
        last = edge[np.searchsorted(edge, hit, "right")]
        starts = set()
        for h, f, e in zip(hit, first, last):
            top = max(f, e - size)
            k = max(0, -(-(h - size + 1 - f) // step))
            while (s := f + k * step) <= h and s <= top:
                starts.add(int(s))
                k += 1
            if h >= top:
                starts.add(int(top))
        if not starts:
            continue
        lo = np.array(sorted(starts))
        hi = np.minimum(lo + size, edge[np.searchsorted(edge, lo, "right")])
        for w, sig in enumerate(signatures(g, lo, hi, bands, rows)):
            for t in {t for band, key in enumerate(sig) for t in index.get((band, int(key)), ())}:
                want = known.sets[t]
                a = max(edge[np.searchsorted(edge, lo[w], "right") - 1], lo[w] - size)
                z = min(edge[np.searchsorted(edge, lo[w], "right")], hi[w] + size)
                inside = np.isin(g[a:z], want)
                ends = range(min(size, z - a), z - a + 1)
                x = max((e - min(size, z - a) for e in ends), key=lambda s: (len(np.unique(g[a + s : a + s + size][inside[s : s + size]])), -s))
                share = len(np.unique(g[a + x : a + x + size][inside[x : x + size]])) / len(want)
                if share >= similarity:
                    found.append((int(doc[lo[w]]), t, int(a + x), int(min(z, a + x + size)), share))
    found.sort(key=lambda m: (m[0], -round(m[4] * len(known.sets[m[1]])), -m[4], m[1], m[2]))
    taken: list[tuple[int, int]] = []  # of one document, sorted and disjoint
    last = None
    for m in found:
        if m[0] != last:
            taken, last = [], m[0]
        k = bisect.bisect_left(taken, (m[2], m[2]))
        if (k == 0 or taken[k - 1][1] <= m[2]) and (k == len(taken) or m[3] <= taken[k][0]):
            taken.insert(k, (m[2], m[3]))
            yield m


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text"), template_table(docs.sparkSession)).select("doc_id", "template", "start", "end", F.round("containment", 6).alias("containment"))
