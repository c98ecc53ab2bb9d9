"""Licence scans: a trained paragraph classifier, confirmed against templates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.sample import bounded_sample
from brindle.llm.text import mix, prefix, runs, span_hash, text_blocks, words

# Notices and leading passages of public licences, by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Apache License Version 2.0, January 2004",
        "This project is released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Licensed under the GNU GPL, version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the 3-clause BSD License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Available under the Creative Commons Attribution license, CC BY 3.0."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "For non-commercial use only, under CC BY-NC 3.0."],
    "Public-Domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0."],
}
FAMILIES = ["unknown", *TEMPLATES]
ORDERS = 3
#: Lines of a wrapped notice that are read together.
WRAP = 4
MATCHES = "doc_id long, n_paragraphs long, matches array<struct<line_no:int,end_line:int,family:string,probability:double,similarity:double>>"
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[10] = 10
_PLAIN[np.arange(128, 256)] = np.arange(128, 256)
for _a, _b, _shift in ((48, 57, 0), (97, 122, 0), (65, 90, 32)):
    _PLAIN[_a : _b + 1] = np.arange(_a, _b + 1) + _shift


@dataclass(frozen=True)
class Model:
    """Weights of each n-gram bucket for each family, and the least probability of a family that counts."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


@dataclass
class Paragraphs:
    """n-gram hashes of all paragraphs of a block of texts: lines with a word, or several such lines in a row."""

    doc: np.ndarray
    line_no: np.ndarray
    end_line: np.ndarray
    first: np.ndarray
    end: np.ndarray
    grams: list[np.ndarray]


def paragraphs(data: np.ndarray, off: np.ndarray) -> Paragraphs:
    """Words are runs of letters and digits in lower case; an n-gram lies within one line."""
    plain = _PLAIN[data]
    s, e, _ = words(plain, off)
    newline = np.flatnonzero(plain == 10)
    doc = np.searchsorted(off, s, side="right") - 1
    line = np.searchsorted(newline, s)
    a, b = runs(doc * (len(newline) + 1) + line)
    line_no = line[a] - np.searchsorted(newline, off[doc[a]]) if len(a) else line
    one = span_hash(prefix(plain), s, e) if len(s) else np.zeros(0, np.uint64)
    grams, acc = [one], one
    for k in range(1, ORDERS):
        acc = mix(acc[:-1] * np.uint64(0x100000001B3) + one[k:]) if len(acc) else acc
        grams.append(acc)
    return Paragraphs(doc[a] if len(a) else doc, line_no, line_no, a, b, grams)


def wrapped(p: Paragraphs, wrap: int = WRAP) -> Paragraphs:
    """The runs of 2 to ``wrap`` lines of one text that follow each other without an empty line; n-grams cross their line ends."""
    at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(1, wrap):
        i = np.arange(max(0, len(p.doc) - n))
        i = i[(p.doc[i] == p.doc[i + n]) & (p.line_no[i + n] - p.line_no[i] == n)]
        at.append(i)
        to.append(i + n)
    i, j = np.concatenate(at), np.concatenate(to)
    return Paragraphs(p.doc[i], p.line_no[i], p.line_no[j], p.first[i], p.end[j], p.grams)


def logits(p: Paragraphs, model_weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores of each paragraph: the sum of its n-grams' weights over the root of their number."""
    n = len(model_weights)
    total = np.zeros((len(p.first), len(bias)))
    count = np.zeros(len(p.first))
    for k, g in enumerate(p.grams):
        here = np.maximum(p.end - p.first - k, 0)
        if not len(g) or not here.any():
            continue
        w = model_weights[(g % np.uint64(n)).astype(np.int64)].astype(np.float64)
        sums = np.concatenate([np.zeros((1, len(bias))), np.cumsum(w, axis=0)])
        total += sums[np.minimum(p.first + here, len(g))] - sums[np.minimum(p.first, len(g))]
        count += here
    return total / np.sqrt(np.maximum(1, count))[:, None] + bias


def _block(texts: list[str]) -> Paragraphs:
    raw = [t.replace("\n", " ").encode() for t in texts]
    return paragraphs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def _pairs(p: Paragraphs, k: int) -> np.ndarray:
    """Distinct word pairs of paragraph ``k``, its words if it has only one."""
    a, b = int(p.first[k]), int(p.end[k])
    return np.unique(p.grams[1][a : b - 1]) if b - a > 1 else np.unique(p.grams[0][a:b])


_SHAPES: dict[str, list[np.ndarray]] = {}


def template_similarity(p: Paragraphs, k: int, family: str) -> float:
    """Share of the smaller one's word pairs that the paragraph and the family's nearest template have in common."""
    if not _SHAPES:
        for name, texts in TEMPLATES.items():
            block = _block(texts)
            _SHAPES[name] = [_pairs(block, i) for i in range(len(texts))]
    mine = _pairs(p, k)
    return max(len(np.intersect1d(mine, t, assume_unique=True)) / min(len(mine), len(t)) for t in _SHAPES[family])


def _examples(rng: np.random.Generator, copies: int) -> tuple[list[str], list[int]]:
    """Edited templates of each family, and templates' words in random order as unknown."""
    texts, labels = [], []
    for f, family in enumerate(TEMPLATES, 1):
        for t in TEMPLATES[family]:
            w = t.split()
            for k in range(copies):
                cut = w
                if k and len(w) > 12 and rng.random() < 0.6:
                    n = int(rng.integers(8, len(w)))
                    at = int(rng.integers(0, len(w) - n + 1))
                    cut = w[at : at + n]
                cut = [x for x in cut if not k or rng.random() > 0.06] or w
                texts.append(" ".join(cut))
                labels.append(f)
                if k % 3 == 0:
                    texts.append(" ".join(rng.permutation(w)[: int(rng.integers(1, len(w) + 1))]))
                    labels.append(0)
    return texts, labels


def train_licence_model(docs: DataFrame, *, max_negative_docs: int = 300, copies: int = 12, n_buckets: int = 1 << 16, epochs: int = 25, rate: float = 1.0, false_rate: float = 0.001, seed: int = 13) -> Model:
    """Fit by stochastic gradient descent on edited templates, and on unlabelled paragraphs as the unknown class.

    These are the lines, and the lines taken WRAP at a time, of a bounded sample of at most ``max_negative_docs`` documents chosen by
    a hash of the row (whole texts), without paragraphs that resemble a template. A fifth of all examples sets the temperature, and the least probability at which
    at most ``false_rate`` of the unknown ones would pass.
    """
    rng = np.random.default_rng(seed)
    rows = bounded_sample(docs.where("text is not null").select("doc_id", "text"), max_negative_docs, seed)
    other = []
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text)):
        found = r.text.split("\n")
        other += [x for x in found + ["\n".join(found[k : k + WRAP]) for k in range(0, len(found) - 1, WRAP)] if any(map(str.isalnum, x))]
    block = _block(other) if other else None
    other = [other[block.doc[k]] for k in range(len(block.first)) if max(template_similarity(block, k, f) for f in TEMPLATES) < 0.5] if other else []
    texts, labels = _examples(rng, copies)
    texts, y = texts + other, np.asarray(labels + [0] * len(other))
    p = _block(texts)
    y = y[p.doc]
    features = []
    for a, b in zip(p.first.tolist(), p.end.tolist()):
        f, c = np.unique(np.concatenate([p.grams[k][a : max(a, b - k)] for k in range(ORDERS)]) % np.uint64(n_buckets), return_counts=True)
        features.append((f.astype(np.int64), (c / np.sqrt(c.sum())).astype(np.float32)))
    order = rng.permutation(len(y))
    hold, fit = order[: len(y) // 5], order[len(y) // 5 :]
    w, bias = np.zeros((n_buckets, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    weight = np.where(y == 0, min(1.0, 2 * (y > 0).sum() / max(1, (y == 0).sum())), 1.0)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit).tolist():
            at, x = features[i]
            z = x @ w[at] + bias
            q = np.exp(z - z.max())
            q /= q.sum()
            q[y[i]] -= 1
            q *= step * weight[i]
            w[at] -= np.outer(x, q) + 1e-5 * step * w[at]
            bias -= 0.1 * q
    z = np.stack([features[i][1] @ w[features[i][0]] + bias for i in hold]).astype(float)
    truth = y[hold]

    def softmax(t: float) -> np.ndarray:
        q = np.exp(z / t - (z / t).max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)

    t = float(min(np.geomspace(0.3, 10, 40), key=lambda t: -np.log(softmax(t)[np.arange(len(truth)), truth] + 1e-12).mean()))
    wrong = np.sort(softmax(t)[truth == 0, 1:].max(1)) if (truth == 0).any() else np.zeros(1)
    return Model(w, bias, t, float(np.clip(wrong[int((1 - false_rate) * (len(wrong) - 1))], 0.5, 0.9)))


def _licensed(p: Paragraphs, model: Model, least_similarity: float, skip: np.ndarray | None = None) -> list[tuple[int, int, float, float]]:
    """(paragraph, family, probability, similarity) of those that the model names and a template confirms."""
    z = logits(p, model.weights, model.bias) / model.temperature
    q = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    q /= q.sum(1, keepdims=True)
    best, sure = q.argmax(1), q.max(1, initial=0)
    named = (best > 0) & (sure >= model.least)
    out = []
    for k in np.flatnonzero(named if skip is None else named & ~skip).tolist():
        alike = template_similarity(p, k, FAMILIES[best[k]])
        if alike >= least_similarity:
            out.append((k, int(best[k]), float(sure[k]), float(alike)))
    return out


def _matches(p: Paragraphs, model: Model, least_similarity: float, wrap: int) -> dict[int, list[dict]]:
    """Matches of each document of a block, in order of lines: single lines first, then runs of lines that meet no other
    match, the surest first, of equals the shorter and the earlier."""
    found: dict[int, list[dict]] = {}
    taken = np.zeros(len(p.doc) + 1, np.int64)

    def add(q: Paragraphs, hit: tuple[int, int, float, float]) -> None:
        k, family, sure, alike = hit
        found.setdefault(int(q.doc[k]), []).append({"line_no": int(q.line_no[k]), "end_line": int(q.end_line[k]), "family": FAMILIES[family], "probability": sure, "similarity": alike})

    for hit in _licensed(p, model, least_similarity):
        taken[hit[0]] = 1
        add(p, hit)
    several = wrapped(p, wrap)
    if len(several.doc):
        upto = np.concatenate([[0], np.cumsum(taken)])
        i, j = np.searchsorted(p.first, several.first), np.searchsorted(p.end, several.end)
        hits = _licensed(several, model, least_similarity, upto[j + 1] > upto[i])
        for hit in sorted(hits, key=lambda h: (-h[2], j[h[0]] - i[h[0]], i[h[0]])):
            lines = slice(i[hit[0]], j[hit[0]] + 1)
            if not taken[lines].any():
                taken[lines] = 1
                add(several, hit)
    return {d: sorted(m, key=lambda x: x["line_no"]) for d, m in found.items()}


def scan_licences(docs: DataFrame, model: Model, *, least_similarity: float = 0.6, wrap: int = WRAP) -> DataFrame:
    """Licence paragraphs of every whole text: (doc_id, n_paragraphs, matches), a map without a shuffle.

    docs: doc_id, text; other columns are ignored. A paragraph is a line with a letter or digit; where no such line is enough, also
    2 to ``wrap`` of them in a row, for notices wrapped at line ends. One whose best family passes the model's bound is a
    match if its word pairs also agree with a template of that family by ``least_similarity``; all else is unknown. Matches carry their first and last
    line and do not overlap; of a longer notice several runs may match. n_paragraphs counts lines. Null and empty texts have none.
    Repeated rows each get a row. The model is of a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for i, j, data, off in text_blocks(batch):
                p = paragraphs(data, off)
                if len(p.first):
                    counts[i:j] = np.bincount(p.doc, minlength=j - i)
                    for d, matches in _matches(p, shared.value, least_similarity, wrap).items():
                        found[i + d] = matches
            kind = pa.list_(pa.struct([("line_no", pa.int32()), ("end_line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)
