"""License scans: a paragraph classifier, its predictions confirmed against templates.

1. Templates are the notices and the names below, the names set into statements
   ("this software is licensed under ..."). Features are their two- and
   three-word strings, sparse. A softmax regression over the families and
   "unknown" is trained on variations of the templates (words dropped, ends cut,
   other words around) and, as unknown, on paragraphs of a bounded sample of
   documents, on sentences that mix license words out of order, and on scraps of
   two or three words of a template.
2. On variations that were held back, a temperature is fitted to the
   probabilities, so that they mean what they say, and the least probability at
   which a family is believed.
3. A prediction stands if the paragraph holds CONFIRM of the three-word strings
   of one of the family's templates, or is made up of them to that share, and has
   a string of two or three words that only this family's templates have.

A paragraph without any known string has the intercepts' class, which training
holds at unknown; so whole texts are searched for known word pairs first, and
only paragraphs that have one are scored. A paragraph is a line.

The sample: paragraphs of the first SAMPLE documents by a hash, PARAGRAPHS of each,
train the unknown class; both bounds are parameters of training, whole texts of
all documents are scanned.

Defined results: null and empty texts give no row; very long texts are scanned
whole; of families that are equally likely the first of CLASSES counts; rows of one
doc_id are one document, whose paragraphs add up; a null doc_id is a value like any
other; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents whose paragraphs train the unknown class, and paragraphs of each, at most; variations of a family's templates.
SAMPLE, PARAGRAPHS, VARIATIONS = 400, 10, 400
#: The share of a template's three-word strings that confirms.
CONFIRM = 0.5
UNKNOWN = "unknown"

# Names of licenses, their SPDX identifiers, and notices by which works name them.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("the MIT license",),
    "Apache": ("the Apache License, Version 2.0", "the Apache 2.0 license", "Apache License 2.0"),
    "GPL": ("the GNU General Public License, version 3", "the GNU General Public License version 2", "the GNU GPL v3", "the GNU GPL"),
    "LGPL": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License version 3", "the GNU LGPL v3"),
    "AGPL": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3"),
    "BSD": ("the BSD 3-Clause License", "the BSD 2-Clause License", "the new BSD license", "a BSD-style license"),
    "MPL": ("the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0", "MPL 2.0"),
    "EPL": ("the Eclipse Public License, version 2.0", "the Eclipse Public License v1.0"),
    "ISC": ("the ISC license",),
    "Unlicense": ("the Unlicense",),
    "CC-BY-NC": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons BY-NC license"),
    "CC-BY-SA": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC0": ("CC0 1.0", "the CC0 1.0 Universal public domain dedication"),
}
SPDX: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT",),
    "Apache": ("Apache-2.0",),
    "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "MPL": ("MPL-2.0",),
    "EPL": ("EPL-1.0", "EPL-2.0"),
    "ISC": ("ISC",),
    "Unlicense": ("Unlicense",),
    "CC-BY-NC": ("CC-BY-NC-4.0",),
    "CC-BY-SA": ("CC-BY-SA-4.0",),
    "CC-BY": ("CC-BY-4.0",),
    "CC0": ("CC0-1.0",),
}
STATEMENTS = (
    "Licensed under {}.",
    "This software is licensed under {}.",
    "This work is licensed under {}.",
    "Distributed under the terms of {}.",
    "Released under {}, see the LICENSE file for details.",
    "Use of this source code is governed by {} that can be found in the LICENSE file.",
    "This file is made available under {}.",
)
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",),
    "Apache": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind",
    ),
    "GPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "AGPL": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at",),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "This work is dedicated to the public domain"),
    "Proprietary": (
        "All rights reserved.",
        "No part of this work may be reproduced without the prior written permission of the publisher.",
        "This document is confidential and proprietary. Unauthorized copying or distribution is prohibited.",
    ),
}
TEMPLATES: dict[str, tuple[str, ...]] = {
    f: (*(line.format(n) for n in NAMES.get(f, ()) for line in STATEMENTS), *(f"SPDX-License-Identifier: {i}" for i in SPDX.get(f, ())), *NOTICES.get(f, ()))
    for f in (*NAMES, "Proprietary")
}
CLASSES = (*TEMPLATES, UNKNOWN)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(ws: list[str], n: int) -> list[tuple[str, ...]]:
    return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]


@dataclass
class Model:
    """place: of each known string; weights: strings (and last the intercepts) by classes."""

    place: dict[tuple[str, ...], int]
    weights: np.ndarray
    temperature: float = 1.0
    least: float = 0.5
    templates: dict[str, list[frozenset]] = field(default_factory=dict)
    #: Strings that the templates of one family only have.
    own: dict[str, frozenset] = field(default_factory=dict)

    def probabilities(self, paragraphs: list[list[str]]) -> np.ndarray:
        z = np.repeat(self.weights[-1:], len(paragraphs), axis=0)
        for i, ws in enumerate(paragraphs):
            # In one order everywhere, so that the sums are the same to the last digit.
            known = sorted(p for g in {*_grams(ws, 2), *_grams(ws, 3)} if (p := self.place.get(g)) is not None)
            if known:
                z[i] += self.weights[known].sum(axis=0)
        z /= self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def similarity(self, family: str, ws: list[str]) -> float:
        """The larger share, of a template's three-word strings or of the paragraph's, that both have."""
        own = frozenset(_grams(ws, 3))
        if not own or self.own[family].isdisjoint([*own, *_grams(ws, 2)]):
            return 0.0
        return max(max(len(own & t) / len(t), len(own & t) / len(own)) for t in self.templates[family])

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """The family (or unknown), its probability, and the similarity that confirmed it."""
        ws = words(paragraph)
        p = self.probabilities([ws])[0]
        best = int(p.argmax())
        if CLASSES[best] == UNKNOWN or p[best] < self.least:
            return UNKNOWN, float(p[-1]), 0.0
        similarity = self.similarity(CLASSES[best], ws)
        return (CLASSES[best], float(p[best]), similarity) if similarity >= CONFIRM else (UNKNOWN, float(p[-1]), similarity)


def _variation(ws: list[str], filler: list[str], rng: np.random.Generator) -> list[str]:
    """Words dropped (one in twelve), an end cut (of long ones), others around."""
    out = [w for w in ws if rng.random() > 1 / 12]
    if len(out) > 12:
        cut = int(rng.integers(0, len(out) // 3))
        out = out[cut:] if rng.random() < 0.5 else out[: len(out) - cut]
    around = rng.integers(0, 9, 2)
    pick = lambda n: [filler[int(i)] for i in rng.integers(0, len(filler), n)] if filler else []
    return [*pick(around[0]), *out, *pick(around[1])]


def train(paragraphs: list[str], seed: int = 5) -> Model:
    """A model; paragraphs: examples of the unknown class."""
    rng = np.random.default_rng(seed)
    known = {f: [words(t) for t in ts] for f, ts in TEMPLATES.items()}
    place: dict[tuple[str, ...], int] = {}
    for ts in known.values():
        for ws in ts:
            for g in (*_grams(ws, 2), *_grams(ws, 3)):
                place.setdefault(g, len(place))
    plain = [words(p) for p in paragraphs]
    pieces = [w for ts in known.values() for ws in ts for w in ws]
    # Paragraphs that themselves name a license do not teach the unknown class.
    plain = [ws for ws in plain if not any(g in place for g in _grams(ws, 3))]
    filler = sorted({w for ws in plain for w in ws}) or pieces
    examples, labels = [], []
    for k, ts in enumerate(known.values()):
        each = max(4, VARIATIONS // len(ts))
        for ws in ts:
            for v in range(each):
                examples.append(ws if v < each // 4 else _variation(ws, filler, rng))
                labels.append(k)
    mixed = [[pieces[int(i)] for i in rng.integers(0, len(pieces), rng.integers(4, 30))] for _ in range(600)]
    # Two or three words of a notice are not one, unless they are a whole one.
    whole = {tuple(ws) for ts in known.values() for ws in ts}
    family_of: dict[tuple[str, ...], set[str]] = {}
    for f, ts in known.items():
        for ws in ts:
            for g in (*_grams(ws, 2), *_grams(ws, 3)):
                family_of.setdefault(g, set()).add(f)
    scraps = [
        [*ws[int(a) : int(a) + 3], *(filler[int(i)] for i in rng.integers(0, len(filler), 12))]
        for ts in known.values() for ws in ts for a in rng.integers(0, max(1, len(ws) - 3), 3)
        if tuple(ws[int(a) : int(a) + 3]) not in whole and len(family_of.get(tuple(ws[int(a) : int(a) + 3]), ())) != 1
    ]
    for ws in [*plain, *mixed, *scraps, []]:
        examples.append(ws)
        labels.append(len(CLASSES) - 1)
    y = np.array(labels)
    x = np.zeros((len(examples), len(place) + 1), np.float32)
    x[:, -1] = 1
    for i, ws in enumerate(examples):
        for g in {*_grams(ws, 2), *_grams(ws, 3)}:
            if g in place:
                x[i, place[g]] = 1
    held = rng.random(len(y)) < 0.2
    w = np.zeros((x.shape[1], len(CLASSES)), np.float32)
    goal = np.eye(len(CLASSES), dtype=np.float32)[y]
    # Each class weighs alike.
    share = (1.0 / np.bincount(y[~held], minlength=len(CLASSES)).clip(1))[y].astype(np.float32) / len(CLASSES)
    share[held] = 0
    step = np.zeros_like(w)
    for _ in range(300):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step = 0.9 * step + x.T @ ((goal - p) * share[:, None]) - 1e-5 * w
        w += 2.0 * step
    # Without any known string the answer has to be unknown.
    w[-1, -1] = max(w[-1, -1], w[-1, :-1].max() + 2.0)
    model = Model(place, w, templates={f: [t for ws in ts if (t := frozenset(_grams(ws, 3)))] for f, ts in known.items()}, own={f: frozenset(g for g, fs in family_of.items() if fs == {f}) for f in known})
    if held.any():
        z, truth = x[held] @ w, y[held]

        def loss(t: float) -> float:
            e = z / t - (z / t).max(axis=1, keepdims=True)
            return float(-(e[np.arange(len(truth)), truth] - np.log(np.exp(e).sum(axis=1))).mean())

        model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
        e = np.exp(z / model.temperature - (z / model.temperature).max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        wrong = p[:, :-1].max(axis=1)[truth == len(CLASSES) - 1]
        model.least = float(np.clip(np.quantile(wrong, 0.999) if len(wrong) else 0.5, 0.5, 0.9))
    return model


class _Pairs(dict):
    """For each raw token the number of its first and last known word (-1: none), for finding known word pairs quickly."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.vocabulary: dict[str, int] = {}
        for g in model.place:
            for w in g:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        size = len(self.vocabulary)
        self.table = np.zeros((size + 1, size + 1), bool)
        for g in model.place:
            if len(g) == 2:
                self.table[self.vocabulary[g[0]], self.vocabulary[g[1]]] = True

    def __missing__(self, raw: str) -> int:
        """Both numbers in one, inside pairs (BY-NC) counted as a hit by a third part."""
        if len(self) > 1 << 19:
            self.clear()
        size = len(self.vocabulary)
        ws = words(raw)
        numbers = [self.vocabulary.get(w, size) for w in ws] or [size]
        inside = any(self.table[a, b] for a, b in zip(numbers, numbers[1:], strict=False))
        value = self[raw] = (int(inside) * (size + 1) + numbers[0]) * (size + 1) + numbers[-1]
        return value

    def any_in(self, texts: list[str]) -> np.ndarray:
        """Which texts have a known word pair."""
        out = np.zeros(len(texts), bool)
        n = len(self.vocabulary) + 1
        for i, text in enumerate(texts):
            raw = text.split()
            if raw:
                code = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
                first, last = code // n % n, code % n
                out[i] = (code >= n * n).any() or self.table[last[:-1], first[1:]].any()
        return out


def paragraphs_of(text: str) -> Iterator[tuple[int, str]]:
    """Lines with their starts (code points)."""
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


_FOUND = "doc_id long, family string, start long, end long, score double, similarity double"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, family, start, end, score, similarity: a row for each paragraph that names a license."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = _Pairs(model)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            rows: list[tuple] = []
            hits = np.flatnonzero(pairs.any_in(texts))
            ids = batch["doc_id"]
            for i in hits.tolist():
                for at, line in paragraphs_of(texts[i]):
                    if not pairs.any_in([line])[0]:
                        continue
                    family, score, similarity = model.classify(line)
                    if family != UNKNOWN:
                        rows.append((i, family, at, at + len(line), score, similarity))
            out = pd.DataFrame(rows, columns=["i", "family", "start", "end", "score", "similarity"]).astype({"i": "int64", "start": "int64", "end": "int64", "score": "float64", "similarity": "float64"})
            out["doc_id"] = ids.iloc[out["i"]].array
            yield out[["doc_id", "family", "start", "end", "score", "similarity"]]

    return docs.select("doc_id", "text").mapInPandas(run, _FOUND)


def fit(docs: DataFrame) -> Model:
    """A model whose unknown class knows paragraphs of the first SAMPLE documents by a hash; trained in one task."""
    drawn = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = sorted((t for batch in batches for t in batch["text"]))
        paragraphs = [line for t in texts for _, line in list(paragraphs_of(t))[:PARAGRAPHS]]
        yield pd.DataFrame({"model": [pickle.dumps(train(paragraphs))]})

    found = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([])


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, family, n_paragraphs, score (the best), similarity (the best): a row for each document and family in it."""
    return scan(docs, fit(docs)).groupBy("doc_id", "family").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.max("score").alias("score"), F.max("similarity").alias("similarity"))
