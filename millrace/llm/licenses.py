"""Licence scan: a trained paragraph classifier over word n-grams, confirmed by comparison with templates."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import MARKS, grams, hash_words
from millrace.llm.common import short_batches
from millrace.llm.tokens import batches

# Notices of each licence family, and paragraphs of the shorter licences, as their licensors publish them.
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
    ],
}
# Short forms of notices, two or three words that are found on a line of their own or among few others.
SHORT_FORMS = {
    "apache": ["License: Apache-2.0", "Apache-2.0 licensed."],
    "bsd": ["License: BSD", "BSD licensed."],
    "gpl": ["License: GPL", "GPL licensed."],
    "mit": ["License: MIT", "MIT licensed."],
}
UNKNOWN = "unknown"
#: Buckets of n-gram features.
FEATURES = 1 << 14
#: Words of the windows slid over a paragraph. A window moves on by a quarter, so that runs of words of up to 3/4 of the longest, all templates, are inside one.
WINDOWS = (8, 16, 40)


def features(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each word 1-, 2- and 3-gram, rows by first word; FEATURES where a gram would pass the end."""
    out = np.full((len(hashes), 3), FEATURES, np.int64)
    for n in (1, 2, 3):
        g = grams(hashes, n)
        out[: len(g), n - 1] = (g & np.uint64(FEATURES - 1)).astype(np.int64)
    return out


def split_paragraphs(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All lines of all texts that hold anything, with their text's index, number and first character."""
    lines, own, numbers, starts = [], [], [], []
    for i, t in enumerate(texts):
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            if line:
                lines.append(line)
                own.append(i)
                numbers.append(k)
                starts.append(at)
            at += len(line) + 1
    return lines, np.array(own, np.int64), np.array(numbers, np.int64), np.array(starts, np.int64)


@dataclass
class LicenseModel:
    """Calibrated logistic regression weights (a row for each feature, a column for each family and for none), the least
    probability of any licence that counts as a find, and each family's templates as sets of word pairs, each with the
    hash that must be there for a short one to be confirmed."""

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    least: float
    templates: dict[str, list[tuple[set[int], set[int]]]]

    def probabilities(self, hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each run of words (first to first + counts, at least one) the probability of each family and of none."""
        grams_of, edge = features(hashes), first + counts
        z = np.zeros((len(first), self.weights.shape[1]))
        for n in (1, 2, 3):  # grams that pass a run's end are none
            sums = np.concatenate([np.zeros((1, z.shape[1])), np.cumsum(self.weights[grams_of[:, n - 1]], axis=0, dtype=np.float64)])
            z += sums[np.maximum(first, edge - n + 1)] - sums[first]
        z = z / np.sqrt(np.maximum(1, 3 * counts - 3))[:, None] + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def judge(self, hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, block: int = 16384) -> tuple[np.ndarray, np.ndarray]:
        """Of each run of words the likeliest family and the probability that it is of any licence; ``block`` runs at a time."""
        family, chance = np.zeros(len(first), np.int64), np.zeros(len(first))
        order = np.argsort(first, kind="stable")
        for at in range(0, len(order), block):
            some = order[at : at + block]
            low, high = int(first[some[0]]), int((first[some] + counts[some]).max())
            p = self.probabilities(hashes[low:high], first[some] - low, counts[some])
            family[some], chance[some] = p[:, :-1].argmax(axis=1), 1 - p[:, -1]
        return family, chance


def slide(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the windows over each run of words (at least one); the run itself if it is shorter than a window."""
    starts, sizes, whole = [], [], np.zeros(len(first), bool)
    for w in WINDOWS:
        n = np.where(counts > w, -(-(counts - w) // (w // 4)) + 1, np.where(whole, 0, 1))
        whole |= counts <= w
        own = np.repeat(np.arange(len(first)), n)
        at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        starts.append(first[own] + np.minimum(at * (w // 4), np.maximum(0, counts[own] - w)))
        sizes.append(np.minimum(w, counts[own]))
    return np.concatenate(starts), np.concatenate(sizes)


@dataclass
class Sparse:
    """A matrix of n rows by its entries, sorted by row."""

    n: int
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def part(self, chosen: np.ndarray) -> Sparse:
        """The chosen rows (bool) in order."""
        own = chosen[self.rows]
        return Sparse(int(chosen.sum()), (np.cumsum(chosen) - 1)[self.rows[own]], self.columns[own], self.values[own])

    def turned(self, columns: int) -> Sparse:
        order = np.argsort(self.columns, kind="stable")
        return Sparse(columns, self.columns[order], self.rows[order], self.values[order])

    def __matmul__(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, dense.shape[1]), dense.dtype)
        if len(self.rows):
            first = np.flatnonzero(np.r_[True, self.rows[1:] != self.rows[:-1]])
            out[self.rows[first]] = np.add.reduceat(dense[self.columns] * self.values[:, None], first, axis=0)
        return out


def design(texts: list[str]) -> Sparse:
    """Feature matrix of a bounded list of paragraphs: counts of the n-grams that occur, by the root of their number."""
    words = hash_words(texts, MARKS)
    columns, values, at = [], [], 0
    for c in words.counts.tolist():
        own = features(words.hashes[at : at + c]).ravel()
        bucket, n = np.unique(own[own < FEATURES], return_counts=True)
        columns.append(bucket)
        values.append((n / np.sqrt(max(1, 3 * c - 3))).astype(np.float32))
        at += c
    return Sparse(len(texts), np.repeat(np.arange(len(texts)), [len(x) for x in columns]), np.concatenate(columns), np.concatenate(values))


def pairs(text: str) -> set[int]:
    return set(grams(hash_words([text], MARKS).hashes, 2).tolist())


#: Words below which a template is short: what it shares with other families' is most of it.
SHORT = 12


def compared(templates: dict[str, list[str]]) -> dict[str, list[tuple[set[int], set[int]]]]:
    """Of each template its word pairs, and for a short one the first word that no other family's templates have, or else the first such pair: without it, nothing tells the family."""
    runs = {f: [[grams(hash_words([t], MARKS).hashes, n).tolist() for n in (1, 2)] for t in own] for f, own in templates.items()}

    def needed(family: str, run: list[list[int]]) -> set[int]:
        if len(run[0]) >= SHORT:
            return set()
        for n in (0, 1):
            other = {x for f, own in runs.items() if f != family for r in own for x in r[n]}
            if first := next((x for x in run[n] if x not in other), None):
                return {first}
        return set()

    return {f: [(set(run[1]), needed(f, run)) for run in own] for f, own in runs.items()}


def train_licenses(negatives: list[str], templates: dict[str, list[str]] = TEMPLATES, forms: dict[str, list[str]] = SHORT_FORMS, variants: int = 24, steps: int = 300, false_rate: float = 1e-3, seed: int = 7) -> LicenseModel:
    """A model from the templates with words around, dropped and changed, against a bounded list of other paragraphs.

    The fit sees a window from anywhere in each of the other paragraphs. Every second paragraph is left out of it. On
    those, the temperature by which logits are divided is chosen for the least cross-entropy, so that probabilities are
    calibrated; and the least probability of a find is set so that at most ``false_rate`` of the other paragraphs left
    out have any window that counts as one, and at least 0.5.
    """
    rng = random.Random(seed)
    templates = {f: [*own, *forms.get(f, [])] for f, own in templates.items()}
    known = [set(pairs(t)) for own in templates.values() for t in own]
    spare = [w for t in negatives[:500] for w in t.split()[:20]] or ["lorem", "ipsum", "dolor", "sit", "amet"]
    others = [t for t in negatives if not any(len(pairs(t) & k) >= 0.5 * len(k) for k in known if k)] or [" ".join(spare)]
    families = sorted(templates)
    texts, labels = [], []
    for c, family in enumerate(families):
        for template in templates[family]:
            own = template.split()
            for v in range(variants):
                some = [w for w in own if v < 4 or rng.random() > 0.06]
                some = [rng.choice(spare) if v >= 8 and rng.random() < 0.04 else w for w in some]
                around = [rng.choice(spare) for _ in range(rng.choice([0, 0, 3, 8]) if v >= 4 else 0)]
                cut = rng.randint(0, len(around))
                texts.append(" ".join(around[:cut] + some + around[cut:]))
                labels.append(c)
    held_out = others[1 - len(texts) % 2 :: 2]
    for t in others:
        own = t.split()
        size = rng.choice([*WINDOWS, len(own)])
        cut = rng.randint(0, max(0, len(own) - size))
        texts.append(" ".join(own[cut : cut + size]))
    labels += [len(families)] * len(others)
    x, y = design(texts), np.eye(len(families) + 1, dtype=np.float32)[labels]
    fit = np.arange(len(texts)) % 2 == 0
    weight = np.where(np.array(labels) == len(families), fit.sum() / 2 / max(1, len(others)), fit.sum() / 2 / (len(texts) - len(others)))[fit, None].astype(np.float32)
    weight /= weight.sum()
    learned = x.part(fit)
    by_feature = learned.turned(FEATURES)
    w, b = np.zeros((FEATURES, len(families) + 1), np.float32), np.zeros(len(families) + 1, np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = learned @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - y[fit]) * weight
        mw, mb = 0.9 * mw + by_feature @ g + 1e-5 * w, 0.9 * mb + g.sum(axis=0)
        w, b = w - 4.0 * mw, b - 4.0 * mb
    z, left = x.part(~fit) @ w + b, np.array(labels)[~fit]
    share = np.where(left == len(families), 0.5 / max(1, (left == len(families)).sum()), 0.5 / max(1, (left != len(families)).sum()))

    def entropy(heat: float) -> float:
        p = z / heat
        p = p - p.max(axis=1, keepdims=True)
        return float((share * (np.log(np.exp(p).sum(axis=1)) - p[np.arange(len(p)), left])).sum())

    heat = min((float(h) for h in np.geomspace(0.1, 10, 81)), key=entropy) if len(left) else 1.0
    model = LicenseModel(families, np.concatenate([w, np.zeros((1, w.shape[1]), np.float32)]) / np.float32(heat), b / np.float32(heat), 0.5, compared(templates))
    words = hash_words(held_out, MARKS)
    some = np.flatnonzero(words.counts)
    if len(some):
        first, counts = slide((np.cumsum(words.counts) - words.counts)[some], words.counts[some])
        best = np.zeros(len(held_out))
        np.maximum.at(best, words.texts[first], model.judge(words.hashes, first, counts)[1])
        model.least = max(0.5, float(np.quantile(best[some], 1 - false_rate)))
    return model


def sample_paragraphs(docs: DataFrame, text_col: str = "text", sample: int = 2000) -> list[str]:
    """About ``sample`` lines chosen by hash over all rows, the classifier's other class; of a longer line 2000 characters from anywhere in it."""
    n = docs.count()
    chance = min(1.0, 4.0 * sample / max(n, 1))
    uniform = F.shiftrightunsigned(F.xxhash64("line"), 11).cast("double") / float(2**53)
    chosen = docs.where(F.shiftrightunsigned(F.xxhash64(F.lit("row"), F.col(text_col)), 11).cast("double") / float(2**53) < chance) if chance < 1 else docs
    lines = chosen.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line")).where("line <> ''")
    start = F.pmod(F.xxhash64(F.lit("start"), "line"), F.greatest(F.lit(1), F.length("line") - 1999)).cast("int") + 1
    got = lines.select(F.col("line").substr(start, F.lit(2000)).alias("line"), uniform.alias("u")).distinct().orderBy("u", "line").limit(sample).collect()
    return [r["line"] for r in got]


def scan_licenses(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", least_overlap: float = 0.6) -> DataFrame:
    """(doc_id, paragraph, start, length, family, probability, overlap, confirmed) of the paragraphs that look like a licence.

    A paragraph is a line of the text, of any length, or a run of lines that aren't blank where what is found goes over
    a line's end; ``paragraph`` is the number of its (first) line and ``start`` and ``length`` are in characters. Scored
    are lines up to the longest window and windows of some words slid over each run of lines, so a notice counts for the
    same in a long paragraph and however it is wrapped. A find is a window whose calibrated ``probability`` of any
    licence is at least the model's least one. It is confirmed if it holds at least ``least_overlap`` of the word pairs
    of a template of its likeliest family, or of another family if that has none, and, if the template is short, the
    word in it that names the family; else, as in a licence that is not among
    the templates, its family is ``unknown``. A window without any word pair of any template is no find. Of finds that share words the best is kept, and of several of a family in
    a paragraph. Null and empty texts have none, repeated rows have theirs each, other columns aren't read.
    """
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES by families floats
    schema = pa.schema([("doc_id", pa.int64()), ("paragraph", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64()), ("confirmed", pa.bool_())])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for table in tables:
            keys, out = table.column(0).to_pylist(), []
            for at, some in batches(table.column(1)):
                lines, own, numbers, starts = split_paragraphs(some)
                if not lines:
                    continue
                words = hash_words(lines, MARKS)
                blank = np.array([not x.strip() for x in lines])
                apart = np.r_[True, (np.diff(own) != 0) | (np.diff(numbers) != 1) | blank[1:] | blank[:-1]]
                run_of = np.cumsum(apart) - 1
                ends = np.cumsum(words.counts)
                last = np.r_[np.flatnonzero(apart)[1:], len(lines)] - 1
                top = np.flatnonzero(apart)
                n = ends[last] - ends[top] + words.counts[top]
                spoken = np.flatnonzero((words.counts > 0) & (words.counts <= WINDOWS[-1]))
                if not len(words.hashes):
                    continue
                first, counts = slide((ends - words.counts)[top][n > 0], n[n > 0])
                first, counts = np.r_[(ends - words.counts)[spoken], first], np.r_[words.counts[spoken], counts]
                best, least = model.judge(words.hashes, first, counts)
                found = []
                for j in np.flatnonzero(least >= model.least).tolist():
                    a, z = int(first[j]), int(first[j] + counts[j])
                    family = model.families[best[j]]
                    mine = set(grams(words.hashes[a:z], 2).tolist())
                    there = mine.union(grams(words.hashes[a:z], 1).tolist())
                    fit = [(len(mine & t) / len(t), need <= there, f) for f, sets in model.templates.items() for t, need in sets if t]
                    overlap, other = max(((o if told else min(o, 0.99 * least_overlap)), f == family, f) for o, told, f in fit)[::2]  # no more than shared words
                    own_overlap = max((o for o, told, f in fit if told and f == family), default=0.0)
                    overlap, family = (own_overlap, family) if own_overlap >= least_overlap else (overlap, other)
                    if not overlap:
                        continue
                    x, y = int(words.texts[a]), int(words.texts[z - 1])
                    found.append((overlap < least_overlap, -overlap, x != y, -float(least[j]), x, y, a, z, family))
                taken, told = {}, set()
                for unsure, overlap, wrapped, chance, x, y, a, z, family in sorted(found):
                    others = taken.setdefault(run_of[x], [])
                    if any((x <= t[1] and t[0] <= y) if unsure else (a < t[3] and t[2] < z) for t in others):
                        continue
                    others.append((x, y, a, z))
                    x, y = (int(top[run_of[x]]), int(last[run_of[x]])) if wrapped else (x, y)
                    family = UNKNOWN if unsure else family
                    if (x, y, family) not in told:
                        told.add((x, y, family))
                        out.append((keys[at + own[x]], int(numbers[x]), int(starts[x]), int(starts[y] - starts[x]) + len(lines[y]), family, -chance, -overlap, not unsure))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, paragraph long, start long, length long, family string, probability double, overlap double, confirmed boolean")
