"""Licence families of paragraphs, by a trained classifier and comparison with templates.

Each line is a paragraph. Hashed word pairs and single words go into a sparse
logistic regression over licence families and an unknown class; its
probabilities are calibrated by a temperature fitted on examples kept aside. A
paragraph that the classifier assigns to a family counts only if a template of
that family confirms it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.linededup import lines_of
from citeloom.llm.words import ALPHANUMERIC, hashes, mix, pieces, spans

UNKNOWN = "unknown"
#: Notices by family, in their usual wording.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "This project is released under the Apache 2.0 license",
        "Distributed under the terms of the Apache License, Version 2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Released under the terms of the modified BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal",
        "This work has been dedicated to the public domain",
    ),
    "gpl-2.0": (
        "Licensed under the GNU General Public License, version 2",
        "This program is licensed under the GPL v2",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU GPL version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
    ),
    "proprietary": (
        "All rights reserved",
        "Copyright by the authors. All rights reserved",
        "All rights reserved. No part of this publication may be reproduced without permission",
    ),
}
#: Sentences that speak of licences without granting one.
OTHERS = (
    "He lost his driving license last year",
    "The school applied for a license to sell food",
    "A copy of the report was published by the public library",
    "Apache is a village in the south of the state",
    "The general public may use the park free of charge",
    "All rights of the workers were discussed at the meeting",
    "The MIT campus lies on the river",
    "version 2.0 of the program was released in spring",
)
FEATURES = 1 << 16
#: Lines of the corpus that the unknown class is learned from.
BACKGROUND = 2_000
VARIANTS = 40
#: Least calibrated probability, and least share of a template's words found in order.
LEAST, CONFIRM = 0.5, 0.75
_PAIR = np.uint64(0x2545F4914F6CDD1D)


def _grams(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of single words and of pairs in a line, and the line of each."""
    pair = mix(words[:-1] * _PAIR + words[1:]) if len(words) > 1 else words[:0]
    same = line[:-1] == line[1:]
    found = np.concatenate([words, pair[same]])
    return (mix(found) & np.uint64(FEATURES - 1)).astype(np.int32), np.concatenate([line, line[:-1][same]])


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the line of each, the text of each line, and each text's first line."""
    body, at, owner = lines_of(texts)
    begin, end, line = spans(body, at, ALPHANUMERIC)
    return hashes(body, begin, end), line, owner, np.searchsorted(owner, np.arange(len(texts) + 1))


@dataclass
class Model:
    """Weights, calibration, and the templates' words by family."""

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[list[np.ndarray]]

    def probabilities(self, words: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        """Calibrated probability of each family, and last of the unknown class, for n lines."""
        z = np.zeros((n, len(self.bias)), np.float32)
        feature, of = _grams(words, line)
        order = np.argsort(of, kind="stable")
        feature, of = feature[order], of[order]
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        ends = np.append(begin[1:], len(of))
        step = 0
        while step < len(begin):
            upto = max(int(np.searchsorted(ends, begin[step] + 200_000, side="right")), step + 1)
            a, b = begin[step], ends[upto - 1]
            sums = np.add.reduceat(self.weights[feature[a:b]], begin[step:upto] - a, axis=0)
            z[of[begin[step:upto]]] = sums / np.sqrt(ends[step:upto] - begin[step:upto])[:, None]
            step = upto
        z = (z + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def confirmed(self, family: int, words: np.ndarray) -> bool:
        """Whether a template's words are found in a line, enough of them and in order."""
        for template in self.templates[family]:
            if common_in_order(template, words) >= CONFIRM * len(template):
                return True
        return False


def common_in_order(template: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences."""
    length = np.zeros(len(template) + 1, np.int32)
    # Words that the template lacks cannot take part.
    for word in words[np.isin(words, template)]:
        grown = np.maximum(length[1:], np.where(template == word, length[:-1] + 1, 0))
        length[1:] = np.maximum.accumulate(grown)
    return int(length[-1])


def _variants(background: list[str], rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Training lines: templates with words lost, added and in other surroundings."""
    texts, labels = [], []
    plain = [w for line in background[:200] for w in line.split()] or ["text"]
    groups = [*TEMPLATES.values(), OTHERS]
    for label, group in enumerate(groups):
        for template in group:
            for k in range(VARIANTS):
                words = template.split()
                if k:
                    keep = rng.random(len(words)) > 0.06
                    words = [w for w, good in zip(words, keep, strict=True) if good]
                    # Some lines have a notice among other words.
                    if k % 3 == 0:
                        before, after = rng.integers(0, 6, 2)
                        words = [*rng.choice(plain, before), *words, *rng.choice(plain, after)]
                texts.append(" ".join(words))
                labels.append(label)
    texts.extend(background)
    labels.extend([len(TEMPLATES)] * len(background))
    return texts, labels


def train(background: list[str], seed: int = 11) -> Model:
    """Fit and calibrate the classifier; the background lines are of the unknown class.

    Background lines that hold a template are left out, as the corpus they come
    from has notices of its own.
    """
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    templates = []
    for group in TEMPLATES.values():
        words, line, _, _ = _words(pa.array(list(group)))
        templates.append([words[line == i] for i in range(len(group))])
    k = len(families) + 1
    model = Model(families, np.zeros((FEATURES, k), np.float32), np.zeros(k, np.float32), 1.0, templates)
    if background:
        words, line, _, _ = _words(pa.array([x.replace("\n", " ") for x in background]))
        cut = np.searchsorted(line, np.arange(len(background) + 1))
        background = [
            text
            for i, text in enumerate(background)
            if not any(model.confirmed(f, words[cut[i] : cut[i + 1]]) for f in range(k - 1))
        ]
    texts, labels = _variants([x.replace("\n", " ") for x in background], rng)
    words, line, _, _ = _words(pa.array(texts))
    feature, of = _grams(words, line)
    order = np.argsort(of, kind="stable")
    feature, of = feature[order], of[order]
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    labels = np.array(labels)
    aside = rng.random(len(texts)) < 0.2
    learned = np.flatnonzero(~aside)
    squares = np.full((FEATURES, k), 1e-8, np.float32)
    for _ in range(6):
        for i in rng.permutation(learned):
            f = feature[cut[i] : cut[i + 1]]
            if not len(f):
                continue
            scale = 1 / np.sqrt(len(f))
            z = model.weights[f].sum(0) * scale + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            # AdaGrad, and a small step towards zero, which keeps weights sparse.
            g = np.broadcast_to(p * scale, (len(f), k))
            squares[f] += g * g
            w = model.weights[f] - 0.3 * g / np.sqrt(squares[f])
            model.weights[f] = np.sign(w) * np.maximum(np.abs(w) - 1e-4, 0)
            model.bias -= 0.02 * p
    kept = np.flatnonzero(aside & (np.diff(cut) > 0))
    place = {int(x): i for i, x in enumerate(kept)}
    mine = np.isin(line, kept)
    to = np.array([place[int(x)] for x in line[mine]], np.int64)

    def loss(t: float) -> float:
        model.temperature = t
        p = model.probabilities(words[mine], to, len(kept))
        return -float(np.log(p[np.arange(len(kept)), labels[kept]] + 1e-12).mean())

    model.temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    return model


def learn(docs: DataFrame, background: int = BACKGROUND) -> Model:
    """Train with at most ``background`` lines of the documents of the smallest hashes."""
    mark = F.xxhash64("text", "doc_id")
    count = docs.count()
    share = min(1.0, 4.0 * background / max(count, 1))
    few = docs.where(
        F.col("text").isNotNull()
        & (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    )
    line = F.element_at(F.split("text", "\n"), F.pmod(mark, F.size(F.split("text", "\n"))).cast("int") + 1)
    rows = few.select(mark.alias("mark"), F.substring(line, 1, 2000).alias("line"))
    found = rows.orderBy("mark", "line").limit(background).select("line").collect()
    return train([r["line"] for r in found if r["line"]])


RESULT_SCHEMA = (
    "doc_id long, n_lines long, n_notices long, families string, score double, "
    "notices array<struct<line: int, family: string, score: double>>"
)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, n_lines, n_notices, families, score, notices`` of every row of ``docs``.

    ``notices`` has each confirmed line with its family and calibrated
    probability, ``families`` their names, sorted and joined by commas, ``score``
    the largest probability (0 without a notice). A null or empty text has one
    empty line and no notice. Rows may repeat; a null id stays null; further
    columns are not read; an empty table gives no rows.
    """
    model = model or learn(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in pieces(batches):
            words, line, owner, starts = _words(part.column("text"))
            p = model.probabilities(words, line, len(owner))
            best = p[:, :-1].argmax(1)
            top = p[np.arange(len(p)), best]
            notices: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for i in np.flatnonzero(top >= LEAST):
                a, b = np.searchsorted(line, [i, i + 1])
                if b > a and model.confirmed(best[i], words[a:b]):
                    notices[owner[i]].append(
                        {
                            "line": int(i - starts[owner[i]]),
                            "family": model.families[best[i]],
                            "score": float(top[i]),
                        }
                    )
            kind = pa.list_(
                pa.struct([("line", pa.int32()), ("family", pa.string()), ("score", pa.float64())])
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(starts).astype(np.int64)),
                    pa.array([len(x) for x in notices], pa.int64()),
                    pa.array([",".join(sorted({y["family"] for y in x})) for x in notices], pa.string()),
                    pa.array([max((y["score"] for y in x), default=0.0) for x in notices]),
                    pa.array(notices, kind),
                ],
                names=["doc_id", "n_lines", "n_notices", "families", "score", "notices"],
            )

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, RESULT_SCHEMA)
