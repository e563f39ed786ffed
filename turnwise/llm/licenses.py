"""License scans: a trained classifier of paragraphs, confirmed by comparison with templates.

A multinomial logistic regression over n-grams of one to three words tells license families from
each other and from other text.  It is fitted with an L1 penalty on the driver, on variants of the
notices below and on a bounded sample of the corpus's own paragraphs, so only some n-grams have
weights.  Every n-gram with a weight holds an anchor, a word that is taken from the weights themselves;
a paragraph without an anchor has the scores of an empty one, which is other text, and is left out by a
scan for the anchors before it is cut into words.

Scanning is DataFrame expressions alone: paragraphs with anchors, their distinct n-grams, a join with
the weights (a table of bounded size), and sums per paragraph that are combined before the shuffle.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.base import full, query, table

# Usual notices of license families.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0"],
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": [
        "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc0": ["Released into the public domain under CC0 1.0.", "This work is dedicated to the public domain under the CC0 license."],
}
# Notices without a cue (below).
SHORT = {
    "mit": ["Released under MIT.", "Available under MIT."],
    "bsd": ["Distributed under the BSD 3-Clause terms.", "Released under BSD 2-Clause."],
    "mpl-2.0": ["Available under MPL 2.0.", "Released under MPL 2.0."],
    "cc-by": ["This article is available under CC BY 4.0.", "CC BY 4.0"],
    "cc-by-sa": ["This article is available under CC BY-SA 4.0.", "CC BY-SA 4.0"],
    "cc-by-nc": ["This article is available under CC BY-NC 4.0.", "CC BY-NC 4.0"],
    "cc-by-nc-sa": ["This article is available under CC BY-NC-SA 4.0.", "CC BY-NC-SA 4.0"],
}
# Notices of none of these families, and other uses of their words.
UNKNOWN = [
    "Licensed under the terms of the company's license agreement.", "All rights reserved. No license is granted.",
    "This software is licensed under the Example Source License, version 5.", "Released under a custom license.",
    "Permission to use this material must be requested in writing.", "Copyright by the authors. All rights reserved.",
    "See the license file for details.", "Licensed under the Eclipse Public License, version 1.0.",
    "Distributed under the Artistic License.", "This work is licensed under the Open Data License, version 1.0."]
OTHER = [
    "He lost his driving license last year.", "You need a fishing licence and the permission of the owner.",
    "The warranty of the car ended in March.", "She studied at MIT before she came to Boston.", "The apache helicopter landed.",
    "The version of the story differs.", "A copyright dispute about a song.", "The domain of the function is open to the public."]
CUES = "licen[sc]|copyright|copyleft|warrant|permi|redistribut|spdx|gnu|gpl|apache|mozilla|creative|public domain|cc0|reserved"
FEATURE = re.compile(CUES + r"|\d|\b(?:mit|bsd|mpl|by|nc|sa|cc)\b")  # in n-grams that can have a weight
NOTICE = re.compile(CUES + r"|\bcc[ -]by\b|\b(?:bsd|mpl)\b|\bunder (?:the )?mit\b")  # not in paragraphs taken as other text
NONE, NEW = "none", "unknown"
NGRAM = 3
PARAGRAPHS = 4_000  # of the corpus that the classifier is fitted on, at most about
CONFIRM = 0.6  # least share of a template's n-grams that a confirmed paragraph has
WORD = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"
CUE = re.compile(CUES)
PLAIN_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")  # the same for Python


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; dots between digits stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def ngrams(text: str) -> set[str]:
    """The n-grams of a text, as ``paragraph_ngrams`` makes them."""
    words = PLAIN_WORD.findall(text.lower())
    return {" ".join(words[i:i + n]) for n in range(1, NGRAM + 1) for i in range(len(words) - n + 1)}


def paragraph_ngrams(words: Column) -> Column:
    """The distinct n-grams of an array of words."""
    def of(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(
            F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")))
    return F.array_distinct(F.concat(*[F.coalesce(of(n), F.array().cast("array<string>")) for n in range(1, NGRAM + 1)]))


@dataclass
class LicenseModel:
    """Weights per n-gram and class, calibrated, and the n-grams of the templates."""

    classes: list[str]
    intercepts: np.ndarray
    weights: dict[str, np.ndarray]
    templates: list[tuple[str, set[str]]]
    threshold: float

    def anchors(self) -> list[str]:
        """Words so that every n-gram with a weight holds one of them."""
        found: set[str] = set()
        for words in sorted((g.split(" ") for g in self.weights), key=lambda w: (len(w), w)):
            if not found.intersection(words):
                found.add(max(words, key=len))
        return sorted(found)

    def probabilities(self, text: str) -> np.ndarray:
        scores = self.intercepts + sum((self.weights[g] for g in ngrams(text) if g in self.weights), np.zeros(len(self.classes)))
        scores = np.exp(scores - scores.max())
        return scores / scores.sum()


def variants(notice: str, random_: random.Random) -> list[str]:
    """A notice as it is, with words around it, without some of its words, and cut at its ends."""
    words = notice.split()
    out = [notice, notice.upper(), f"{notice} Please read it.", f"Note: {notice}"]
    for _ in range(6):
        out.append(" ".join(w for w in words if random_.random() > 0.08))
        if len(words) > 8:
            cut = random_.randrange(len(words) // 5 + 1)
            out.append(" ".join(words[cut:len(words) - random_.randrange(len(words) // 5 + 1)]))
    return out


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, penalty: float, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and L1-penalised weights of a multinomial logistic regression, by proximal gradients."""
    x = np.column_stack([np.ones(len(x)), x])
    target = np.eye(classes)[y]
    balance = (1 / np.bincount(y, minlength=classes).clip(1))[y]
    balance /= balance.sum()
    rate = 2 / max(np.linalg.norm(x.T * balance @ x, 2), 1e-9)
    w = v = np.zeros((x.shape[1], classes))
    momentum = 1.0
    for _ in range(steps):
        scores = x @ v
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = v - rate * (x.T @ ((p - target) * balance[:, None]))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        v, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return w[0], w[1:]


def fit_licenses(corpus: list[str], penalty: float = 2e-5) -> LicenseModel:
    """The classifier from the notices above and ``corpus``, paragraphs taken as other text unless they read as a notice.

    The temperature of the probabilities and the least probability of a known family are calibrated
    on variants that the weights were not fitted on: the threshold lies between the probabilities of
    known and of unknown notices.
    """
    classes = [*TEMPLATES, NONE]
    draw = random.Random(7)
    notices = {name: TEMPLATES[name] + SHORT.get(name, []) for name in TEMPLATES}
    known = [(v, i % 4 == 3, k) for k, name in enumerate(notices) for n in notices[name] for i, v in enumerate(variants(n, draw))]
    unclear = [v for n in UNKNOWN for v in variants(n, draw)]
    plain = [p for p in corpus if not NOTICE.search(p.lower())] + OTHER
    rows = known + [(p, i % 4 == 3, len(TEMPLATES)) for i, p in enumerate(plain)]
    vocabulary = sorted({g for t, held, k in known if not held for g in ngrams(t) if FEATURE.search(g)})
    place = {g: i for i, g in enumerate(vocabulary)}

    def matrix(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(vocabulary)))
        for i, text in enumerate(texts):
            out[i, [place[g] for g in ngrams(text) if g in place]] = 1
        return out

    fitted = [(t, k) for t, held, k in rows if not held]
    intercepts, weights = fit_softmax(matrix([t for t, _ in fitted]), np.array([k for _, k in fitted]), len(classes), penalty)
    checked = [(t, k) for t, held, k in rows if held]
    scores = matrix([t for t, _ in checked]) @ weights + intercepts
    answer = np.array([k for _, k in checked])

    def loss(heat: float) -> float:
        p = scores / heat
        p = p - p.max(axis=1, keepdims=True)
        return float((np.log(np.exp(p).sum(axis=1)) - p[np.arange(len(p)), answer]).mean())

    intercepts[-1] = intercepts.max()  # a text without features is other text
    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    model = LicenseModel(
        classes, intercepts / heat, {g: w / heat for g, w in zip(vocabulary, weights) if np.abs(w).max() > 1e-6},
        [(name, ngrams(n)) for name in notices for n in notices[name]], 0.5)
    right = [model.probabilities(t)[:-1].max() for t, k in checked if k < len(TEMPLATES)]
    wrong = [model.probabilities(t)[:-1].max() for t in unclear]
    cuts = np.linspace(0.3, 0.95, 66)
    model.threshold = float(max(cuts, key=lambda c: np.mean(np.array(right) >= c) + np.mean(np.array(wrong) < c)))
    return model


def train_licenses(docs: DataFrame, *, text: str = "text", paragraphs: int = PARAGRAPHS) -> LicenseModel:
    """A model with about ``paragraphs`` first paragraphs of documents at most as other text, drawn by a hash of the text."""
    usable = docs.select(F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    share = min(1.0, paragraphs / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).select(
        F.substring(F.split("text", "\n", 2)[0], 1, 2_000).alias("p")).distinct().collect()
    return fit_licenses(sorted(r["p"] for r in drawn))


def scan_licenses(
    docs: DataFrame, model: LicenseModel, *, id: str = "doc_id", text: str = "text", confirm: float = CONFIRM,
) -> DataFrame:
    """The license paragraphs of all documents.

    ``id``, ``paragraph`` (number of the line from 0), ``family``, ``predicted`` (most likely family),
    ``probability`` (of it), ``overlap`` (largest share of the n-grams of one of its templates that the
    paragraph has) and ``line`` (text).  ``family`` is ``predicted`` if its probability reaches the model's
    threshold and the overlap ``confirm``, else ``unknown``.  A paragraph that is more likely no license
    notice than one is left out; so are null and empty texts.  Lines of repeated rows come once for each
    row; null ids stay null; an empty table gives an empty result; other columns are ignored.
    """
    spark, classes = docs.sparkSession, model.classes
    # Words are runs of letters and digits, so no letter is beside one (a digit may be: "1.2by" is two words).
    anchors = r"(?<!\p{L})(?:" + "|".join(re.escape(a) for a in model.anchors()) + r")(?!\p{L})"
    lines = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), full(text).alias("text")).where(
            F.lower("text").rlike(anchors)).select("row", "id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).where(
            F.lower("line").rlike(anchors))
    # Words are a column of their own, else each n-gram would cut the line anew.
    words = lines.withColumn("words", words_of(F.col("line")))
    grams = words.select("row", "id", "paragraph", "line", F.explode(paragraph_ngrams(F.col("words"))).alias("gram"))
    # A vocabulary of bounded size: the n-grams of the notices above.
    known = sorted(set(model.weights) | {g for _, grams_ in model.templates for g in grams_})
    zero = np.zeros(len(classes))
    entries = spark.createDataFrame(
        [(g, [float(w) for w in model.weights.get(g, zero)], [i for i, (_, own) in enumerate(model.templates) if g in own]) for g in known],
        "gram string, weights array<double>, templates array<int>")
    sums = grams.join(F.broadcast(entries), "gram").groupBy("row", "id", "paragraph").agg(
        F.first("line").alias("line"),
        F.array(*[F.sum(F.col("weights")[k]) for k in range(len(classes))]).alias("sums"),
        F.array(*[F.count_if(F.array_contains("templates", i)) / F.lit(float(len(own))) for i, (_, own) in enumerate(model.templates)]).alias("shares"))
    scores = F.zip_with("sums", F.array(*[F.lit(float(b)) for b in model.intercepts]), lambda s, b: s + b)
    exps = F.transform("scores", lambda s: F.exp(s - F.array_max("scores")))
    family_scores = F.slice("probabilities", 1, len(classes) - 1)
    overlaps = F.array(*[
        F.greatest(*[F.col("shares")[i] for i, (of, _) in enumerate(model.templates) if of == name] * 2) for name in classes[:-1]])
    found = sums.withColumn("scores", scores).withColumn("exps", exps).withColumn(
        "probabilities", F.transform("exps", lambda e: e / F.aggregate("exps", F.lit(0.0), lambda s, x: s + x)))
    found = found.withColumn("probability", F.array_max(family_scores)).withColumn(
        "best", F.array_position(family_scores, F.array_max(family_scores)).cast("int")).where(
        F.col("probabilities")[len(classes) - 1] < F.col("probability")).withColumn(
        "overlap", F.element_at(overlaps, F.col("best"))).withColumn(
        "predicted", F.element_at(F.array(*[F.lit(c) for c in classes[:-1]]), F.col("best")))
    return found.select(
        F.col("id").alias(id), "paragraph",
        F.when((F.col("probability") >= model.threshold) & (F.col("overlap") >= confirm), F.col("predicted")).otherwise(NEW).alias("family"),
        "predicted", F.round("probability", 6).alias("probability"), F.round("overlap", 6).alias("overlap"), "line")


@query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, train_licenses(docs))
