"""Licence scan by a trained paragraph classifier, in DataFrame functions only.

A multinomial logistic regression on word 1- and 2-grams is fitted on the driver
from the notices below (a fixed, small table), with a penalty that leaves most
n-grams without weight.  A paragraph with none of the others is prose by the
model's biases alone, so only paragraphs with one are scored, each within its own
row.  Prose is a class of its own, and a threshold calibrated on notices and prose
left out of the fit decides what stays unknown.  A predicted family holds if enough
of the paragraph's n-grams stand in that family's templates.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Paragraphs that hold one of these, in any case of letters, are reported even if unknown.  MARKS stand in other words when in lower case.
STEMS = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain", "apache", "creative commons", "mozilla", "spdx", "gpl", "cc by", "cc-by", "cc0", "bsd", "mpl-", "mpl 2", "mplv", "mpl2")
MARKS = ("MIT", "MPL")
#: A line of more words than LONG is also judged by windows of WINDOW words, every STRIDE.
LONG, WINDOW, STRIDE = 24, 8, 4
WORD = r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"
STEPS, RATE, L2, L1 = 300, 8.0, 2e-4, 3e-4
#: Least part of a paragraph's n-grams that a confirming family's templates hold.
CONFIRM = 0.5

# Words too common in some language to be features by themselves; pairs of two of them are none either.
COMMON = frozenset("a all an and any are as at be by can do for from has he her his if in into is it its mit may no nor not of on one or other she shall so such that the their they this those to was were which who will with you your 1 2 3 1.0 2.0 3.0 4.0".split())
# Names of each family, and opening passages of its notices.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "The MIT License (MIT)", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL version 3", "GPL-3.0", "GPLv2", "GNU General Public License version 2 or later", "GPL-2.0-or-later"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v2.1", "LGPL-2.1", "LGPLv3"],
    "AGPL": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "CC BY 3.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal public domain dedication", "CC0-1.0"],
    "ISC": ["ISC License", "ISC licence"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
FRAMES = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is released under the terms of the {}.", "Distributed under the {}. See LICENSE for details.", "SPDX-License-Identifier: {}", "License: {}", "Code in this file is available under the {}.", "This work is licensed under a {}.", "All content is published under {}."]
PASSAGES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose."],
}
PROSE = [
    "The driver lost his license after the accident and had to wait a year.", "Her fishing licence was issued by the city in spring.", "The museum asked for permission to show the painting.", "The warranty covers repairs for two years from the date of purchase.", "A search warrant was signed by the judge in the morning.", "Copyright law differs from country to country.", "The students of MIT built a small robot.", "An Apache helicopter flew over the valley.",
    "All rights reserved.", "The company redistributed its profits to the workers.", "The licence plate was covered with mud.", "Please ask for permission before you take photographs.", "The book is in the public domain in some countries and not in others.", "The restaurant got a new liquor license last week.", "Copyright 2020 by the author, who thanks the readers.", "He was given a license to practise medicine in this state.", "Mozilla announced a new version of its browser.",
    "The Apache people lived in the southwest.", "No warranty is given for used cars.", "The bank granted permission to open an account.", "Wealth was redistributed after the revolution.", "The photograph shows the license of a pilot from 1930.", "Creative commons are shared spaces of a town.", "This product comes with a limited warranty against defects.", "The terms of the agreement were released under pressure from the public.", "This version of the film was distributed in two countries.", "The general public was not allowed into the building.", "The foundation published the second version of the report.",
]


def grams(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def _is_feature(gram: str) -> bool:
    return not COMMON.issuperset(gram.split(" "))


@lru_cache(1)
def model() -> dict:
    """families, weights of n-grams, each family's templates, biases, temperature and threshold."""
    families = [*NAMES, UNKNOWN]
    rows = [(f, frame.format(name)) for f, names in NAMES.items() for name in names for frame in FRAMES]
    for f, own in PASSAGES.items():
        for p in own:  # whole, and in the pieces that a text wrapped at some column holds
            words = p.split()
            rows += [(f, p)] * 4 + [(f, " ".join(words[k : k + 13])) for k in range(0, len(words) - 6, 4)]
    rows += [(UNKNOWN, p) for p in PROSE for _ in range(8)]
    vocabulary = {g: i for i, g in enumerate(sorted({g for _, t in rows for g in grams(t) if _is_feature(g)}))}
    x, y = np.zeros((len(rows), len(vocabulary))), np.array([families.index(f) for f, _ in rows])
    for i, (_, t) in enumerate(rows):
        own = grams(t)
        x[i, [vocabulary[g] for g in own if g in vocabulary]] = 1 / math.sqrt(len(own))
    aside = np.arange(len(rows)) % 5 == 0
    share = len(rows) / (len(families) * np.bincount(y, minlength=len(families)))

    def steps(keep: np.ndarray, used: np.ndarray, l1: float) -> tuple[np.ndarray, np.ndarray]:
        w, b, cost = np.zeros((x.shape[1], len(families))), np.zeros(len(families)), share[y[keep]][:, None] / keep.sum()
        own = np.where(used, x[keep], 0.0)
        for _ in range(STEPS):
            p = own @ w + b
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(p)), y[keep]] -= 1
            w -= RATE * (own.T @ (p * cost) + L2 * w)
            w = np.sign(w) * np.maximum(np.abs(w) - RATE * l1, 0)
            b -= RATE / 4 * (p * cost).sum(0)
            b[-1] = max(b[-1], b[:-1].max())  # without any feature, prose is the likeliest
        return w, b

    def fit(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features by the penalty L1, and their weights without it."""
        w, _ = steps(keep, np.ones(x.shape[1], bool), L1)
        return steps(keep, w.any(1), 0.0)

    w, b = fit(~aside)
    z = x[aside] @ w + b
    heat = min((0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0), key=lambda t: float((np.log(np.exp(z / t - (z / t).max(1, keepdims=True)).sum(1)) + (z / t).max(1) - z[np.arange(len(z)), y[aside]] / t).mean()))
    p = np.exp(z / heat - (z / heat).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    strangers = p[y[aside] == len(families) - 1][:, :-1].max(1)
    w, b = fit(np.ones(len(rows), bool))
    templates: dict[str, set[str]] = {}
    for f, t in rows:
        templates.setdefault(f, set()).update(grams(t) if f != UNKNOWN else ())
    weights = {g: [round(float(v), 5) for v in w[i]] for g, i in vocabulary.items() if w[i].any()}
    return {"families": families, "weights": weights, "templates": [sorted(templates[f]) for f in families], "bias": b.tolist(), "heat": heat, "threshold": float(max(0.5, strangers.max(initial=0.0) + 0.02))}


def _anchored(text: Column) -> Column:
    """Plain substring tests, which stay in generated code and need no regular expression."""
    found = F.contains(text, F.lit(MARKS[0]))
    for w in MARKS[1:]:
        found = found | F.contains(text, F.lit(w))
    return found | _stemmed(F.lower(text))


def _stemmed(lower: Column) -> Column:
    found = F.contains(lower, F.lit(STEMS[0]))
    for w in STEMS[1:]:
        found = found | F.contains(lower, F.lit(w))
    return found


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is made once: an inner function would make it again for each of its elements."""
    return F.get(F.transform(F.array(value), f), 0)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def _pairs(words: Column) -> Column:
    """Each two words in a row, as text."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, paragraph, family, probability, similarity, confirmed): a row
    for each paragraph (text between line feeds; line counts from 0) whose family
    is known or that holds one of STEMS or MARKS.  Every paragraph is judged: one
    without a feature of the model is unknown by its biases.  A long paragraph that
    does not confirm as a whole is judged by its best window.

    family is ``unknown`` where prose or no family clears the calibrated
    threshold; confirmed: a known family whose templates hold CONFIRM of the
    paragraph's n-grams.  A null or empty text has no paragraphs; repeated rows
    of one id and text give one finding; null ids are kept; an empty table gives
    an empty result; other columns are ignored.  Work is linear in a paragraph's
    length, and nothing but findings is shuffled.
    """
    m = model()
    families, weights, last = m["families"], m["weights"], len(m["families"]) - 1
    features = list(weights)
    # A paragraph has to hold a feature that speaks for some family more than for prose, and each of these has a telling word.
    raising = [g for g, w in weights.items() if max(w[:-1]) > w[-1]]
    telling = sorted({max((w for w in g.split(" ") if w not in COMMON), key=lambda w: (len(w), w)) for g in raising})
    has_word = lambda words: F.exists(words, lambda w: w.isin(telling))
    has_feature = lambda words: F.exists(words, lambda w: w.isin(raising)) | F.exists(_pairs(words), lambda g: g.isin(raising))

    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t")).where(_anchored(F.col("_t")) | has_word(_words(F.col("_t"))))
    lines = texts.select("doc_id", F.posexplode(F.split("_t", "\n", -1)).alias("line", "paragraph"))
    lines = lines.withColumn("_a", _anchored(F.col("paragraph"))).withColumn("_w", _words(F.col("paragraph")))
    lines = lines.where(F.col("_a") | has_word(F.col("_w")) & _bound(F.col("_w"), has_feature))

    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    table, bias = constant(list(weights.values()), "array<array<double>>"), constant(m["bias"], "array<double>")
    names, places, templates = constant(features, "array<string>"), constant(families, "array<string>"), constant(m["templates"], "array<array<string>>")

    def judged(words: Column, part: Column) -> Column:
        """One part's verdict, in the order of preference: confirmed, the whole, the likelier, the first."""

        def of_grams(grams: Column) -> Column:
            hits = F.filter(grams, lambda g: g.isin(features))
            sums = F.aggregate(hits, F.transform(bias, lambda b: F.lit(0.0)), lambda total, g: F.zip_with(total, F.element_at(table, F.array_position(names, g).cast("int")), lambda a, b: a + b))
            logits = F.zip_with(sums, bias, lambda s, b: (s / F.sqrt(F.size(grams)) + b) / F.lit(m["heat"]))
            return _bound(F.when(F.size(grams) > 0, logits).otherwise(bias), lambda z: of_logits(z, F.array_max(z), grams))

        def of_logits(z: Column, top: Column, grams: Column) -> Column:
            scale = F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))
            return _bound(F.struct((F.array_position(z, top).cast("int") - 1).alias("best"), (1 / scale).alias("p")), lambda x: of_best(x["best"], x["p"], grams))

        def of_best(best: Column, p: Column, grams: Column) -> Column:
            held = F.when(best < last, F.size(F.array_intersect(grams, F.get(templates, best))) / F.size(grams)).otherwise(0.0)
            known = (best < last) & (p >= m["threshold"])
            return _bound(held, lambda h: F.struct((known & (h >= CONFIRM)).alias("confirmed"), (part == 0).alias("whole"), p.alias("probability"), (-part).alias("part"), F.when(known, F.get(places, best)).otherwise(UNKNOWN).alias("family"), h.alias("similarity")))

        return _bound(F.array_distinct(F.concat(words, _pairs(words))), of_grams)

    starts = lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(STRIDE)), lambda i: F.slice(w, i, WINDOW))
    # Of a long paragraph, the windows with a feature; the upper-case marks are lower-case words here.
    telltale = lambda p: F.exists(p, lambda w: w.isin([*telling, *[x.lower() for x in MARKS]])) | _stemmed(F.array_join(p, " "))
    windows = F.array_distinct(F.transform(F.filter(_bound(F.col("_w"), starts), telltale), lambda p: F.array_join(p, " ")))  # as texts, which are hashed
    windows = F.when(F.size("_w") > LONG, F.transform(windows, lambda p: F.split(p, " "))).otherwise(F.array().cast("array<array<string>>"))
    parts = F.transform(F.concat(F.array("_w"), windows), judged)
    # Exploded, so that the filter after it does not judge a second time.
    best = lines.select("doc_id", "line", "paragraph", "_a", F.explode(F.array(F.array_max(parts))).alias("_b")).where(F.col("_a") | (F.col("_b.family") != UNKNOWN))
    return best.select("doc_id", "line", "paragraph", "_b.family", "_b.probability", "_b.similarity", "_b.confirmed").distinct()
