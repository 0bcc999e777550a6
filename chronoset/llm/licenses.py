"""Licence scans: a trained paragraph classifier in DataFrame operations.

Paragraphs (lines, cut at ends of sentences, and the lines of a wrapped sentence together) that have a cue are looked at; a sparse multinomial logistic regression over
their word n-grams names a family or `unknown`, whose probabilities are calibrated on templates held out in turn. A prediction is
confirmed by how much of a template of its family the paragraph repeats. The regression is fitted on the driver to the fixed
templates below (and templates of a user's own), so its size doesn't depend on the documents; its weights are broadcast.

Equal paragraphs (by a 128-bit digest) are classified once, so a notice that many documents share costs no more than one. Which
paragraphs are looked at is decided by the cues, not by the model: a statement without any of them is not found.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed_join

#: Notices by family; `unknown` speaks of rights or terms without a family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "Licensed under the MIT license, see the LICENSE file.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "This work is released under the Apache License 2.0.", "Apache License Version 2.0, January 2004"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL v3.", "Licensed under GPLv3.", "GNU General Public License v3.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPL v2.", "Licensed under GPLv2."),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-3.0-or-later", "Released under the LGPL.", "Licensed under the terms of the GNU Lesser General Public License."),
    "AGPL": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL.", "Licensed under the terms of the GNU Affero General Public License."),
    "BSD": ("Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL 2.0 license."),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "Licensed under the ISC license.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "CC0": ("Released into the public domain under CC0.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.", "This work is dedicated to the public domain.", "This is free and unencumbered software released into the public domain."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Available under the Creative Commons Attribution license."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0."),
    "proprietary": ("All rights reserved.", "Copyright 2020 the company. All rights reserved.", "This document is confidential and proprietary; no part may be reproduced without permission.", "Unauthorized copying of this file is strictly prohibited."),
    "unknown": ("Licensed under the terms in the file LICENSE.", "See the license for details.", "Used under license.", "Copyright 2019 the authors.", "The driver must hold a valid license.", "A license is required to sell goods here.", "Copyright law protects the author.", "The rights of the people.", "A public domain was opened to visitors.", "Permission was given to enter the building.", "Licensed dealers only.", "The warranty ends after two years.", "This is released under another licence.", "The work is licensed.", "Version 2.0 of the program was released.", "Version 3 was released in the general public."),
}
#: A paragraph without any of these has no licence statement.
CUE = r"(?i)(?=[abcgilmprsuw])(?:licen[cs]|c(?:opy(?:right|left)|reative\s+commons)|\bcc(?:0\b|[\s-]by\b)|r(?:ights\s+reserved|edistribut)|p(?:ublic\s+domain|ermission|roprietary)|spdx|g(?:pl|eneral\s+public)|un(?:authorized\s+copying|encumbered)|\bunder\s+(?:the\s+)?(?:mit|isc)\b|mozilla\s+public|\bmpl|warranty|\bapache|\bbsd|(?-i:\b(?:MIT|ISC)\b))"
_SPLIT = r"\n+|(?<=[.!?])\s+"
#: Begins a line that follows an empty one.
_NEW = "\u0001"
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Words in a row of the longest n-gram.
LONGEST = 3


class Model(NamedTuple):
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    cooling: float
    templates: list[tuple[str, list[str]]]  # family, two-word grams


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def grams_of(words: list[str], longest: int = LONGEST) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regress(x: np.ndarray, y: np.ndarray, k: int, l1: float, l2: float, rounds: int = 400, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial regression by proximal gradient steps with momentum: weights of little use become 0."""
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    v, c = w, b
    one = np.eye(k)[y]
    for t in range(rounds):
        p = _softmax(x @ v + c) - one
        new = v - rate * (x.T @ p / len(y) + l2 * v)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        c2 = c - rate * p.mean(axis=0)
        m = t / (t + 3)
        v, c = new + m * (new - w), c2 + m * (c2 - b)
        w, b = new, c2
    return w, b


def fit(templates: dict[str, tuple[str, ...]] | None = None, l1: float = 2e-4, l2: float = 1e-4, folds: int = 4) -> Model:
    """The model of fixed templates; templates must have the family `unknown`.

    The cooling factor, by which log-odds are divided, is the one of a small grid that fits templates held out in turn best.
    """
    templates = templates or TEMPLATES
    families = sorted(templates)
    rows = [(families.index(f), words_of(t)) for f in families for t in templates[f]]
    names = sorted({g for _, w in rows for g in grams_of(w)})
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (_, w) in enumerate(rows):
        own = grams_of(w)
        x[i, [at[g] for g in own]] = 1
    y = np.array([r[0] for r in rows])
    fold = np.concatenate([np.arange(len(templates[f])) % folds for f in families])
    held = np.zeros((len(rows), len(families)))
    for i in range(folds):
        w, b = _regress(x[fold != i], y[fold != i], len(families), l1, l2)
        held[fold == i] = x[fold == i] @ w + b
    cooling = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(_softmax(held / t)[np.arange(len(y)), y] + 1e-12).mean())
    w, b = _regress(x, y, len(families), l1, l2)
    some = {g: [round(float(v), 6) for v in w[i]] for g, i in at.items() if np.abs(w[i]).max() > 1e-6}
    pairs = [(f, sorted({" ".join(p) for p in zip(v, v[1:], strict=False)} or set(v))) for f in families if f != "unknown" for t in templates[f] for v in [words_of(t)]]
    return Model(families, some, [round(float(v), 6) for v in b], cooling, pairs)


def _table(spark, rows: list[dict], schema: str) -> DataFrame:  # noqa: ANN001
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<{schema}>")))


def _grams(words: F.Column, n: int) -> F.Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _statements(text: F.Column) -> F.Column:
    """(place, lines) of each sentence: a line that doesn't end one, or stand before an empty line, goes on in the next."""
    marked = F.regexp_replace(F.translate(text, _NEW, " "), r"(?<![.!?\s])(\n{2,})", f"$1{_NEW}")
    before = lambda ps, i: F.get(ps, i - 1)
    begins = lambda ps, i: (i == 0) | F.get(ps, i).startswith(_NEW) | F.right(before(ps, i), F.lit(1)).isin(".", "!", "?") | (F.trim(F.regexp_replace(before(ps, i), r"\s", " ")) == "")
    cut = lambda ps, at: F.transform(at, lambda b, j: F.struct(b.alias("place"), F.transform(F.slice(ps, b + 1, F.coalesce(F.get(at, j + 1), F.size(ps)) - b), lambda x: F.translate(x, _NEW, "")).alias("lines")))
    each = lambda ps: F.get(F.transform(F.array(F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: begins(ps, i))), lambda at: cut(ps, at)), F.lit(0))
    return F.get(F.transform(F.array(F.split(marked, _SPLIT)), each), F.lit(0))  # a lambda's variable is computed once


def _wrapped(found: DataFrame) -> DataFrame:
    """found with one reading of each wrapped sentence.

    Its lines together are a row if they repeat more of a template than any line of the family, or if no line has a cue by itself;
    then lines that repeat less than they do are not. Otherwise its lines are.
    """
    alone, lines = found.where("whole is null"), found.where("whole is not null")
    line = F.when(~F.col("joined"), F.struct("family", "overlap"))
    whole = F.max(F.when(F.col("joined"), F.struct("family", "overlap", "confirmed")))
    per = lines.groupBy("whole").agg(whole.alias("j"), F.collect_set(line).alias("lines"))
    own = F.array_max(F.transform(F.filter("lines", lambda x: x["family"] == F.col("j.family")), lambda x: x["overlap"]))
    wins = F.col("j").isNotNull() & ((F.size("lines") == 0) | (F.col("j.confirmed") & (F.col("j.overlap") > F.coalesce(own, F.lit(-1.0)))))
    per = cut(per.select("whole", F.when(wins, F.col("j.overlap")).alias("least")))
    kept = keyed_join(lines, per, "whole").where(F.when(F.col("joined"), F.col("least").isNotNull()).otherwise(F.col("least").isNull() | (F.col("overlap") >= F.col("least"))))
    return alone.union(kept.select(alone.columns))


def scan(docs: DataFrame, model: Model | None = None, least: float = 0.5, confirm: float = 0.5) -> DataFrame:
    """(doc_id, place, paragraph, family, probability, overlap, confirmed) of each paragraph found to state a licence.

    place: of the paragraph, or the first line of a wrapped one, among those of the whole text, from 0. family: the likeliest, if its probability is `least` or more,
    or `unknown`. overlap: the largest share of a template of the family that the paragraph repeats, as two-word grams; confirmed:
    overlap >= confirm; for `unknown` both are 0 and false. docs: doc_id, text; other columns don't matter. A null or empty text
    states none; repeated rows report theirs once; a null doc_id stays; an empty table gives no rows.
    """
    model = model or fit()
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(CUE))
    lines = texts.select("doc_id", F.explode(_statements(F.col("text"))).alias("s")).select("doc_id", "s.place", "s.lines")
    lines = lines.where(F.concat_ws("\n", "lines").rlike(CUE)).withColumn("whole", F.when(F.size("lines") > 1, F.md5(F.concat_ws("\n", "lines").cast("binary"))))
    row = lambda k, p, j: F.struct((F.col("place") + k).alias("place"), p.alias("paragraph"), F.lit(j).alias("joined"))
    rows = F.concat(F.transform("lines", lambda x, k: row(k, x, False)), F.when(F.col("whole").isNotNull(), F.array(row(F.lit(0), F.concat_ws("\n", "lines"), True))).otherwise(F.array()))
    digest = F.md5(F.col("paragraph").cast("binary"))
    found = lines.select("doc_id", "whole", F.explode(rows).alias("r")).select("doc_id", "whole", "r.*").where(F.col("paragraph").rlike(CUE))
    found = cut(found.distinct().withColumn("digest", digest))  # texts are read and matched once
    words = F.regexp_extract_all(F.lower("paragraph"), F.lit(_WORD), F.lit(0))
    each = found.select("digest", "paragraph").distinct().select("digest", words.alias("words"))
    grams = F.array_distinct(F.concat(*[_grams(F.col("words"), n) for n in range(1, LONGEST + 1)]))
    weights = _table(spark, [{"gram": g, "w": w} for g, w in sorted(model.weights.items())], "struct<gram:string,w:array<double>>")
    k = len(model.families)
    hit = each.select("digest", F.explode_outer(grams).alias("gram")).join(F.broadcast(weights), "gram", "left")  # without a known gram, the bias decides
    sums = hit.groupBy("digest").agg(*[F.round(F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)), 6).alias(f"z{i}") for i in range(k)])
    z = F.array(*[(F.col(f"z{i}") + model.bias[i]) / model.cooling for i in range(k)])
    top = F.array_max("z")
    p = F.transform("z", lambda v: F.exp(v - top) / F.aggregate("z", F.lit(0.0), lambda a, b: a + F.exp(b - top)))
    named = sums.withColumn("z", z).withColumn("p", p).withColumn("best", F.array_max("p"))
    family = F.element_at(F.array(*[F.lit(f) for f in model.families]), F.array_position("p", F.col("best")).cast("int"))
    named = named.select("digest", F.when(F.col("best") >= least, family).otherwise("unknown").alias("family"), F.round("best", 6).alias("probability"))
    known = _table(spark, [{"family": f, "pairs": p, "n": len(p)} for f, p in model.templates], "struct<family:string,pairs:array<string>,n:int>")
    own = each.select("digest", F.when(F.size("words") > 1, _grams(F.col("words"), 2)).otherwise(F.col("words")).alias("own"))
    like = named.where("family != 'unknown'").join(own, "digest").join(F.broadcast(known), "family")
    like = like.select("digest", (F.size(F.array_intersect("pairs", "own")) / F.col("n")).alias("share")).groupBy("digest").agg(F.round(F.max("share"), 6).alias("overlap"))
    named = named.join(like, "digest", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0))).withColumn("confirmed", F.col("overlap") >= confirm)
    return _wrapped(keyed_join(found, cut(named), "digest")).select("doc_id", "place", "paragraph", "family", "probability", "overlap", "confirmed")
