"""Licence scan with a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line of a text, or some lines in a row without one between them that has no words: notices are often
wrapped.  Lines are joined from each line on as far as a notice that begins in it can reach, the first and the last with their
nearest `LONGEST` words, without what stands before and after words, such as comment signs.  Words and runs of two and three words are its features; a sparse logistic
regression gives each licence family, and `unknown`, a probability.  The regression is fitted on a bounded sample made
by rule from templates of licence notices (words dropped, words of other prose around them) and from prose that speaks of licences
and permissions otherwise.  A temperature calibrates the probabilities: it is fitted on thirds of the templates and of the prose, each judged by a
regression that saw the other two thirds alone, so `unknown` is learned from notices and prose that are new.
A family is reported where its probability is at least `least` and the paragraph also
contains `confirm` of the word pairs of one of the family's templates.  Of findings of one family that overlap, the one of fewest
lines stands, then the first.

Texts that cannot confirm any template are not judged: `telling_words` derives from the templates words of which every confirming paragraph has
one, so this spares work and changes nothing.

Defined results: null and empty texts have no findings; equal probabilities go to the first family in order; repeated rows are scanned each; other
columns stay, and the findings take the place of a column of their name; a text of any length is scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import bound, constant_doubles, placed

#: Notices by which licences are commonly declared, by family.
TEMPLATES = {
    "Apache-2.0": [
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "This project is released under the terms of the Apache License 2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "MIT": [
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License",
        "This software is licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "BSD": [
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License",
        "Licensed under the simplified BSD license",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "GPL": [
        "Released under GPLv2",
        "Licensed under the GPL v3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "Released under the GNU GPL license version 2 or later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "Released under the LGPL license",
    ],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3", "Released under the AGPL license"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "Licensed under the Eclipse Public License"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0", "Released into the public domain under the CC0 license"],
    "Unlicense": ["This is free and unencumbered software released into the public domain under the Unlicense license"],
    "Proprietary": ["Copyright. All rights reserved", "This software is proprietary and confidential; unauthorized copying of this file without permission is strictly prohibited", "No part of this publication may be reproduced without the prior written permission of the publisher"],
}
#: Prose with the same words that declares no licence.
PROSE = """
She renewed her driving license at the office last week
A fishing license is required for anyone over sixteen
You need the permission of your parents to join the trip
The court discussed copyright and patents at length on Monday
The doctor lost his medical license after the trial
The warranty of the washing machine ended two years ago
He asked for permission to leave the table
The city grants a business license to every shop on the street
Which license should I choose for my project
The license plate of the car was covered with mud
The author explains how open source licenses differ
The public library asked for a domain name
Poetic license lets the writer bend the truth
Copyright law protects authors for many years after death
The bank gave her permission to open a second account
Distribution of food and water began in the morning
They may not use this road without permission from the owner
All rights and duties of members are listed in the charter
""".strip().split("\n")
_FILLER = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
#: Words of the longest template.
LONGEST = max(len(re.findall("[a-z0-9]+", t.lower())) for ts in TEMPLATES.values() for t in ts)
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
_BUCKETS = 1 << 15


def _pairs_of(template: str) -> list[str]:
    words = re.findall("[a-z0-9]+", template.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def telling_words(confirm: float) -> list[str]:
    """Words of which every paragraph has one, by itself or in a longer word, that contains the share `confirm` of the word pairs of any template.

    Of each template fewer than that share of the pairs are without any of the words, so pairs without them never confirm it.  Words are taken
    one by one, by how many pairs of templates still open they are in; short words, and those of other prose, count less.
    """
    prose = Counter(re.findall("[a-z0-9]+", " ".join([*PROSE, *_FILLER * 20]).lower()))
    worth = lambda w: 4.0 ** min(0, len(w) - 7) / (1 + 20 * prose[w])
    pairs, words = [_pairs_of(t) for ts in TEMPLATES.values() for t in ts], []
    while still := [free for own in pairs if len(free := [p for p in own if not any(w in p for w in words)]) >= confirm * len(own)]:
        known = {w for free in still for p in free for w in p.split()}
        words.append(max(sorted(known), key=lambda w: worth(w) * sum(w in p for free in still for p in free)))
    return words


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, by their first letters."""
    first = {w[:1]: [v[1:] for v in sorted(words) if v[:1] == w[:1]] for w in sorted(words)}
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items())


def grams(paragraph: Column, longest: int = 3) -> Column:
    """The distinct words and runs of up to `longest` words of a paragraph."""

    def all_runs(words: Column) -> Column:
        runs = lambda n: F.filter(F.transform(words, lambda w, i: F.when(i + n <= F.size(words), F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))), lambda g: g.isNotNull())
        return F.array_distinct(F.concat(words, *[runs(n) for n in range(2, longest + 1)]))

    return bound(F.regexp_extract_all(F.lower(paragraph), F.lit("[a-z0-9]+"), F.lit(0)), all_runs)


def _buckets(of: Column) -> Column:
    return F.transform(of, lambda g: F.pmod(F.xxhash64(g), F.lit(_BUCKETS)).cast("int"))


def labelled_samples(spark: SparkSession, n: int = 2_000) -> DataFrame:
    """(id, source, label, text): paragraphs made by rule; label is the place in FAMILIES, source the notice or prose one is made from."""
    notices = [(t, FAMILIES.index(f)) for f, ts in TEMPLATES.items() for t in ts]
    prose = [(t, 0) for t in PROSE]
    plain = [(" ".join(_FILLER[(7 * i + 11 * k + i * k) % len(_FILLER)] for k in range(12)), 0) for i in range(len(notices))]
    source = spark.createDataFrame([(i, *x) for i, x in enumerate(notices + prose + plain)], "source int, text string, label int")
    size = len(notices + prose + plain)
    chance = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000))
    filler = F.array(*map(F.lit, _FILLER))
    around = lambda salt: F.array_join(F.transform(F.sequence(F.lit(1), (chance(salt) % 8 + 1).cast("int")), lambda k: F.element_at(filler, (F.pmod(F.xxhash64("id", F.lit(salt), k), F.lit(len(_FILLER))) + 1).cast("int"))), " ")
    kept = F.array_join(F.filter(F.split("text", " "), lambda w, k: F.pmod(F.xxhash64("id", k), F.lit(100)) >= F.when(chance(3) < 400, F.lit(0)).otherwise(F.lit(8))), " ")
    made = spark.range(n).withColumn("source", (F.col("id") % size).cast("int")).join(F.broadcast(source), "source")
    return made.select("id", "source", "label", F.concat_ws(" ", F.when(chance(1) < 400, around(11)), kept, F.when(chance(2) < 400, around(12))).alias("text"))


@dataclass
class LicenceModel:
    place: np.ndarray  # of each bucket among the weights; 0: no feature
    weights: np.ndarray  # (features + 1, families); row 0 is 0
    bias: np.ndarray
    temperature: float


#: Parts of the templates and prose; each is judged by a regression on the others to calibrate.
FOLDS = 3


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values that belong to each of n; `of` ascends."""
    starts = np.searchsorted(of, np.arange(n + 1))
    some = np.flatnonzero(np.diff(starts))
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(some):
        out[some] = np.add.reduceat(values, starts[some])
    return out


def _fit(row: np.ndarray, feature: np.ndarray, y: np.ndarray, features: int, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of samples with labels y; row, feature: the features of each, in order of row."""
    w, bias, target = np.zeros((features, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32), np.eye(len(FAMILIES), dtype=np.float32)[y]
    order = np.argsort(feature, kind="stable")
    by_row, by_feature = row[order], feature[order]
    for _ in range(rounds if len(y) else 0):
        g = (_softmax(_sums(w[feature], row, len(y)) + bias) - target) / len(y)
        w -= rate * (_sums(g[by_row], by_feature, features) + decay * w)
        bias -= rate * g.sum(0)
    return w, bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(samples: DataFrame, *, rounds: int = 150, rate: float = 2.0, decay: float = 1e-3, least_rows: int = 4) -> LicenceModel:
    """Fits the regression on the driver by gradient descent; samples (id, source, label, text) are a bounded set made by rule.

    least_rows: samples that a feature must be in.
    """
    rows = samples.select("id", "source", "label", _buckets(grams(F.col("text"))).alias("f")).orderBy("id").collect()
    seen = np.bincount([b for r in rows for b in r["f"]], minlength=_BUCKETS)
    used = np.flatnonzero(seen >= least_rows)
    place = np.zeros(_BUCKETS, np.int64)
    place[used] = np.arange(1, len(used) + 1)
    y, fold = (np.array([r[c] for r in rows], np.int64) for c in ("label", "source"))
    pairs = [(i, f) for i, r in enumerate(rows) for f in sorted({int(x) for x in place[r["f"]]} - {0})]
    row, feature = np.array(pairs, np.int64).reshape(-1, 2).T
    logits = np.zeros((len(rows), len(FAMILIES)), np.float32)
    for k in range(FOLDS):
        own = fold % FOLDS == k
        other = np.flatnonzero(~own)
        some = ~own[row]
        w, bias = _fit(np.searchsorted(other, row[some]), feature[some], y[other], len(used) + 1, rounds, rate, decay)
        logits[own] = _sums(w[feature], row, len(rows))[own] + bias
    known = np.array([len({s for s, z in zip(fold, y, strict=True) if z == label}) >= FOLDS for label in range(len(FAMILIES))], bool)  # families that the other parts had seen
    new = known[y] if len(y) else np.zeros(0, bool)
    loss = lambda heat: -np.log(np.maximum(_softmax(logits[new] / heat)[np.arange(new.sum()), y[new]], 1e-12)).sum()
    temperature = min((0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0), key=loss) if new.any() else 1.0
    w, bias = _fit(row, feature, y, len(used) + 1, rounds, rate, decay)
    return LicenceModel(place, w, bias, temperature)


def _judge(features: Column, model: LicenceModel, weights: Column) -> Column:
    """(rank of the family, its probability) of the weights' rows that a paragraph uses."""
    width = len(FAMILIES)
    logits = F.aggregate(features, constant_doubles(model.bias), lambda acc, p: F.transform(acc, lambda z, k: z + F.get(weights, p * width + k)), lambda acc: F.transform(acc, lambda z: z / model.temperature))

    def best(z: Column) -> Column:
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        return F.struct((F.array_position(z, top) - 1).cast("int").alias("rank"), (1 / total).alias("p"))

    return bound(logits, best)


def _template_pairs() -> Column:
    """By family, the word pairs of each template: one constant."""
    none = F.array().cast("array<array<string>>")
    return F.array(none, *[F.array(*[F.split(F.lit("|".join(_pairs_of(t))), r"\|") for t in templates]) for templates in TEMPLATES.values()])


_LINE, _WINDOW = "struct<start:int,text:string,words:array<string>,tells:boolean>", "struct<start:int,end:int,lines:int,paragraph:string,tells:boolean>"


def _windows(lines: Column, line: Column, place: Column) -> Column:
    """The paragraphs that begin in a line, of those with a line that tells: itself, and with each line after it as far as a notice that begins in it can reach."""
    end = lambda x: x["start"] + F.length(x["text"])
    size, after = F.size(line["words"]), F.slice(lines, place + 2, F.lit(LONGEST))
    none = F.array().cast(f"array<{_WINDOW}>")
    own = F.struct(line["start"].alias("start"), end(line).alias("end"), F.lit(1).alias("lines"), line["text"].alias("paragraph"), line["tells"].alias("tells"))
    tail = F.slice(line["words"], F.greatest(F.lit(1), size - LONGEST + 1), LONGEST)

    def longer(acc: Column, x: Column) -> Column:
        words, tells = F.concat(acc["words"], F.slice(x["words"], 1, LONGEST)), acc["tells"] | x["tells"]
        more = F.struct(line["start"].alias("start"), end(x).alias("end"), (F.size(acc["out"]) + 1).alias("lines"), F.array_join(words, " ").alias("paragraph"), tells.alias("tells"))
        reach = acc["after"] + F.size(x["words"])
        goes = F.struct(words.alias("words"), F.concat(acc["out"], F.array(more)).alias("out"), reach.alias("after"), ((reach < LONGEST) & (F.size(x["words"]) > 0)).alias("on"), tells.alias("tells"))
        ends = F.struct(acc["words"].alias("words"), acc["out"].alias("out"), acc["after"].alias("after"), F.lit(False).alias("on"), acc["tells"].alias("tells"))
        return F.when(acc["on"] & (F.size(x["words"]) > 0), goes).otherwise(ends)

    begin = F.struct(tail.alias("words"), F.array(own).cast(f"array<{_WINDOW}>").alias("out"), F.lit(0).alias("after"), F.lit(True).alias("on"), line["tells"].alias("tells"))
    some = (size > 0) & (line["tells"] | F.exists(after, lambda x: x["tells"]))
    return F.when(some, F.filter(F.aggregate(after, begin, longer)["out"], lambda w: w["tells"])).otherwise(none)


def find_licences(docs: DataFrame, model: LicenceModel, *, text: str = "text", found: str = "licences", least: float = 0.5, confirm: float = 0.6) -> DataFrame:
    """docs with the declared licences of each text: an array of (start, end, family, p) in order; code points, end exclusive."""
    whole = F.coalesce(F.col(text), F.lit(""))
    telling = _any_of(telling_words(confirm))
    cut = F.transform(F.split(whole, "\n", -1), lambda x: F.struct(x.alias("text"), F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words")))
    line = lambda x, at: F.struct(at.alias("start"), x["text"].alias("text"), x["words"].alias("words"), F.lower(x["text"]).rlike(telling).alias("tells"))
    lines = placed(cut, _LINE, lambda x: F.length(x["text"]) + 1, line)
    candidates = bound(lines, lambda held: F.flatten(F.transform(held, lambda x, i: _windows(held, x, i))))

    def judged(c: Column, place: Column, weights: Column) -> Column:
        def with_grams(g: Column) -> Column:
            used = F.filter(F.transform(_buckets(g), lambda b: F.get(place, b)), lambda p: p > 0)
            return F.struct(c["lines"].alias("lines"), c["start"].alias("start"), c["end"].alias("end"), g.alias("grams"), _judge(used, model, weights).alias("j"))

        return bound(grams(c["paragraph"]), with_grams)

    def confirmed(c: Column, templates: Column) -> Column:
        return F.exists(F.get(templates, c["j"]["rank"]), lambda t: F.size(F.array_intersect(c["grams"], t)) >= confirm * F.size(t))

    def known(some: Column) -> Column:
        """The confirmed findings of the candidates, with the model's constants computed once."""
        one = lambda c: bound(constant_doubles(model.place).cast("array<int>"), lambda place: bound(constant_doubles(model.weights.ravel()), lambda weights: judged(c, place, weights)))
        return F.filter(F.transform(some, one), lambda c: (c["j"]["rank"] > 0) & (c["j"]["p"] >= least) & confirmed(c, _template_pairs()))

    none = F.array().cast(f"array<{_WINDOW}>")
    kept = known(F.when(F.lower(whole).rlike(telling), candidates).otherwise(none))
    ordered = F.array_sort(F.transform(kept, lambda c: F.struct(c["lines"].alias("lines"), c["start"].alias("start"), c["end"].alias("end"), c["j"].alias("j"))))
    apart = lambda c, k: (k["j"]["rank"] != c["j"]["rank"]) | (k["end"] <= c["start"]) | (c["end"] <= k["start"])
    first = bound(ordered, lambda o: F.aggregate(o, F.filter(o, lambda c: F.lit(False)), lambda acc, c: F.when(F.forall(acc, lambda k: apart(c, k)), F.concat(acc, F.array(c))).otherwise(acc)))
    names = F.array(*map(F.lit, FAMILIES))
    named = F.transform(first, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.get(names, c["j"]["rank"]).alias("family"), c["j"]["p"].alias("p")))
    return docs.withColumn(found, F.array_sort(named))
