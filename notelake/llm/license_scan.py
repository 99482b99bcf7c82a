"""Licence scans by a trained paragraph classifier, in DataFrame and SQL functions alone.

A multinomial logistic regression over hashed word n-grams (1 and 2) tells licence families and `unknown`
apart. It is trained here on variants of the templates below, on notices of licences outside of the families, and on a bounded sample of the
corpus's own paragraphs that hold less than HARD of any template. A temperature, and the probability above which a family is believed, are
fitted on templates and paragraphs that the first model never saw, so that probabilities are calibrated; the
model that is used then learns from all of them. A prediction counts once a template of the family confirms it: CONFIRM of the template's
word pairs are in the paragraph, and half of those pairs that only this family's templates hold.

A paragraph is a line, or a run of neighbouring lines without a line between that has no letter or digit, as
notices are often wrapped: every run of up to LONGEST words between its first and its last line that begins
with a line of a template's pairs. Marks before a line's first letter or digit, as of comments, don't count. Of runs
that share a line, the one with the highest share of a template is taken, then the shortest.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text

UNKNOWN = "unknown"
FEATURES, CONFIRM = 1 << 14, 0.6
#: Share of a template from which a paragraph of the corpus isn't taken for an unknown one; share of the pairs of its own that a template needs.
HARD, OWN = 0.4, 0.5
#: Rows of the corpus that the unknown class is trained on, about.
SAMPLE_PARAGRAPHS = 3000
#: Share of held-out unknown paragraphs that may seem a family, and bounds of the threshold.
MISTAKEN, LEAST_PROBABILITY, MOST_PROBABILITY = 0.002, 0.5, 0.7
TEMPERATURES = (0.125, 0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0, 4.0)

# Short notices and first sentences of headers by which texts state their licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later", "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "The ASF licenses this file to you under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Distributed under the Apache 2.0 license.",
    ),
    "bsd": (
        "Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "cc0": (
        "Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.",
        "SPDX-License-Identifier: CC-BY-4.0", "This text is available under the Creative Commons Attribution License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-NonCommercial 4.0 International license.",
        "SPDX-License-Identifier: CC-BY-NC-4.0", "This text is available under the Creative Commons Attribution-NonCommercial License.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International license.",
        "SPDX-License-Identifier: CC-BY-ND-4.0", "This text is available under the Creative Commons Attribution-NoDerivatives License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-ShareAlike 4.0 International license.",
        "SPDX-License-Identifier: CC-BY-SA-4.0", "This text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it under the terms of the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program.", "Licensed under the GNU General Public License.", "This file is licensed under the GNU General Public License version 2.",
    ),
    "isc": (
        "Released under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "Licensed under the ISC license.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.", "This library is free software under the terms of the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later", "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mit": (
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: MIT", "Licensed under the MIT license.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": (
        "Released under the Mozilla Public License 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "proprietary": ("All rights reserved.", "No part of this work may be reproduced without the prior written permission of the publisher.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "This document is confidential and proprietary and may not be disclosed to third parties."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense.", "SPDX-License-Identifier: Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
}
# Lines about licences that aren't one, and notices of licences that are in no family here.
NOT_LICENCES = (
    "You need a driving license to rent a car.", "The museum is open to the public on most days.", "She is a licensed nurse at the general hospital.",
    "Permission to land was granted by the tower.", "The version 3 release was delayed again.", "He reserved all the seats in the front.",
    "The foundation published a creative report.", "A free copy of the book was given to any person who asked.", "The law limits the use of water in summer.",
    "Under these conditions the work may continue.", "The commons were fenced in by the duke.", "Attribution of the painting is disputed.",
    "Licensed under the Eclipse Public License, Version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the EUPL, Version 1.2 only.",
    "Licensed under the European Union Public Licence, version 1.2.", "The contents of this file are subject to the terms of the Common Development and Distribution License.", "Released under the zlib License.",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Distributed under the Boost Software License, Version 1.0.",
    "This is free software; you can redistribute it under the terms of the Artistic License 2.0.", "Licensed under the Microsoft Public License.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Released under the PostgreSQL License.", "Licensed under the Academic Free License version 3.0.", "Released under the Python Software Foundation License.", "Licensed under the Open Database License.",
    "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0",
)


def _ngrams(text: str, n: int) -> list[str]:
    """As _runs of _words, here."""
    w = [x for x in re.split(r"[^\w+-]+", text.lower()) if x]
    return [" ".join(x) for x in zip(*[w[k:] for k in range(n)])]


#: The different word pairs of each template.
_PAIRS = {k: [sorted(set(_ngrams(t, 2))) for t in ts] for k, ts in TEMPLATES.items()}
_OTHERS = {k: set().union(*(_ngrams(t, 2) for t in NOT_LICENCES), *(p for o, ts in _PAIRS.items() if o != k for p in ts)) for k in _PAIRS}
#: Of these, those that no template of another family, and no notice of another licence, holds.
_OWN_PAIRS = {k: [[p for p in t if p not in _OTHERS[k]] for t in ts] for k, ts in _PAIRS.items()}


#: Words between the first and the last line of a run, and of each of these in a run: twice those of the longest template.
LONGEST = 2 * max(len(_ngrams(t, 1)) for ts in TEMPLATES.values() for t in ts)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, where a plain use would copy its expression to each place."""
    return F.get(F.transform(F.array(value), then), 0)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}+-]+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Every n consecutive words, with spaces between."""
    some = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
    return _let(words, lambda w: F.when(F.size(w) >= n, some(w)).otherwise(F.array().cast("array<string>")))


def _grams(text: Column) -> Column:
    return _let(_words(text), lambda w: F.concat(w, _runs(w, 2)))


def _variants(text: str) -> list[str]:
    """A template as it may stand in a text: whole, with a word less, within other words, in other cases."""
    w = text.split()
    out = [text, text.upper(), text.lower(), f"Note: {text}", f"{text} See the file for details.", " ".join(w[:-1]), " ".join(w[1:])]
    out += [" ".join(w[:i] + w[i + 1 :]) for i in range(1, len(w) - 1) if len(w) > 5]
    return [v for v in out if v]


@dataclass
class Model:
    """The families in the order of the classes, the classifier, its temperature, and the least probability."""

    names: list[str]
    classifier: LogisticRegressionModel
    temperature: float
    least: float


def _features(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("__grams", _grams(F.col("paragraph")))
    return HashingTF(inputCol="__grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows)


def _probabilities(raw: Column, temperature: float) -> Column:
    scaled = F.transform(vector_to_array(raw), lambda x: x / temperature)
    return _let(scaled, lambda s: F.transform(s, lambda x: 1 / F.aggregate(s, F.lit(0.0), lambda a, y: a + F.exp(y - x))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, place and paragraph: the lines of each text that hold more than white space, which the unknown class is trained on."""
    return id_and_text(docs).select("doc_id", F.posexplode(F.split("text", r"\n")).alias("place", "paragraph")).filter(F.trim("paragraph") != "")


def _share(pairs: Column, least: float) -> Column:
    """Whether an array of word pairs holds at least a share of the pairs of some template."""
    templates = F.array(*[F.lit(t) for ts in _PAIRS.values() for t in ts])
    return F.exists(templates, lambda t: F.size(F.array_intersect(pairs, t)) >= least * F.size(t))


def _confirmed(grams: Column, prediction: Column, names: list[str]) -> Column:
    """The highest share of a template of the predicted family that the n-grams hold, of those with enough of their own pairs; null without any."""
    rows = F.array(*[F.array(*[F.struct(F.lit(t).alias("all"), F.lit(o).cast("array<string>").alias("own")) for t, o in zip(_PAIRS.get(n, [[""]]), _OWN_PAIRS.get(n, [[""]]))]) for n in names])
    held = lambda a, b: F.size(F.array_intersect(a, b))
    each = F.transform(F.get(rows, prediction.cast("int")), lambda t: F.when(held(grams, t["own"]) >= OWN * F.size(t["own"]), held(grams, t["all"]) / F.size(t["all"])))
    return F.array_max(each)


def fit(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE_PARAGRAPHS) -> Model:
    """The model: fitted on the templates' variants and about `sample` of the corpus's paragraphs, calibrated on some held out from a first fit.

    Held out are whole templates with all their variants (of each family the last), every fourth of NOT_LICENCES, and a quarter of the paragraphs.
    """
    names = [UNKNOWN, *sorted(TEMPLATES)]
    known = [(v, float(names.index(k)), i == len(ts) - 1) for k, ts in TEMPLATES.items() for i, t in enumerate(ts) for v in _variants(t)] + [(v, 0.0, i % 4 == 0) for i, t in enumerate(NOT_LICENCES) for v in _variants(t)]
    # a few documents, and of each its paragraphs, by hashes of ids: the same rows whatever the partitions
    n = id_and_text(docs).filter("text is not null").count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1_000_003)) / 1_000_003
    some = paragraphs(docs.filter(place < min(1.0, sample / 8 / max(1, n)))).select("paragraph").distinct()
    others = some.filter(~_let(_runs(_words(F.col("paragraph")), 2), lambda p: _share(p, HARD))).orderBy(F.xxhash64("paragraph"), "paragraph").limit(sample)
    others = others.select("paragraph", F.lit(0.0).alias("label"), (F.pmod(F.xxhash64("paragraph", F.lit(5)), F.lit(4)) == 0).alias("held"))
    rows = spark.createDataFrame(known, "paragraph string, label double, held boolean").unionByName(others)
    rows = _features(rows).select("label", "features", "held").cache()
    try:
        first = _regression(rows.filter("not held"))
        held = first.transform(rows.filter("held")).select("label", "rawPrediction").cache()
        loss = [F.avg(-F.log(F.get(_probabilities(F.col("rawPrediction"), t), F.col("label").cast("int")) + 1e-12)).alias(str(i)) for i, t in enumerate(TEMPERATURES)]
        got = held.agg(*loss).first()
        best = min(range(len(TEMPERATURES)), key=lambda i: (got[i] is None, got[i]))
        p = _probabilities(F.col("rawPrediction"), TEMPERATURES[best])
        high = held.filter("label = 0").select((1 - F.get(p, 0)).alias("p")).approxQuantile("p", [1 - MISTAKEN], 0.0)
        held.unpersist()
        return Model(names, _regression(rows), TEMPERATURES[best], min(MOST_PROBABILITY, max([LEAST_PROBABILITY, *high])))
    finally:
        rows.unpersist()


def _regression(rows: DataFrame) -> LogisticRegressionModel:
    """The regression with the same weight for each class."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.lit(1.0)
    for label, m in sizes.items():
        weight = F.when(F.col("label") == label, 100.0 / m).otherwise(weight)
    return LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, weightCol="weight").fit(rows.withColumn("weight", weight).coalesce(1))


def _runs_of_lines(docs: DataFrame) -> DataFrame:
    """doc_id, version (of the text), first, last and paragraph: the lines and runs of lines that hold enough of a template.

    first and last are places of lines: the block's number in the bits from 32 on, then the line's in it.
    """
    hits = lambda text: F.array_intersect(_runs(_words(text), 2), F.lit(sorted(set().union(*sum(_PAIRS.values(), [])))))
    enough = lambda text: _let(hits(text), lambda h: (F.size(h) > 0) & _share(h, CONFIRM))
    blocks = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split(F.regexp_replace("text", r"\n[^\p{L}\p{N}\n]+", "\n"), r"\n\n+")).alias("block", "lines"))
    blocks = blocks.filter(enough(F.col("lines")))
    # each line with those after it
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[^\p{L}\p{N}]+", ""), r"\s+", " ")
    lines = F.filter(F.transform(F.split("lines", r"\n"), plain), lambda x: x != "")
    after = _let(lines, lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.slice(x, i, LONGEST)))
    starts = blocks.select("doc_id", "version", "block", F.posexplode(after).alias("line", "rest"))
    # of a long line, the run before it or after it has what stands next to it
    tail = F.substring_index(F.get("rest", 0), " ", -LONGEST)
    head = lambda x: F.substring_index(x, " ", LONGEST)
    starts = starts.filter((F.size(hits(F.concat_ws(" ", tail, F.get("rest", 1)))) > 0) | (F.size(hits(F.get("rest", 0))) > 0))
    count = lambda a, x: F.when(a["words"] < LONGEST, F.struct((a["words"] + F.size(_words(x))).alias("words"), (a["lines"] + 1).alias("lines"))).otherwise(a)
    n = F.aggregate(F.slice("rest", 2, LONGEST), F.struct(F.lit(0).alias("words"), F.lit(1).alias("lines")), count)["lines"]
    run = lambda k: F.when(k == 1, F.get("rest", 0)).otherwise(F.concat_ws(" ", tail, F.slice("rest", F.lit(2), F.greatest(k - 2, F.lit(0))), head(F.get("rest", k - 1))))
    starts = starts.select("doc_id", "version", "block", "line", "rest", n.alias("n"))
    runs = starts.select("doc_id", "version", "block", "line", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), run)).alias("more", "paragraph"))
    first = F.shiftleft(F.col("block").cast("long"), 32) + F.col("line")
    # what a notice stands in is left out: the words before its first pair and after its last
    words = _words(F.col("paragraph"))
    found = lambda w: _let(hits(F.col("paragraph")), lambda h: F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_contains(h, F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))))
    core = _let(words, lambda w: _let(found(w), lambda at: F.array_join(F.slice(w, F.get(at, 0), F.element_at(at, -1) - F.get(at, 0) + 2), " ")))
    return runs.filter(enough(F.col("paragraph"))).withColumn("paragraph", F.coalesce(core, "paragraph")).select("doc_id", "version", first.alias("first"), (first + F.col("more")).alias("last"), "paragraph")


def licensed_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, place (of the paragraph's first line), family, probability and template_share of each confirmed licence paragraph."""
    scored = model.classifier.transform(_features(_runs_of_lines(docs)))
    scored = scored.withColumn("__p", _probabilities(F.col("rawPrediction"), model.temperature)).filter(F.col("prediction") > 0)
    scored = scored.withColumn("probability_", F.get("__p", F.col("prediction").cast("int"))).filter(F.col("probability_") >= model.least)
    names = F.array(*[F.lit(n) for n in model.names])
    scored = scored.withColumn("template_share", _confirmed(F.col("__grams"), F.col("prediction"), model.names)).filter(F.col("template_share") >= CONFIRM)
    run = F.struct((-F.col("template_share")).alias("s"), (F.col("last") - F.col("first")).alias("n"), (-F.col("probability_")).alias("p"), "first", "last", F.get(names, F.col("prediction").cast("int")).alias("family"))
    # the best run first, then those that share no line with a better one
    runs = scored.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(run)).alias("runs"))
    apart = lambda kept, r: F.when(F.exists(kept, lambda k: (k["first"] <= r["last"]) & (r["first"] <= k["last"])), kept).otherwise(F.concat(kept, F.array(r)))
    kept = runs.select("doc_id", F.explode(F.aggregate("runs", F.slice("runs", 1, 0), apart)).alias("r"))
    return kept.select("doc_id", F.col("r.first").alias("place"), "r.family", (-F.col("r.p")).alias("probability"), (-F.col("r.s")).alias("template_share"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_licences (licence paragraphs), families (sorted, comma-joined) and probability (the highest) of each row.

    Without a licence, a text, or words: 0, an empty string, and 0. Rows that repeat an id share what is found in
    any of them. An empty table gives no rows. Only doc_id and text are read.
    """
    known = model or fit(docs.sparkSession, docs)
    found = licensed_paragraphs(docs, known).groupBy(F.col("doc_id").alias("id")).agg(
        F.count_distinct(F.struct("place", "family")).alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("f"), F.max("probability").alias("p")
    )
    rows = id_and_text(docs).select("doc_id")
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("f", F.lit("")).alias("families"), F.coalesce("p", F.lit(0.0)).alias("probability"))
