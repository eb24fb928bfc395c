"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Units are the non-blank lines of a document and, since notices are wrapped, each block of lines between blank lines and all
runs of ``WINDOW`` lines within it. Their word 1- to 3-grams, as far as the notices or their denials have them, go to a multinomial
logistic regression over licence families and ``unknown``. It is fitted on the reference notices below and on denials of them, and
as ``unknown`` on half of the lines of all the corpus's blocks that speak of no licence (by hash of the line; together they weigh ``NEGATIVES``). The other
half is held out to calibrate: a family is accepted only above a probability that at most ``FALSE_RATE`` of the held-out lines reach. Lines of
the same known grams are one row with a count. An
accepted family is confirmed where the unit holds ``COVER`` of the words of one of its notices; notices of up to ``SHORT`` words
(headings) count only in units of at most twice their words. Units that cannot hold ``COVER`` of any notice's words are not
classified: of each notice, one word more than may be missing is looked for, so this loses nothing. A family counts once
per line that states it, or once for a block whose lines state it only together. ``n_paragraphs`` counts non-blank lines.

Only DataFrame functions and the JVM side of pyspark.ml are used.

Edge cases: null and empty texts have no paragraphs and no licence; equal paragraphs get equal results; rows with a null
or repeated doc_id share what is found under that id; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache, reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, saved

NEGATIVES, FALSE_RATE, COVER = 2_000.0, 0.001, 0.8
WINDOW, SHORT = 4, 4
BLANK = r"\n(?:[ \t-\r]*\n)+"
SPEAKS = ("licen", "copyright", "redistribut", "warrant", "spdx", "unencumbered")
UNKNOWN = "unknown"

# Notices by which works commonly state their licence, headings and paragraphs of full texts, by family.
NOTICES = {
    "agpl": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Apache License Version 2.0, January 2004",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Released under the BSD License",
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY 4.0",
        "Licensed under CC BY-SA 4.0",
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "epl": (
        "Eclipse Public License - v 2.0",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works",
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "SPDX-License-Identifier: Unlicense",
    ),
    UNKNOWN: (
        "A driving license is required for this position",
        "The license of the restaurant was renewed by the city this year",
        "All rights are reserved by the publisher of this work",
        "The terms of the contract are subject to change",
        "This version of the file was released in the spring",
        "The work is published under the general direction of the public library",
    ),
}
FAMILIES = sorted(NOTICES)
# Beginnings of notices, and how a text denies or asks what they state.
STATES = ("Licensed under", "Released under", "This work is licensed under")
DENIES = ("Not licensed under", "This software is not released under", "It is no longer licensed under", "Neither released nor licensed under", "We will never release it under", "Is this licensed under")


def denials() -> list[str]:
    """Sentences that hold a notice's words but state no licence."""
    rests = sorted({n[len(s) :] for f, all_ in NOTICES.items() if f != UNKNOWN for n in all_ for s in STATES if n.startswith(s) and len(n) < 80})
    return [d + r for d in DENIES for r in rests]


@lru_cache(1)
def gate_words() -> tuple[str, ...]:
    """A lower-cased unit without any of these holds less than COVER of the words of every notice."""
    found: set[str] = set()
    for notice in (n for f, all_ in NOTICES.items() if f != UNKNOWN for n in all_):
        own = sorted({w for w in re.findall(r"[^\W_]+", notice.lower())}, key=lambda w: (-len(w), w))
        found |= set(own[: len(own) - math.ceil(COVER * len(own) - 1e-9) + 1])
    return tuple(sorted(w for w in found if not any(o != w and o in w for o in found)))


def gated(text: Column) -> Column:
    """Whether a text holds a gate word. Plain searches, one for each, are much cheaper than one pattern of alternatives."""

    def any_of(t: Column) -> Column:
        out = F.lit(False)
        for w in gate_words():
            out = out | t.contains(w)
        return out

    return let(F.lower(text), any_of)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_grams(tokens: Column) -> Column:
    """The words, pairs and triples of neighbouring words; null where one of the words is."""

    def grams(t: Column) -> Column:
        pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return let(pairs, lambda p: F.concat(t, p, F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(t) - 2, F.lit(0))), F.slice(t, F.lit(3), F.greatest(F.size(t) - 2, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))))

    return let(tokens, grams)


def _counts(rows: DataFrame, known: CountVectorizerModel) -> DataFrame:
    """``rows`` with a vector of the known grams that each paragraph has."""
    single = [g for g in known.vocabulary if " " not in g]
    # No known gram has an unknown word, so most grams need not be made.
    tokens = F.transform(words(F.col("paragraph")), lambda t: F.when(t.isin(single), t))
    return known.transform(rows.withColumn("grams", F.array_compact(word_grams(tokens)))).drop("grams")


def _features(counted: DataFrame) -> DataFrame:
    """Unit vectors of the known grams, so that length by itself says nothing; no features where there are none."""
    return Normalizer(inputCol="counts", outputCol="features").transform(counted).drop("counts")


def plain_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(paragraph): the non-blank lines of blocks without a word on licences, so no line of a wrapped notice is among them."""
    blocks = docs.select(F.explode(F.split(F.col(text), BLANK)).alias("all")).where(~let(F.lower("all"), lambda t: reduce(or_, map(t.contains, SPEAKS))))
    return blocks.select(F.explode(F.split("all", "\n")).alias("paragraph")).where(F.col("paragraph").rlike(r"\S"))


def units(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, block, line: whether it is one, paragraph) of the units that may hold a notice."""
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(gated(F.col("text")))
    blocks = d.select("doc_id", F.posexplode(F.split("text", BLANK)).alias("block", "all")).where(gated(F.col("all")))
    lines = F.filter(F.split("all", "\n"), lambda x: x.rlike(r"\S"))
    blocks = blocks.select("doc_id", "block", lines.alias("lines"))
    n = F.size("lines")
    unit = lambda line, x: F.struct(F.lit(line).alias("line"), x.alias("paragraph"))
    single = F.transform("lines", lambda x: unit(True, x))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: unit(False, F.array_join(F.slice("lines", i, F.lit(WINDOW)), " ")))
    whole = F.when(n > WINDOW, F.array(unit(False, F.array_join("lines", " ")))).otherwise(F.slice(single, F.lit(1), F.lit(0)))
    every = F.concat(single, F.when(n > 1, runs).otherwise(F.slice(single, F.lit(1), F.lit(0))), whole)
    found = blocks.select("doc_id", "block", F.explode(F.filter(every, lambda u: gated(u["paragraph"]))).alias("u"))
    return found.select("doc_id", "block", "u.line", "u.paragraph")


def fit(rows: DataFrame) -> tuple[CountVectorizerModel, LogisticRegressionModel, float]:
    """The grams, the classifier and the probability above which it is accepted. ``rows``: lines of the corpus that speak of no licence."""
    spark = rows.sparkSession
    told = [(n, float(FAMILIES.index(f)), 20.0) for f, all_ in NOTICES.items() for n in all_] + [(n, float(FAMILIES.index(UNKNOWN)), 20.0) for n in denials()]
    known = spark.createDataFrame(told, "paragraph string, label double, weight double").coalesce(1)
    grams = sorted(r[0] for r in known.select(F.explode(word_grams(words(F.col("paragraph"))))).distinct().collect())  # of the fixed sentences
    vectors = CountVectorizerModel.from_vocabulary(grams, "grams", "counts")
    vectors.setBinary(True)
    held_out = F.substring(F.md5(F.col("paragraph").cast("binary")), 32, 1).isin(*"02468ace")
    lines = _counts(rows.select("paragraph", held_out.alias("held_out")), vectors).groupBy("counts", "held_out").agg(F.count("*").alias("n"))
    lines = saved(lines, "license-lines")
    learn = lines.where(~F.col("held_out"))
    total = learn.agg(F.sum("n")).head()[0] or 1
    learn = learn.select("counts", F.lit(float(FAMILIES.index(UNKNOWN))).alias("label"), (F.col("n") * (NEGATIVES / total)).alias("weight"))
    told = _counts(known, vectors).select("counts", "label", "weight")
    model = LogisticRegression(maxIter=60, regParam=1e-4, weightCol="weight", family="multinomial").fit(_features(told.unionByName(learn)))
    at = FAMILIES.index(UNKNOWN)
    away = model.transform(_features(lines.where("held_out"))).select(F.round(1 - vector_to_array("probability")[at], 6).alias("p"), "n")
    limit = away.agg(F.percentile("p", 1 - FALSE_RATE, F.col("n"))).head()[0]  # over a million distinct values at most
    discard(lines)
    return vectors, model, max(0.5, float(limit or 0.0))


def classify(rows: DataFrame, vectors: CountVectorizerModel, model: LogisticRegressionModel, accept: float) -> DataFrame:
    """``rows`` with family, probability and cover: the best share of a notice's words that the paragraph holds."""
    scored = model.transform(_features(_counts(rows, vectors))).withColumn("_p", vector_to_array("probability"))
    at = FAMILIES.index(UNKNOWN)
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("prediction").cast("int") + 1)
    p = 1 - F.col("_p")[at]
    scored = scored.withColumn("family", F.when((F.col("prediction") != at) & (p >= accept), family).otherwise(F.lit(UNKNOWN))).withColumn("probability", p)
    scored = scored.withColumn("own", F.array_distinct(words(F.col("paragraph"))))
    cover = F.lit(0.0)
    for f, notices in NOTICES.items():
        if f != UNKNOWN:
            shares = [F.when((F.size(s) > SHORT) | (F.size("own") <= 2 * F.size(s)), F.size(F.array_intersect("own", s)) / F.size(s)).otherwise(F.lit(0.0)) for s in (F.array_distinct(words(F.lit(n))) for n in notices)]
            cover = F.when(F.col("family") == f, F.greatest(*shares)).otherwise(cover)
    return scored.withColumn("cover", cover).drop("own", "features", "rawPrediction", "prediction", "_p")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_paragraphs, n_licenses (confirmed), families (sorted, distinct), best: the highest probability confirmed."""
    hits = classify(units(docs, text, key), *fit(plain_lines(docs, text))).where((F.col("family") != UNKNOWN) & (F.col("cover") >= COVER))
    hits = hits.groupBy("doc_id", "block", "family").agg(F.greatest(F.sum(F.col("line").cast("long")), F.lit(1)).alias("n"), F.max("probability").alias("probability"))
    hits = hits.groupBy(F.col("doc_id").alias("_id")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("family")).alias("families"), F.max("probability").alias("best"))
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"\S"))).cast("long")
    d = docs.select(F.col(key).alias("doc_id"), n.alias("n_paragraphs"))
    return d.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).alias("n_licenses"), F.coalesce("families", F.expr("cast(array() as array<string>)")).alias("families"), "best"
    )
