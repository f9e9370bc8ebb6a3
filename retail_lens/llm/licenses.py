"""Licence scans: a trained paragraph classifier names licence families, and a comparison with templates confirms them.

Paragraphs are classified by sparse logistic regression over hashed word n-grams, long ones in overlapping windows, all of them. The model and the comparison run inside the JVM, as DataFrame
transformations.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fingerprint import let

# Openings of the official notices of public licences, by family.
NOTICES = {
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain."),
}
# The families' names. The last of each is never trained on.
NAMES = {
    "apache-2.0": ("Apache License 2.0", "Apache-2.0", "Apache License, Version 2.0", "Apache 2.0 licence"), "mit": ("MIT licence", "MIT License", "MIT terms", "MIT-License"), "bsd": ("BSD license", "BSD 3-Clause License", "BSD-2-Clause", "BSD-3-Clause"),
    "gpl": ("GNU GPL", "GPLv3", "GNU General Public License", "GPL-3.0-or-later", "GNU General Public License version 2"), "lgpl": ("LGPL", "GNU Lesser General Public License", "LGPL-2.1", "GNU LGPL"), "agpl": ("AGPL", "GNU Affero General Public License", "AGPLv3", "GNU AGPL"),
    "mpl": ("MPL 2.0", "Mozilla Public License", "Mozilla Public License 2.0", "MPL-2.0"), "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0", "CC-BY-4.0", "CC BY 3.0"), "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0"), "cc0": ("CC0 1.0", "CC0", "Creative Commons Zero", "CC0 1.0 Universal"),
}
# Notices of families that are not told apart. Those of the second list are never trained on: they show how sure of a family the model is without cause.
STRANGE = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.", "Boost Software License - Version 1.0. Permission is hereby granted to use, reproduce, display and execute the Software.",
    "Do what the fuck you want to public license. Everyone is permitted to copy and distribute verbatim or modified copies of this license document.", "The contents of this file are subject to the Common Development and Distribution License.",
    "Licensed under the European Union Public Licence, version 1.2.", "This license governs use of the accompanying software under the Microsoft Public License.", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, is granted by the PostgreSQL licence.",
    "This software is licensed to you under the end user license agreement; you may not reverse engineer, rent or sublicense it.", "Use of this data is governed by the Open Database License.", "Released under the Unlicense.",
)
HELD_STRANGE = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This is free software; you can redistribute it under the terms of the Artistic License 2.0.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "This file is distributed under the terms of the Python Software Foundation License.",
    "You may use this work under the Zope Public License.", "Licensed under the Academic Free License version 3.0.", "The library is under the ISC License.", "This material is released under the Open Government Licence.",
)
# Paragraphs that use licence words and grant nothing.
OTHER = (
    "All rights reserved.", "Copyright of this text lies with the publisher.", "You need a driving licence to rent this car.", "The shop renewed its liquor license in May.",
    "They asked for permission to enter the garden.", "The warranty covers parts and labour for two years.", "Please ask for permission before you copy this page.", "Her poetic license went too far.",
    "Licensed premises close at eleven.", "He is a licensed electrician.", "No part of this may be reproduced without written permission.",
    "The apache helicopter landed at noon.", "She studied at MIT for three years.", "The gnu grazed near the river.", "Redistribution of income was the issue of the day.",
)
#: Phrases around a licence's name that training texts vary; the last two are held out.
PHRASES = ("available under {}", "is covered by the {}", "subject to the {}", "terms: {}", "made available according to {}", "{} governs its use", "license: {}", "shared by us under a {}", "you may copy it as the {} allows", "under {}", "licence is {}", "distributed with a {}")
#: Prose with one of these words is no example of paragraphs without a licence. Only training asks for them.
DOUBTFUL = r"(?i)licen[sc]e|copyright|copyleft|permission|redistribut|warrant|\bgpl|\bgnu\b|\bapache\b|(?-i:\bMIT\b)|\bbsd\b|mozilla|creative commons|\bcc0?\b|public domain"
WORD = r"[^\p{L}\p{N}]+"
#: Words, pairs and triples, the same strings as NGram's; pairs are a lambda's variable, as an alias would be put by copy into a filter over the model's answer.
GRAMS = (
    "transform(array(zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, size(words)), (a, b) -> concat(a, ' ', b))), g ->"
    " concat(words, g, zip_with(slice(g, 1, greatest(size(g) - 1, 0)), slice(words, 3, size(words)), (a, b) -> concat(a, ' ', b))))[0]"
)
HASHES = 1 << 14
#: Words of a window of a long paragraph, and from one window to the next; what is no longer than their difference is whole in one window.
SPAN, STEP = 80, 40
#: A word that speaks for some licence with at least this weight, against none, makes its window a candidate, if at most this share of the prose in training has it.
HEAVY, PLAIN = 0.1, 0.002
#: Documents that prose is taken from for training, about, and paragraphs of them.
FIT_DOCS, FIT_PARAGRAPHS = 300, 600
PRECISION = 0.95
#: The share of a template's word pairs that a paragraph must have to confirm its family.
CONFIRM = 0.7
#: What a source file puts before a comment's lines; and where a line goes on in the next: it is long, does not end a sentence, and the next starts in lower case, or it ends in a word that a sentence goes on after.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+)(?:[ \t]|$)"
#: The line's end is asked for first: what stands before is looked at there alone, and not at every character.
WRAP = r"(?=[ \t]*\n)(?:(?<=[^\n]{40})(?<![.!?:])[ \t]*\n[ \t]*(?=[\p{Ll}(\"'])|(?<=[^\n]{40})(?<=\b(?:the|of|a|an|and|or|under|by|in|to|with|for|this))[ \t]*\n[ \t]*(?=\p{Lu}))"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: its lines, wrapped ones put together again, without the marks of comments and without empty ones. No text is cut."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), MARKS, "")
    return F.filter(F.transform(F.split(F.regexp_replace(plain, WRAP, " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def words_of(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.filter(F.split(F.lower(text), WORD), lambda x: x != "")


def windows(words: Column) -> Column:
    """A paragraph's words in windows of SPAN, one each STEP words, which together have all of them."""
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - SPAN) / STEP)).cast("int")), lambda i: F.slice(w, i * STEP + 1, SPAN)))


class Scanner:
    """A fitted pipeline, its family names in label order, the probability from which a family is believed, the words that make a window
    a candidate, and report: precision and recall of families on held-out names, phrases and strange licences, the share of the strange
    ones called ``unknown`` or nothing, and the share of held-out licences that have a candidate's word."""

    def __init__(self, model: PipelineModel, labels: list[str], threshold: float, heavy: list[str], report: dict[str, float]):
        self.model, self.labels, self.threshold, self.heavy, self.report = model, labels, threshold, heavy, report


def _training(docs: DataFrame, text: str, key: str, fit_docs: int) -> DataFrame:
    """(paragraph, family, held, prose): parts of notices, names in phrases, strange licences, other uses of licence words, and prose; some with prose of the corpus around them."""
    rows = []
    for family, texts in NOTICES.items():
        for t in texts:
            w = t.split()
            # notices come whole, in halves, and from their middle
            rows += [(" ".join(w[i:j]), family, False) for i, j in ((0, len(w)), (0, len(w)), (0, max(6, 2 * len(w) // 3)), (len(w) // 3, len(w)), (len(w) // 4, max(8, 3 * len(w) // 4)))]
        names = NAMES[family]
        rows += [(p.format(n) + end, family, n == names[-1] or p in PHRASES[-2:]) for n in names for p in PHRASES for end in ("", ".")]
    for held, texts in ((False, STRANGE), (True, HELD_STRANGE)):
        for t in texts:
            w = t.split()
            rows += [(" ".join(w[i:j]), "unknown", held) for i, j in ((0, len(w)), (0, len(w)), (0, max(5, 2 * len(w) // 3)), (len(w) // 3, len(w)))] * 2
    rows += [(t, "none", i % 4 == 0) for i, t in enumerate(OTHER) for _ in range(4)]
    spark = docs.sparkSession
    fixed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, paragraph string, family string, held boolean")
    chosen = common.hash_sample(docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null"), "k", fit_docs, "licence")
    prose = chosen.select(F.explode(paragraphs(F.col("t"))).alias("p")).where(~F.col("p").rlike(DOUBTFUL)).distinct()
    prose = common.materialize(common.hash_sample(prose, "p", FIT_PARAGRAPHS, "prose").select(F.explode(windows(words_of(F.col("p")))).alias("w")).select(F.array_join("w", " ").alias("paragraph")).where("paragraph <> ''"), "licence-prose")
    around = F.array(*(F.lit(r[0]) for r in prose.select(F.array_join(F.slice(F.split("paragraph", " "), 1, 8), " ")).orderBy("paragraph").limit(200).collect()), F.lit(""))
    near = lambda salt: F.get(around, F.pmod(F.xxhash64("id", F.lit(salt)), F.size(around)).cast("int"))
    mixed = fixed.select(F.concat_ws(" ", near("before"), "paragraph", near("after")).alias("paragraph"), "family", "held")
    return fixed.drop("id").union(mixed).withColumn("prose", F.lit(False)).union(prose.select("paragraph", F.lit("none"), F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 0, F.lit(True)))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", fit_docs: int = FIT_DOCS) -> Scanner:
    """A classifier of families, of ``unknown`` licences and of ``none``.

    The last name of each family, two phrases, and whole strange licences are held out. On them the threshold is set: the least
    probability from which on PRECISION of the believed families are right; below it a family is ``unknown``. Prose comes from about
    ``fit_docs`` documents, chosen by a hash of ``key``; with no documents the fixed texts alone are learned.
    """
    rows = common.materialize(_training(docs, text, key, fit_docs).withColumn("words", words_of(F.col("paragraph"))), "licence-training").coalesce(1)
    together = SQLTransformer(statement=f"SELECT *, {GRAMS} AS grams FROM __THIS__")
    hashed = HashingTF(numFeatures=HASHES, binary=True, inputCol="grams", outputCol="features")
    labels = StringIndexer(inputCol="family", outputCol="label").setStringOrderType("alphabetAsc").fit(rows)
    regression = LogisticRegression(maxIter=40, regParam=0.001, elasticNetParam=0.2, family="multinomial")
    model = Pipeline(stages=[together, hashed, regression]).fit(labels.transform(rows.where("not held")))
    names = list(labels.labels)
    held = sorted((tuple(r) for r in _believed(model.transform(rows.where("held")), names).select("p", "guess", "family").collect()), reverse=True)
    told = [(p, guess == family) for p, guess, family in held if guess not in ("none", "unknown")]
    threshold, good = 1.0, 0
    for i, (p, right) in enumerate(told, 1):
        good += right
        if good / i >= PRECISION:
            threshold = p
    threshold = max(0.5, threshold)
    sure = [right for p, right in told if p >= threshold]
    strange = [guess in ("none", "unknown") or p < threshold for p, guess, family in held if family == "unknown"]
    real = sum(family not in ("none", "unknown") for _, _, family in held)
    heavy = _heavy(rows.where("not held"), hashed, model.stages[-1].coefficientMatrix.toArray(), names)
    gated = rows.where("family <> 'none' and held").agg(F.avg(_candidate(F.col("words"), heavy).cast("double"))).first()[0]
    return Scanner(model, names, threshold, heavy, {"candidates": gated or 0.0, "precision": sum(sure) / max(1, len(sure)), "recall": sum(sure) / max(1, real), "strange": sum(strange) / max(1, len(strange)), "rows": len(held)})


def _heavy(rows: DataFrame, hashed: HashingTF, weights: np.ndarray, names: list[str]) -> list[str]:
    """The words of licences in training that speak for one of them and are rare in prose. All are of the fixed texts and of bits of prose, so they are few."""
    told = (np.delete(weights, names.index("none"), 0) - weights[names.index("none")]).max(axis=0)
    prose = rows.where("prose").count()
    words = rows.select(F.explode(F.array_distinct("words")).alias("w"), "family", "prose").groupBy("w").agg(F.count_if(F.col("family") != "none").alias("n"), F.count_if("prose").alias("plain"))
    few = words.where((F.col("n") > 0) & (F.col("plain") <= PLAIN * prose)).orderBy("w").collect()
    return [r["w"] for r in few if told[hashed.indexOf(r["w"])] >= HEAVY]


def _candidate(words: Column, heavy: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*(F.lit(w) for w in heavy)))


def _believed(scored: DataFrame, names: list[str]) -> DataFrame:
    p = vector_to_array("probability")
    return scored.withColumn("p", F.array_max(p)).withColumn("guess", F.get(F.array(*(F.lit(n) for n in names)), F.col("prediction").cast("int")))


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 2), " ")))


def _template_likeness(words: Column, family: Column) -> Column:
    """The largest share of a template's word pairs that the paragraph has, among the notices and names of its family."""
    templates = {f: [w for t in (*NOTICES[f], *NAMES[f]) for w in ["".join(c.lower() if c.isalnum() else " " for c in t).split()] if len(w) > 1] for f in NOTICES}

    def of(own: Column) -> Column:
        out = F.lit(0.0)
        for f, texts in templates.items():
            sets = [list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) for w in texts]
            out = F.when(family == f, F.greatest(F.lit(0.0), *(F.size(F.array_intersect(own, F.array(*(F.lit(x) for x in pairs)))) / len(pairs) for pairs in sets))).otherwise(out)
        return out

    return let(_pairs(words), of)


def scan(docs: DataFrame, scanner: Scanner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a licence paragraph: doc_id, paragraph (its number in ``paragraphs``, from 0), family, score, likeness, confirmed.

    family is a known family, or ``unknown`` where the model sees another licence, or where the best family is below the calibrated
    threshold; paragraphs that the model takes for something else are left out. A paragraph of more than SPAN words is judged by its
    windows, and the surest of those that the model takes for a licence speaks for it, so a notice is found in however long a paragraph;
    of equally sure ones the last family by name. confirmed says that a notice or name of the family has most of its word pairs in the
    paragraph. The model is asked about every window of every paragraph. Null and empty texts have no
    paragraphs; repeated rows are scanned each; of other columns none is read; an empty table gives an empty one.
    """
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"))
    lines = texts.select("doc_id", F.spark_partition_id().alias("part"), F.posexplode(paragraphs(F.col("_t"))).alias("n", "paragraph"))
    asked = lines.select("doc_id", "part", "n", "paragraph", F.posexplode(windows(words_of(F.col("paragraph")))).alias("w", "words")).where(F.size("words") > 0)
    scored = _believed(scanner.model.transform(asked), scanner.labels).where("guess <> 'none'")
    # equal rows are one from here, each with its number of copies in a part of the table; what is no licence is not shuffled
    each = scored.groupBy("doc_id", "part", "n", "paragraph", "w").agg(F.max(F.struct("p", "guess")).alias("best"), F.count("*").alias("copies"))
    best = each.groupBy("doc_id", "part", "n", "paragraph").agg(F.max("best").alias("best"), F.max("copies").alias("copies"))
    rows = best.select("doc_id", "n", words_of(F.col("paragraph")).alias("words"), F.col("best.p").alias("p"), F.col("best.guess").alias("guess"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    family = F.when(F.col("p") >= scanner.threshold, F.col("guess")).otherwise("unknown")
    like = _template_likeness(F.col("words"), F.col("guess"))
    found = rows.select("doc_id", F.col("n").cast("long").alias("paragraph"), family.alias("family"), F.col("p").alias("score"), like.alias("likeness"))
    return found.withColumn("confirmed", (F.col("likeness") >= CONFIRM) & (F.col("family") != "unknown"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all whole documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(docs))
