"""Licence paragraphs by a trained classifier (operator 8), with DataFrame functions only.

A paragraph ends at a blank line, or at a line end behind ``.``, ``!`` or ``?``; wrapped lines are one paragraph. Features
are word n-grams (one to three words, with marks for the paragraph's ends) of the licence templates. Those that hold no
uncommon word are left out, unless they are a whole paragraph; what is common is counted over all paragraphs. Each
feature has a cue, its least common word: a paragraph without any cue holds no feature at all, and is certainly unknown.

A multinomial logistic regression over these sparse features is fitted on the templates, on variants of them within
other words, and, as the class ``unknown``, on bare words of the templates and on all corpus paragraphs that hold a
feature but nothing that is one family's own, a fifth of them by hash left out; together they weigh ``CORPUS_WEIGHT`` at
most. The least chance at which a family counts is calibrated on that fifth. A prediction is confirmed if the paragraph holds ``CONFIRM`` of a template of the family, and at least as many
n-grams of its own (which no other family's templates have) as of any other family or of the decoys.

A paragraph that names licences by choice (``MIT OR Apache-2.0``, "dual licensed") is one paragraph for each of them, with
the same number. A sentence that denies a licence is unknown.

Null and empty texts have no paragraphs. Repeated documents are reported each. Rows with a null doc_id are reported with
it. An empty table gives no rows. Other columns play no part, whatever their names. Equal chances go to the family that
comes first.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import running_total
from .common import cut, table

#: What licences call themselves, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0", "License: Apache 2.0", "Apache-2.0", "Distributed under Apache-2.0.",
        "Lizenziert unter der Apache-Lizenz, Version 2.0.", "Sous licence Apache, version 2.0.", "Bajo la licencia Apache, versión 2.0.",
    ),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "Distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT", "License: MIT", "MIT", "SPDX: MIT",
        "Veröffentlicht unter der MIT-Lizenz.", "Publié sous licence MIT.", "Publicado bajo la licencia MIT.",
    ),
    "isc": (
        "Released under the ISC License.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "License: ISC", "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.", "Licensed under the BSD License.", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "License: BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Veröffentlicht unter der BSD-Lizenz.", "Publié sous licence BSD.", "Publicado bajo la licencia BSD.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v2.0.", "Released under the GNU GPL.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "License: GPLv3", "License: GPL", "GPL-3.0", "Distributed under GPL-3.0-only.",
        "Lizenziert unter der GPL.", "Sous licence GPL.", "Licenciado bajo la GPL.", "Publicado bajo la licencia GPL.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Lesser General Public License v3.0.", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "License: LGPL", "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "License: AGPL", "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "License: MPL 2.0", "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "epl": (
        "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "License: EPL 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense", "License: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.",
    ),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "License: CC0", "CC0 1.0 Universal"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "License: CC BY 4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "License: CC BY-SA 4.0"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0", "License: CC BY-ND 4.0"),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "License: CC BY-NC-SA 4.0"),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0", "License: CC BY-NC-ND 4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "License: CC BY-NC 4.0"),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados."),
}
UNKNOWN = "unknown"
#: What other licences and other sentences say in like words; the class ``unknown`` learns them.
DECOYS = (
    "Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.",
    "Permission is hereby granted, without written agreement and without license or royalty fees, to use, copy, modify, and distribute this software and its documentation for any purpose, provided that the above copyright notice and the following two paragraphs appear in all copies of this software.",
    "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    "You may use this work in any way that the law permits.", "Ask the author for a license before you copy the software.",
)
#: A sentence that denies a licence, and what parts a choice of licences.
_DENIED = r"(?iU)\b(?:not|never|nicht|pas|no longer)\b[^.;]{0,40}\b(?:licen[sc]ed|released|distributed|published|lizenziert|veröffentlicht|publié)\b"
_CHOICE, _PARTED = r"(?i)SPDX-License-Identifier:\s*\(?[A-Za-z0-9.+-]+\s+(?:OR|AND)\s", r"(?i)^[^\p{L}]*SPDX-License-Identifier:\s*\(?|\)?\s+(?:OR|AND)\s+\(?|\)\s*$"
_DUAL, _DUAL_PARTED = r"(?i)\bdual(?:ly)?[- ]licen[sc]ed\b", r"(?i)\s+(?:or|and)\s+(?:under\s+)?(?:the\s+)?"
CORPUS_WEIGHT = 1600.0
COMMON = 0.02
LEAST_CHANCE, FALSE_SHARE = 0.5, 0.001
CONFIRM = 0.5
_HEAD, _TAIL = "^", "$"


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def plain_ngrams(words: list[str]) -> list[str]:
    """The n-grams of a template's words within the marks of its ends; a mark alone is none."""
    padded = [_HEAD, *words, _TAIL]
    return sorted({" ".join(padded[i : i + n]) for n in (1, 2, 3) for i in range(len(padded) - n + 1)} - {_HEAD, _TAIL})


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def any_of(words: list[str]) -> str:
    """A pattern for any of the words that shares their beginnings, so that a place is given up after few letters."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + (any_of(rest) if rest != [""] else "") for c, rest in sorted(by_first.items()) if c]
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in by_first else "")


@dataclass(frozen=True)
class Vocabulary:
    """The features, the cue words that all of them but ``alone`` hold, and words that are a feature where they are a whole paragraph."""

    ngrams: tuple[str, ...]
    cues: tuple[str, ...]
    alone: tuple[str, ...]

    @property
    def pattern(self) -> str:
        """What a text or a paragraph with any feature matches."""
        edge = r"[^\p{L}\p{N}]"
        whole = f"|(?:^|\\n){edge}*{any_of(list(self.alone))}{edge}*(?:\\n|$)" if self.alone else ""
        return f"(?iU)(?<![\\p{{L}}\\p{{N}}]){any_of(list(self.cues))}(?![\\p{{L}}\\p{{N}}]){whole}"

    def grams(self, words: str) -> Column:
        """The distinct n-grams of an array column that hold a cue, and the whole paragraph where it is one word: only the runs around cues are built."""
        cues = ", ".join(f"'{w}'" for w in self.cues)
        padded = f"concat(array('{_HEAD}'), {words}, array('{_TAIL}'))"
        runs = ", ".join(f"named_struct('at', p - {back}, 'n', {n})" for n in (1, 2, 3) for back in range(n))
        built = (
            f"transform(array({padded}), q -> array_distinct(concat(if(size(q) = 3, array(array_join(q, ' ')), array()), "
            f"flatten(transform(filter(sequence(2, size(q) - 1), i -> q[i - 1] in ({cues})), "
            f"p -> transform(filter(array({runs}), r -> r.at >= 1 and r.at + r.n - 1 <= size(q)), r -> array_join(slice(q, r.at, r.n), ' ')))))))[0]"
        )
        return F.expr(built)


def split_paragraphs(text: Column) -> Column:
    return F.when(text.contains("\n"), F.split(text, r"\n\s*\n|(?<=[.!?][\"')\]]{0,2})[ \t\r]*\n")).when(text.isNotNull(), F.array(text))


def choices(text: Column) -> Column:
    """The licences of a paragraph that names several by choice, each as a paragraph of its own; else the paragraph."""
    parts = F.transform(F.filter(F.split(text, _PARTED), lambda p: F.trim(p) != ""), lambda p: F.concat(F.lit("SPDX-License-Identifier: "), F.trim(p)))
    dual = F.filter(F.split(text, _DUAL_PARTED), lambda p: F.trim(p) != "")
    return F.when(text.rlike(_CHOICE), parts).when(text.rlike(_DUAL), dual).otherwise(F.array(text))


def vocabulary(documents: DataFrame) -> Vocabulary:
    """The features that the templates offer, less those that hold no uncommon word, as counted in all paragraphs where no phrase of one family stands."""
    words = documents.select(F.explode(split_paragraphs(F.col("text"))).alias("paragraph")).select(F.explode(F.array(_words(F.col("paragraph")))).alias("words")).where("size(words) > 0")
    phrases = sorted({g for f, grams in own_ngrams().items() if f != UNKNOWN for g in grams if " " in g and _HEAD not in g and _TAIL not in g})
    own = sorted({w for texts in (*TEMPLATES.values(), DECOYS) for t in texts for w in plain_words(t)})
    known = ", ".join(f"'{w}'" for w in own)
    # a paragraph without the longest word of any phrase holds none, and is not searched
    longest = ", ".join(f"'{w}'" for w in sorted({max(g.split(" "), key=len) for g in phrases}))
    held = words.select("words", F.explode(F.expr(f"array(array_distinct(filter(words, w -> w in ({known}))))")).alias("held"))
    free = held.where(~F.expr(f"exists(held, w -> w in ({longest}))") | ~F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).rlike(f" {any_of(phrases)} "))
    counts = free.select(F.explode(F.concat(F.array(F.lit("")), "held")).alias("word")).groupBy("word").count().collect()  # words of the templates
    n = Counter({r["word"]: r["count"] for r in counts})
    common = {w for w in own if n[w] > COMMON * max(1, n[""])}
    ngrams, cues, alone = [], set(), set()
    for gram in sorted({g for texts in (*TEMPLATES.values(), DECOYS) for t in texts for g in plain_ngrams(plain_words(t))}):
        inner = [w for w in gram.split(" ") if w not in (_HEAD, _TAIL)]
        if rare := sorted((w for w in inner if w not in common), key=lambda w: (n[w], w)):
            ngrams.append(gram)
            cues.add(rare[0])
        elif len(inner) == 1 and gram == f"{_HEAD} {inner[0]} {_TAIL}":
            ngrams.append(gram)
            alone.add(inner[0])
    return Vocabulary(tuple(ngrams), tuple(sorted(cues)), tuple(sorted(alone)))


def paragraphs(documents: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, paragraph (its number), text, grams: paragraphs that hold a feature."""
    held = documents.where(F.col("text").rlike(v.pattern)).select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(split_paragraphs(F.col("text"))).alias("paragraph", "text"))
    held = held.where(F.col("text").rlike(v.pattern)).select("doc_id", "paragraph", F.explode(choices(F.col("text"))).alias("text"))
    held = held.where(F.col("text").rlike(v.pattern)).withColumn("words", _words(F.col("text"))).where("size(words) > 0")
    # a generator, so that the n-grams are built once for the filter and for what follows
    held = held.where(~F.col("text").rlike(_DENIED))
    built = held.select("doc_id", "paragraph", "text", F.inline(F.array(F.struct(v.grams("words").alias("grams")))))
    return built.where("size(grams) > 0")


def own_ngrams() -> dict[str, list[str]]:
    """For each family, and for what is none, the n-grams of its templates that no other one's have."""
    by_family = {f: {g for t in texts for g in plain_ngrams(plain_words(t))} for f, texts in (TEMPLATES | {UNKNOWN: DECOYS}).items()}
    families = Counter(g for grams in by_family.values() for g in grams)
    return {f: sorted(g for g in grams if families[g] == 1) for f, grams in by_family.items()}


def families(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """family, templates (arrays of features), own (features that no other family has); one row a family."""
    known, own = set(v.ngrams), own_ngrams()
    rows = [(f, [[g for g in plain_ngrams(plain_words(t)) if g in known] for t in texts], [g for g in own[f] if g in known]) for f, texts in (TEMPLATES | {UNKNOWN: DECOYS}).items()]
    return spark.createDataFrame(rows, "family string, templates array<array<string>>, own array<string>")


def _made(v: Vocabulary) -> list[tuple[float, list[str]]]:
    """Templates whole, without their first or last word, and within other words; those of no family as the class 0."""
    out = []
    for k, texts in enumerate((DECOYS, *TEMPLATES.values())):
        for t in texts:
            w = plain_words(t)
            for variant in [w, ["see", "note", *w, "here"], ["x", *w], [*w, "x"], *([w[1:], w[:-1]] if len(w) > 4 else [])]:
                out.append((float(k), sorted(set(plain_ngrams(variant)) & set(v.ngrams))))
    return out


def _weighted_quantile(values: DataFrame, share: float) -> float | None:
    """The quantile of the values ``p``, each of which counts ``n`` times, linear between neighbours; none without values."""
    upto = cut(running_total(values.groupBy("p").agg(F.sum("n").alias("n")), ["p"], "n", "upto"), "chances")
    place = share * ((upto.agg(F.max("upto")).first()[0] or 0) - 1)
    if place < 0:
        return None
    low = int(place)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("p")))
    below, above = upto.agg(at(low), at(low + 1)).first()
    return below if above is None else below + (above - below) * (place - low)


def fit(found: DataFrame, v: Vocabulary) -> tuple[CountVectorizerModel, LogisticRegressionModel, float]:
    """The counts of features, the classifier and the least chance, from templates and all paragraphs that hold nothing of one family's own."""
    spark = found.sparkSession
    own = sorted({g for f, grams in own_ngrams().items() if f != UNKNOWN for g in grams} & set(v.ngrams))
    holds = spark.createDataFrame([(own,)], "own array<string>")
    other = found.crossJoin(F.broadcast(holds)).where("not arrays_overlap(grams, own)").select(F.array_sort("grams").alias("grams"), (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held"))
    # paragraphs with the same features are one row with their number
    other = cut(other.groupBy("grams", "held").agg(F.count("*").alias("n")), "others")
    seen = other.where("not held").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    each = min(0.5, CORPUS_WEIGHT / max(1, seen))
    # a bare word of a template says nothing, unless it is the paragraph
    bare = spark.createDataFrame([(0.0, [g], 0.5) for g in v.ngrams if " " not in g], "label double, grams array<string>, weight double")
    made = spark.createDataFrame([(k, grams, 1.0 if k else 0.5) for k, grams in _made(v)], bare.schema)
    training = cut(made.unionByName(bare).coalesce(2).unionByName(other.where("not held").select(F.lit(0.0).alias("label"), "grams", (F.col("n") * each).alias("weight"))), "training")
    counts = CountVectorizerModel.from_vocabulary(list(v.ngrams), inputCol="grams", outputCol="features")
    counts.setBinary(True)
    model = LogisticRegression(maxIter=60, regParam=0.002, family="multinomial", weightCol="weight").fit(counts.transform(training))
    most = model.transform(counts.transform(other.where("held"))).select("n", F.array_max(F.slice(vector_to_array("probability"), 2, len(TEMPLATES))).alias("p"))
    reached = _weighted_quantile(most, 1 - FALSE_SHARE)
    return counts, model, max(LEAST_CHANCE, min(0.95, reached or 0.0))


def license_paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, paragraph, family, chance, overlap (with the nearest template of the family) and whether the templates confirm it."""
    spark = documents.sparkSession
    v = vocabulary(documents)
    found = cut(paragraphs(documents, v), "paragraphs")
    counts, model, least = fit(found, v)
    scored = model.transform(counts.transform(found)).withColumn("chances", vector_to_array("probability"))
    names = F.array(F.lit(UNKNOWN), *map(F.lit, TEMPLATES))
    scored = scored.withColumn("best", F.array_max(F.slice("chances", 2, len(TEMPLATES)))).withColumn("family", names[F.array_position(F.slice("chances", 2, len(TEMPLATES)), F.col("best")).cast("int")])
    scored = scored.where((F.col("best") >= least) & (F.col("best") >= F.col("chances")[0]))
    sets = families(spark, v)
    joined = scored.join(F.broadcast(sets.select("family", "templates", F.col("own").alias("_own"))), "family")  # one row for each family
    votes = F.broadcast(sets.agg(F.collect_list("own").alias("_all")))
    overlap = F.expr("array_max(transform(filter(templates, t -> size(t) > 0), t -> size(array_intersect(t, grams)) / size(t)))")
    told = F.expr("size(array_intersect(_own, grams))")
    most = F.expr("array_max(transform(_all, o -> size(array_intersect(o, grams))))")
    out = joined.crossJoin(votes).withColumn("_told", told).withColumn("_most", most)
    return out.select("doc_id", "paragraph", "family", F.round("best", 6).alias("chance"), F.round(overlap, 6).alias("overlap"), ((overlap >= CONFIRM) & (F.col("_told") > 0) & (F.col("_told") >= F.col("_most"))).alias("confirmed"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_paragraphs(table(spark, sf_dir, "documents"))


QUERIES = {"op8_licenses": op8_licenses}
SQL: dict[str, str] = {}
