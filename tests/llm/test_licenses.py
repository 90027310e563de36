import math
import re

from pyspark.sql import functions as F

from plumbline.llm import licenses as L
from plumbline.llm.licenses import license_paragraphs


def test_families(spark):
    texts = [
        "Some words.\nLicensed under the Apache License, Version 2.0.\nMore words.",
        "Released under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.",
        "All rights reserved.",
        "The general public has free use of the software in the conditions of the source.",
        "A version of the foundation was granted in part.",
        None,
        "",
        "x " * 50_000,
        "Note: this file is Licensed under the Apache License, version 2.0",
    ]
    filler = [(100 + i, f"The {w} of the {v} is permitted in the {w} without any {v}.", 0) for i, (w, v) in enumerate([("license", "source"), ("public", "version"), ("free", "charge"), ("rights", "terms")] * 12)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + filler, "doc_id long, text string, paragraph int")
    out = {(r.doc_id, r.paragraph): r for r in license_paragraphs(df).collect()}
    got = {k[0]: r.family for k, r in out.items() if r.confirmed}
    assert got == {0: "apache", 1: "mit", 2: "gpl", 3: "cc-by-nc", 4: "proprietary", 10: "apache"}
    assert (0, 1) in out
    assert not {5, 6, 7, 8, 9} & {k[0] for k in out if out[k].confirmed}


def test_empty(spark):
    assert license_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def filler(n):
    return [(1000 + i, f"Stone {i} lay by the river and the water was of use with any boat. It is {i} and or not.", 0) for i in range(n)]


def test_short_wrapped_and_foreign_forms(spark):
    texts = {
        0: ("lgpl", "Licensed under the GNU Lesser General Public License v2.1"),
        1: ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
        2: ("isc", "Released under the ISC License."),
        3: ("mit", "SPDX-License-Identifier: MIT"),
        4: ("mit", "License: MIT"),
        5: ("mit", "Words before.\nMIT\n\nwords behind"),
        6: ("gpl", "Distributed under GPL-3.0-only"),
        7: ("apache", "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in\n// compliance with the License."),
        8: ("apache", "Lizenziert unter der Apache-Lizenz, Version 2.0."),
        9: ("unlicense", "This is free and unencumbered software released into the public domain."),
        10: ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
        11: ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        12: (None, "Ich gehe mit dir in das Haus und mit ihm."),
        13: (None, "The software of the foundation is free."),
        14: ("apache", "a river of words without an end " * 50 + "\nLicensed under the Apache License, Version 2.0."),
    }
    rows = [(i, t, 1) for i, (_, t) in texts.items()] + filler(120) + [(2000 + i, f"Ein Haus mit {i} Türen und mit Wald", 0) for i in range(30)]
    df = spark.createDataFrame(rows + [(None, "Released under the MIT License.", 0), (3, "SPDX-License-Identifier: MIT", 5)], "doc_id long, text string, chance int").repartition(3)
    out = license_paragraphs(df).collect()
    got = {r.doc_id: r.family for r in out if r.confirmed}
    assert got.pop(None) == "mit"
    assert got == {i: f for i, (f, _) in texts.items() if f}
    assert sum(r.doc_id == 3 and r.confirmed for r in out) == 2
    assert not [r for r in out if r.doc_id is not None and r.doc_id >= 1000 and r.confirmed]


def test_scores_by_brute_force(spark):
    """Every paragraph is taken apart in Python, without gate or cues, and scored with the fitted weights."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(9000 + i, t, "en", "s", len(t)) for i, t in enumerate(["License: LGPL", "MIT", "x\n\nunder the terms of\nthe GNU General Public License", "no phrase"])], "doc_id long, text string, lang string, source string, n_chars long"))
    v = L.vocabulary(docs)
    counts, model, least = L.fit(L.cut(L.paragraphs(docs, v), "test"), v)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    at, names = {g: i for i, g in enumerate(counts.vocabulary)}, [L.UNKNOWN, *L.TEMPLATES]
    want = {}
    for r in docs.collect():
        for k, text in enumerate(re.split(r"\n\s*\n|(?:(?<=[.!?])|(?<=[.!?][\"')\]])|(?<=[.!?][\"')\]]{2}))[ \t\r]*\n", r.text)):
            held = [at[g] for g in L.plain_ngrams(L.plain_words(text)) if g in at]
            if held:
                z = bias + weights[:, held].sum(1)
                p = [math.exp(x - max(z)) for x in z]
                best = max(range(1, len(p)), key=lambda i: (p[i], -i))
                if p[best] / sum(p) >= least and p[best] >= p[0]:
                    want[r.doc_id, k] = (names[best], round(p[best] / sum(p), 5))
    got = {(r.doc_id, r.paragraph): (r.family, round(r.chance, 5)) for r in license_paragraphs(docs).collect()}
    assert got.keys() == want.keys() and len(got) >= 5
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-4 for k in got)


def test_corpus_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = license_paragraphs(docs)
    lines = {(r.doc_id, line) for r in docs.collect() for line, t in enumerate(re.split(r"(?<=[.!?])\n", r.text)) if any(x.startswith(("Licensed under", "Released under", "This work is licensed", "All rights reserved")) for x in t.split("\n"))}
    found = {(r.doc_id, r.paragraph) for r in out.where("confirmed").collect()}
    assert lines and found == lines


def test_choices_denials_and_near_families(spark):
    texts = {
        0: {"cc-by-nc-sa"}, 1: set(), 2: {"mit", "apache"}, 3: set(), 4: {"gpl"}, 5: {"cc-by-nc-nd"}, 6: {"mit", "apache"}, 7: {"isc"}, 8: set(), 9: {"cc-by-nc"}, 10: {"mit"},
    }
    lines = {
        0: "Licensed under CC BY-NC-SA 4.0.",
        1: "Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.",
        2: "SPDX-License-Identifier: MIT OR Apache-2.0",
        3: "This software is not licensed under the MIT License.",
        4: "Licenciado bajo la GPL.",
        5: "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        6: "This project is dual licensed under the MIT License or the Apache License 2.0.",
        7: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        8: "Dieses Werk wird nicht lizenziert unter der MIT-Lizenz.",
        9: "Licensed under CC BY-NC 4.0.",
        10: "This software is licensed under the MIT License, and is not a toy.",
    }
    rows = [(i, t, 1) for i, t in lines.items()] + filler(120)
    out = license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string, paragraph int")).where("confirmed").collect()
    got = {i: {r.family for r in out if r.doc_id == i} for i in lines}
    assert got == texts
    assert {r.paragraph for r in out if r.doc_id == 2} == {0}


def test_a_corpus_full_of_licence_words(spark):
    """Licence words in every document leave phrases of a family as features: licences are found, talk about them is not."""
    talk = [(3000 + i, f"The public license of software {i} is free, and the version of the general terms was released under no rights. Apache and Mozilla have a foundation.", 0) for i in range(150)]
    lines = [(0, "Licensed under the Apache License, Version 2.0.", 0), (1, "Released under the MIT License.", 0), (2, "SPDX-License-Identifier: GPL-3.0-only", 0)]
    out = license_paragraphs(spark.createDataFrame(lines + talk, "doc_id long, text string, paragraph int")).where("confirmed").collect()
    assert {r.doc_id: r.family for r in out} == {0: "apache", 1: "mit", 2: "gpl"}


def test_counts_and_fit_see_every_document(spark):
    """More documents than any bounded look would take: counts, training and threshold hold all of them."""
    said = F.when(F.col("id") % 30 == 7, F.lit(". A notice was hung.")).otherwise(F.lit("."))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("A permission was asked, row "), F.col("id").cast("string"), said).alias("text"))
    few = docs.where("doc_id % 30 <> 7 or doc_id < 5340")  # 178 of 8,878 paragraphs, one more than the share COMMON
    fewer = few.where("doc_id <> 7")
    assert "notice" not in L.vocabulary(few).cues and "notice" in L.vocabulary(fewer).cues


def test_weighted_quantile(spark):
    import numpy as np

    values = [(0.1, 3), (0.5, 1), (0.2, 4), (0.5, 2), (0.9, 1)]
    df = spark.createDataFrame(values, "p double, n long")
    flat = [p for p, n in values for _ in range(n)]
    for share in (0.0, 0.3, 0.73, 0.95, 1.0):
        assert abs(L._weighted_quantile(df, share) - np.quantile(flat, share)) < 1e-12
    assert L._weighted_quantile(df.limit(0), 0.9) is None
