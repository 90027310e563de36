"""The phrase index against the pattern, and with very many terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import matched_terms
from plumbline.operators import ablation as A
from plumbline.operators.phrases import ablate_by_index, matched_by_index

TERMS = ["cell", "cells", "cell membrane", "cell membranes", "Nuclear pore", "pore", "beta-2", "x ray", "x ray source", "Ca2+", "(null)", "naïve", "MÜLLER cell", "a b c", "b c", "c.1"]
EXCLUSIONS = ["cell membrane protein", "pore forming", "the x", "c++"]


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "term string")


def by_pattern(df, exclusions):
    found = df.select("k", matched_terms(F.array(F.coalesce("text", F.lit(""))), TERMS, exclusions).alias("m")).where("size(m) > 0")
    return {r.k: r.m for r in found.collect()}


@pytest.mark.parametrize("exclusions", [(), tuple(EXCLUSIONS)])
def test_same_as_the_pattern(spark, exclusions):
    rng = random.Random(4)
    words = ["cell", "Cells", "membrane", "membranes", "nuclear", "PORE", "pores", "beta-2", "beta", "2", "x", "ray", "rays", "source", "ca2+", "Ca2", "(null)", "naïve", "naïves", "Müller", "a", "b", "c", "bs", "cs", "s", "the", "protein", "forming", "c.1", "c++", "_cell", "cell_", "excellent"]
    gaps = [" ", " ", " ", " ", "-", ", ", "  ", ".", "", "(", ") "]
    rows = [(k, "".join(w + rng.choice(gaps) for w in rng.choices(words, k=rng.randint(0, 12)))) for k in range(3000)]
    rows += [(9000, None), (9001, ""), (9002, "..."), (9003, "cell membrane proteins"), (9004, "cell membrane protein and cell"), (9005, "x ray sources"), (9006, "a b cs")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "k long, text string, term string, at int").repartition(4)
    got = {r.k: r.matched for r in matched_by_index(df, ["k"], column(spark, TERMS), column(spark, exclusions) if exclusions else None).collect()}
    want = by_pattern(df, exclusions)
    assert len(want) > 1500
    assert {k: (got.get(k), want.get(k)) for k in {*got, *want} if got.get(k) != want.get(k)} == {}


def test_ablation_is_the_same(spark):
    lexicon = A.Lexicon("1", {"g": ("cell membrane", "pore")}, ("pore forming",))
    texts = ["The cell membranes open. A pore forming toxin; nuclear pores e.g. none. Left over.", None, "", "Pore.", "nothing (pore. x) here. Then."]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    names = ["k", "kept", "removed", "matched_terms", "characters_before", "characters_after"]
    entries = lexicon.frame(spark)
    got = ablate_by_index(df, "k", "text", entries.where("kind = 'term'"), entries.where("kind = 'exclusion'")).select(names)
    want = A.ablate(df, "text", lexicon).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ablate_by_index(df.limit(0), "k", "text", entries).count() == 0


def test_a_hundred_thousand_terms(spark):
    """As many terms as no pattern holds: known ones are found among them, with plurals, and nothing else is."""
    made = spark.range(100_000).select(F.concat(F.lit("term"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(" of part"), F.col("id").cast("string"))).otherwise(F.lit(""))).alias("term"))
    rows = [(k, f"It has term{k} of part{k}s, and term{k + 1}; but Term{k + 2}x of nothing and term{200_000 + k}.") for k in range(0, 90_000, 300)]
    got = {r.k: r.matched for r in matched_by_index(spark.createDataFrame(rows, "k long, text string"), ["k"], made).collect()}
    assert got == {k: sorted([f"term{k} of part{k}", f"term{k + 1}"]) for k, _ in rows}


def test_joined_forms(spark, monkeypatch):
    from plumbline.operators import phrases

    df = spark.createDataFrame([(1, "a pore and cells"), (2, "none")], "k long, text string")
    one = matched_by_index(df, ["k"], column(spark, TERMS)).collect()
    monkeypatch.setattr(phrases, "BROADCAST", 0)
    assert matched_by_index(df, ["k"], column(spark, TERMS)).collect() == one and one[0].matched == ["cells", "pore"]


def test_no_terms(spark):
    df = spark.createDataFrame([(1, "a")], "k long, text string")
    for bad in ([], [" "], [None]):
        with pytest.raises(ValueError, match="terms must be given"):
            matched_by_index(df, ["k"], column(spark, bad))


def test_spans_carry_no_text(spark, monkeypatch):
    """What is exploded for the look-up is a term's first word and what follows it, not the sentence or its parts."""
    from plumbline.operators import phrases

    seen = []
    found = phrases._looked_up

    def looked_up(texts, *rest):
        out = found(texts, *rest)
        seen.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(phrases, "_looked_up", looked_up)
    df = spark.createDataFrame([(1, "a pore and cells"), (2, "none " * 500)], "k long, text string")
    for most in (1000, 3):  # places chosen by first words, and every word
        monkeypatch.setattr(phrases, "FIRSTS", most)
        assert [r.matched for r in matched_by_index(df, ["k"], column(spark, TERMS)).collect()] == [["cells", "pore"]]
    assert all(re.search(r"Generate explode\(concat\(.*\), \[.*\], false, \[_s#\d+\]", plan) for plan in seen)
    assert "IN (" in seen[0] or "INSET" in seen[0]
    assert "INSET" not in seen[1]


def test_ablation_of_repeated_keys(spark):
    """Rows that share a key, or have none, stay rows of their own."""
    rows = [(1, "A pore. Left."), (1, "Nothing. A cell."), (None, "A pore."), (None, "Other.")]
    got = ablate_by_index(spark.createDataFrame(rows, "k long, text string"), "k", "text", column(spark, ["pore", "cell"]))
    assert sorted((r.k or 0, r.kept, r.removed) for r in got.collect()) == [(0, [], ["A pore."]), (0, ["Other."], []), (1, ["Left."], ["A pore."]), (1, ["Nothing."], ["A cell."])]
