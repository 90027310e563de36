"""Dropping the sentences that state a label, the matched random control, and what it did to a corpus."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import quantiles
from ..functions.layout import in_pieces
from ..functions.shared import cut
from ..functions.text import ablated, clean_annotation, random_dropped, sentences, term_pattern
from .gates import GateError


@dataclass(frozen=True)
class Lexicon:
    """Terms by group, phrases that excuse a term, and words that are watched but not filtered."""

    version: str
    groups: dict[str, tuple[str, ...]]
    exclusions: tuple[str, ...] = ()
    sentinels: tuple[str, ...] = ()
    classes: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if both := set(self.sentinels) & set(self.terms):
            raise GateError(f"sentinels are filtered: {sorted(both)}")
        if lack := set(self.classes) - set(self.groups):
            raise GateError(f"classes without terms: {sorted(lack)}")

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t for ts in self.groups.values() for t in ts))

    def frame(self, spark: SparkSession) -> DataFrame:
        """version, group, term, kind."""
        rows = [(self.version, g, t, "term") for g, ts in self.groups.items() for t in ts]
        rows += [(self.version, None, t, kind) for kind, ts in (("exclusion", self.exclusions), ("sentinel", self.sentinels)) for t in ts]
        return spark.createDataFrame(rows, "version string, group string, term string, kind string")


def ablate(df: DataFrame, text: str, lexicon: Lexicon, clean: bool = True) -> DataFrame:
    """``df`` with cleaned, sentences, kept, removed, matched_terms, characters_before, characters_after: narrow projections, behind :func:`in_pieces`."""
    cleaned = in_pieces(df).withColumn("cleaned", clean_annotation(F.col(text)) if clean else F.coalesce(F.col(text), F.lit("")))
    # a generator, as the optimizer would work out a plain struct anew for each of its fields
    return cleaned.select(*cleaned.columns, F.inline(F.array(ablated(sentences(F.col("cleaned")), lexicon.terms, lexicon.exclusions))))


def ablation_summary(results: DataFrame, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ablated documents: totals, per group, and documents per removed term.

    Retention is characters after by before; a document without characters before is counted as undefined and left
    out of mean, median and tenth percentile (linear interpolation). What the tables need of each document is written
    first, so that the texts are worked on once.
    """
    sizes = results.select(F.col(group).alias("group"), F.size("kept").alias("kept"), F.size("removed").alias("removed"), "characters_before", "characters_after", "matched_terms")
    sizes = cut(sizes, "ablated")
    kept, removed = F.col("kept"), F.col("removed")
    trimmed, emptied = removed > 0, (removed > 0) & (kept == 0)
    retention = F.when(F.col("characters_before") > 0, F.col("characters_after") / F.col("characters_before"))
    n = F.count("*")
    totals = sizes.agg(
        n.alias("documents"),
        F.count_if(trimmed).alias("trimmed"),
        F.count_if(emptied).alias("emptied"),
        (F.count_if(trimmed) / n).alias("trimmed_share"),
        (F.count_if(emptied) / n).alias("emptied_share"),
        F.sum(kept + removed).alias("sentences"),
        F.sum(removed).alias("sentences_removed"),
        F.sum("characters_before").alias("characters_before"),
        F.sum("characters_after").alias("characters_after"),
        (F.sum("characters_after") / F.sum("characters_before")).alias("corpus_retention"),
        F.avg(retention).alias("retention_mean"),
        F.count_if(F.col("characters_before") == 0).alias("undefined_retention"),
    )
    totals = totals.crossJoin(quantiles(sizes.select(retention.alias("retention")), "retention", {"retention_median": 0.5, "retention_p10": 0.1}))
    groups = sizes.groupBy(F.col("group").alias(group)).agg(n.alias("documents"), F.count_if(trimmed).alias("trimmed"), F.count_if(emptied).alias("emptied"), F.sum(removed).alias("sentences_removed"))
    terms = sizes.select(F.explode("matched_terms").alias("term")).groupBy("term").agg(n.alias("documents"))
    return totals, groups, terms


def retention_gate(results: DataFrame) -> DataFrame:
    """Documents whose retention is undefined, or that are emptied without being trimmed."""
    return results.where((F.col("characters_before") == 0) | ((F.size("kept") == 0) & (F.size("removed") == 0)))


def term_mentions(df: DataFrame, text: Column, terms: Sequence[str]) -> DataFrame:
    """term, n: texts that mention each term, matched alone; terms without any stay with 0.

    Texts are taken apart once: terms of one word are looked up among their distinct words, phrases are searched for.
    """
    forms = [(form, t) for t in terms if re.fullmatch(r"\w+", t) for form in (t.lower(), f"{t.lower()}s")]
    phrases = [t for t in terms if not re.fullmatch(r"\w+", t)]
    words = F.array_intersect(F.split(F.lower("_t"), r"(?U)\W+"), F.array(*[F.lit(f) for f, _ in forms])) if forms else F.array().cast("array<string>")
    said = [F.when(F.col("_t").rlike(term_pattern([t])), F.lit(t)) for t in phrases]
    held = in_pieces(df).select(text.alias("_t")).select(words.alias("words"), F.array_compact(F.array(*said)).cast("array<string>").alias("phrases"))
    ones = [F.when(F.arrays_overlap("words", F.array(*[F.lit(f) for f, of in forms if of == t])), F.lit(t)) for t in dict.fromkeys(of for _, of in forms)]
    found = held.where((F.size("words") > 0) | (F.size("phrases") > 0)).select(F.explode(F.concat("phrases", F.array_compact(F.array(*ones)).cast("array<string>"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    listed = df.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    return listed.join(F.broadcast(found), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))  # a row for each term


def text_variants(results: DataFrame, key: str, text: str, seeds: Sequence[int]) -> DataFrame:
    """key, variant, seed, text: raw, cleaned, ablated, and for each seed a control with as many random sentences dropped."""
    fixed = [("raw", F.col(text)), ("cleaned", F.col("cleaned")), ("ablated", F.array_join("kept", " "))]
    parts = [F.struct(F.lit(v).alias("variant"), F.lit(None).cast("int").alias("seed"), c.alias("text")) for v, c in fixed]
    for seed in seeds:
        control = F.array_join(random_dropped(F.col("sentences"), F.col(key), F.lit(seed), F.size("removed")), " ")
        parts.append(F.struct(F.lit("random").alias("variant"), F.lit(seed).alias("seed"), control.alias("text")))
    return results.select(key, F.explode(F.array(*parts)).alias("v")).select(key, "v.*")


def untouched_faults(results: DataFrame) -> DataFrame:
    """Documents without removals whose kept sentences are not their sentences."""
    return results.where((F.size("removed") == 0) & (F.array_join("kept", " ") != F.array_join("sentences", " ")))


def control_retention(results: DataFrame, key: str, seed: int) -> DataFrame:
    """Characters kept by ablation and by the random control, both by sentence lengths."""
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + F.length(s))
    control = random_dropped(F.col("sentences"), F.col(key), F.lit(seed), F.size("removed"))
    sums = results.agg(F.sum("characters_before").alias("before"), F.sum("characters_after").alias("ablated"), F.sum(size(control)).alias("control"))
    return sums.select("before", "ablated", "control", (F.col("ablated") / F.col("before")).alias("ablated_retention"), (F.col("control") / F.col("before")).alias("control_retention"))
