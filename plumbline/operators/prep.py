"""Preparing cohorts: filters, derived columns, joins that keep their rows, profiles, and verified substitutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import global_rank
from ..functions.text import normalised
from .gates import GateError, duplicated


def single_label(df: DataFrame, label: str, dual: object, classes: int | None = None) -> DataFrame:
    """Rows of other labels than ``dual``, those without a label among them; with ``classes``, an error unless so many labels remain."""
    out = df.where(~F.col(label).eqNullSafe(F.lit(dual)))
    if classes is not None and (n := out.agg(F.count_distinct(label)).first()[0]) != classes:
        raise GateError(f"{n} classes instead of {classes}")
    return out


def with_text_flag(df: DataFrame, text: str, flag: str = "has_text") -> DataFrame:
    """``text`` normalised, and whether it is empty then; to be set once, before any variant of the text is made."""
    return df.withColumn(text, normalised(F.col(text))).withColumn(flag, F.length(text) > 0)


def eligible(reference: DataFrame, multiple: str, length: str, singles: str, longest: int = 400, least: int = 2000, most: int = 8000) -> DataFrame:
    """Rows without multiple mutants, up to ``longest`` residues, with ``least`` to ``most`` single ones; the flag must be boolean."""
    if dict(reference.dtypes)[multiple] != "boolean":
        raise GateError(f"{multiple} is no boolean")
    return reference.where(~F.col(multiple) & (F.col(length) <= longest) & F.col(singles).between(least, most))


def base_key(key: Column) -> Column:
    """What stands before the first hyphen."""
    return F.substring_index(key, "-", 1)


def label_index(df: DataFrame, label: str, name: str = "label_index") -> DataFrame:
    """Labels numbered in alphabetical order, whatever their number: they are ranked globally and joined, null with null."""
    codes = global_rank(df.select(F.col(label).alias("_label")).where(F.col(label).isNotNull()).distinct(), ["_label"], "_code")
    joined = df.join(codes, F.col(label) == F.col("_label"), "left")
    return joined.withColumn(name, F.col("_code").cast("int")).drop("_label", "_code")


def truncated(text: Column, limit: int) -> Column:
    return F.least(F.length(text), F.lit(limit))


def annotated(records: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Left join that cannot add rows: a key that ``annotations`` has twice is an error. Missing text is empty."""
    if twice := duplicated(annotations, key).take(1):
        raise GateError(f"{key} {twice[0][0]} stands twice")
    texts = [c for c, t in annotations.dtypes if t == "string" and c != key]
    return records.join(annotations, key, "left").fillna("", texts)


def first_by_group(df: DataFrame, group: str, key: str, groups: list | None = None) -> DataFrame:
    """The row with the smallest key of each group; a listed group without rows is an error."""
    if groups is not None:
        df = df.where(F.col(group).isin(groups))
    out = df.groupBy(group).agg(F.min_by(F.struct(*df.columns), key).alias("_row")).select("_row.*")
    if groups is not None and (lack := set(groups) - {r[0] for r in out.select(group).collect()}):  # a row for each listed group
        raise GateError(f"no candidate for {sorted(lack)}")
    return out


def cohort_profile(df: DataFrame, label: str, texts: list[str], flags: dict[str, Column]) -> DataFrame:
    """n, n_classes, count of each flag, and count and share of non-empty values of each text, in one pass."""
    filled = {t: F.count_if(F.length(F.coalesce(F.col(t), F.lit(""))) > 0) for t in texts}
    return df.agg(
        F.count("*").alias("n"),
        F.count_distinct(label).alias("n_classes"),
        *[F.count_if(c).alias(f"n_{k}") for k, c in flags.items()],
        *[f.alias(f"n_{t}") for t, f in filled.items()],
        *[(f / F.count("*")).alias(f"share_{t}") for t, f in filled.items()],
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def majority_floor(df: DataFrame, label: str) -> DataFrame:
    """The accuracy of always saying the most frequent class."""
    return class_counts(df, label).agg((F.max("n") / F.sum("n")).alias("majority_floor"))


def group_metadata(variants: DataFrame, group: str, position: str) -> DataFrame:
    return variants.groupBy(group).agg(F.count("*").alias("variants"), F.count_distinct(position).alias("distinct_positions"))


def fold_counts(variants: DataFrame, group: str, folds: list[str]) -> DataFrame:
    """group, scheme, folds: how many folds each scheme has, in long form."""
    wide = variants.groupBy(group).agg(*[F.count_distinct(f).alias(f) for f in folds])
    return wide.unpivot([group], folds, "scheme", "folds")


def distinct_positions(variants: DataFrame, substitutions: str) -> DataFrame:
    return variants.select(F.explode(f"{substitutions}.pos").alias("position")).distinct()


def variant_faults(target: Column, mutated: Column, subs: Column, single: bool = True) -> Column:
    """Why a variant does not fit its target; null if it does."""
    wrong = lambda text, field: F.exists(subs, lambda s: text.substr(s["pos"] + 1, F.lit(1)) != s[field])
    return (
        F.when(subs.isNull(), "malformed")
        .when(F.lit(single) & (F.size(subs) != 1), "not one substitution")
        .when(F.exists(subs, lambda s: (s["pos"] < 0) | (s["pos"] >= F.length(target))), "position out of range")
        .when(wrong(target, "wt"), "target has another residue")
        .when(wrong(mutated, "mut"), "variant has another residue")
    )


def position_faults(text: Column, position: Column, limit: int) -> Column:
    """Whether a position is lost by truncation; it is never clamped."""
    return F.coalesce((position < 0) | (position >= truncated(text, limit)), F.lit(True))
