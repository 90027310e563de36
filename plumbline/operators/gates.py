"""Gates: rules that a table must meet, as a table of rule, number of offending rows, and one sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A strict gate found offending rows."""


def check(df: DataFrame, rules: dict[str, Column], strict: bool = False) -> DataFrame:
    """rule, n_bad, sample: for each rule (true or null where a row is bad), in one pass over ``df``."""
    row = F.to_json(F.struct(*df.columns)) if df.columns else F.lit("")
    aggregates = [F.struct(F.lit(name).alias("rule"), F.count_if(F.coalesce(bad, F.lit(True))).alias("n_bad"), F.min(F.when(F.coalesce(bad, F.lit(True)), row)).alias("sample")) for name, bad in rules.items()]
    out = df.agg(F.array(*aggregates).alias("g")).select(F.explode("g").alias("g")).select("g.*")
    return raised(out) if strict else out


def raised(gates: DataFrame) -> DataFrame:
    """``gates``, or an error that names the rules with offending rows."""
    bad = gates.where("n_bad > 0").collect()  # a row for each rule
    if bad:
        raise GateError("; ".join(f"{r.rule}: {r.n_bad} rows, such as {r.sample}" for r in bad))
    return gates


def duplicated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def overlap(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys on both sides: empty where a split does not leak."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")


def coverage(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """keys, side: keys of one side only, ``missing`` or ``foreign``."""
    a, b = expected.select(*keys).distinct(), found.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("foreign")))


def not_finite(column: Column) -> Column:
    """Whether an array holds something that is no finite number; a null array is null, which is a fault to :func:`check`."""
    return F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def union(*frames: DataFrame, tolerant: bool = False) -> DataFrame:
    """All rows, by column name; ``tolerant`` fills columns that some frames lack with null. None is an error."""
    if not frames:
        raise GateError("there is no table to read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=tolerant), frames)
