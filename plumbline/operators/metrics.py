"""Metrics of predictions and tables over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import quantiles_by, running_total
from ..functions.shared import cut
from .gates import GateError


#: Distinct values that are ranked in windows at most; more are ranked along a written order.
WINDOWED = 1 << 20


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, value, name: the average rank of each distinct value within its group, from counts of values.

    Counts are summed along one order of groups and values, less what stands before the group: a group of any size is no single task.
    """
    held = cut(df.groupBy(*by, value).agg(F.count("*").alias("_c")), "counts")
    rank = F.col("_upto") - (F.col("_c") - 1) / 2
    if held.count() <= WINDOWED:
        upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return held.withColumn("_upto", upto).select(*by, value, rank.alias(name))
    counts = running_total(held, [*by, value], "_c", "_upto")
    if not by:
        return counts.select(value, rank.alias(name))
    before = counts.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_c")).alias("_before"))
    return counts.join(before, by).select(*by, value, (rank - F.col("_before")).alias(name))


def spearman_by(df: DataFrame, by: list[str], x: str, y: str, n: str = "n") -> DataFrame:
    """by, ``n``, spearman with average ranks of ties; null where a side is constant or n < 2."""
    ranked = df.join(average_ranks(df, by, x, "_rx"), [*by, x]).join(average_ranks(df, by, y, "_ry"), [*by, y])
    out = ranked.groupBy(*by).agg(F.count("*").alias(n), F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"), F.covar_pop("_rx", "_ry").alias("_c"))
    return out.select(*by, n, F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_c") / (F.col("_sx") * F.col("_sy"))).alias("spearman"))


def spearman(df: DataFrame, x: str, y: str) -> float:
    """Over a whole table. A constant side or n < 2 is an error."""
    both = df.join(average_ranks(df, [], x, "_rx"), x).join(average_ranks(df, [], y, "_ry"), y)
    r = both.agg(F.count("*"), F.stddev_pop("_rx"), F.stddev_pop("_ry"), F.covar_pop("_rx", "_ry")).first()
    if r[0] < 2 or not r[1] or not r[2]:
        raise GateError("too few rows, or a constant side")
    return r[3] / (r[1] * r[2])


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, label, tp, fp, fn, support over the union of true and predicted labels; rows count ``weight`` times."""
    cells = df.groupBy(*by, F.col(truth).alias("_t"), F.col(predicted).alias("_p")).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    both = F.array(F.struct(F.col("_t").alias("label"), F.lit(True).alias("own")), F.struct(F.col("_p").alias("label"), F.lit(False).alias("own")))
    long = cells.select(*by, "_n", (F.col("_t") == F.col("_p")).alias("_hit"), F.explode(both).alias("s")).select(*by, "_n", "_hit", "s.label", "s.own")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    return long.groupBy(*by, "label").agg(part(F.col("own") & F.col("_hit")).alias("tp"), part(~F.col("own") & ~F.col("_hit")).alias("fp"), part(F.col("own") & ~F.col("_hit")).alias("fn"), part(F.col("own")).alias("support"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def per_class(df: DataFrame, truth: str, predicted: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """As :func:`confusion`, with precision, recall and f1; undefined ones are 0."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return confusion(df, truth, predicted, by, weight).withColumns({"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn)})


def classification(df: DataFrame, truth: str, predicted: str, average: str = "macro", by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, n, accuracy, precision, recall, f1, balanced_accuracy.

    Macro averages are over the union of labels; balanced accuracy is over labels that the truth has.
    """
    if average not in ("macro", "micro"):
        raise GateError(f"no average {average}")
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    micro = {"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn)}
    means = {c: F.avg(c) for c in ("precision", "recall", "f1")} if average == "macro" else micro
    balanced = F.avg(F.when(F.col("support") > 0, F.col("recall")))
    return per_class(df, truth, predicted, by, weight).groupBy(*by).agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), *[c.alias(k) for k, c in means.items()], balanced.alias("balanced_accuracy"))


def mean_squared_error(df: DataFrame, truth: str, predicted: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(truth) - F.col(predicted), 2)).alias("mse"))


def seed_spread(runs: DataFrame, arm: str, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric by arm; the deviation of one run is 0."""
    parts = [f(m).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("sd", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))]
    return runs.groupBy(arm).agg(F.count("*").alias("runs"), *parts)


def seed_matrix(runs: DataFrame, arm: str, metric: str, seeds: list[int]) -> DataFrame:
    return runs.groupBy(arm).pivot("seed", seeds).agg(F.first(metric))


def median_score(results: DataFrame, score: str, by: list[str] = ()) -> DataFrame:
    """by, median: of each group, without any group in one buffer."""
    return quantiles_by(results, list(by), score, {"median": 0.5})


def at_edge(results: DataFrame, penalty: str, grid: list[float]) -> DataFrame:
    """How many configurations chose the least or the greatest penalty."""
    return results.agg(F.count_if(F.col(penalty).isin(min(grid), max(grid))).alias("at_edge"), F.count("*").alias("n"))


def efficiency_curve(results: DataFrame, by: list[str], n: str, score: str, floor: DataFrame | None = None) -> DataFrame:
    """by, n, mean, sd, runs; with ``floor`` (by, floor) the level reached without training."""
    out = results.groupBy(*by, n).agg(F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sd"), F.count("*").alias("runs"))
    return out if floor is None else out.join(floor, [c for c in by if c in floor.columns], "left")


def readout_means(results: DataFrame, by: list[str], readout: str, score: str, readouts: list[str]) -> DataFrame:
    return results.groupBy(*by).pivot(readout, readouts).agg(F.avg(score))


def drawn_positions(drawn: DataFrame, by: list[str], position: str) -> DataFrame:
    return drawn.groupBy(*by).agg(F.count_distinct(position).alias("train_positions"), F.count("*").alias("n_train"))
