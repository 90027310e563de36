"""Grids of configurations: their cross product in order, evaluation of all of them, and complete shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import global_rank
from .fits import ridge_grid
from .gates import coverage
from .splits import capped, draws, fold_roles


def grid(spark: SparkSession, axes: dict[str, list | DataFrame]) -> DataFrame:
    """One row for each combination, with ``ordinal``: the last axis runs fastest. As many rows as the axes multiply to.

    An axis is a list of few values, or a table of one column, whose distinct values stand in their order.
    """
    frames, ordinal, size = [], F.lit(0).cast("long"), 1
    for name, values in reversed(axes.items()):
        if isinstance(values, DataFrame):
            frame = global_rank(values.toDF(name).distinct(), [name], f"_{name}")
            n = frame.count()
        else:
            frame = F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"`{name}` {'string' if isinstance(values[0], str) else 'int'}, `_{name}` int"))
            n = len(values)
        frames.append(frame)
        ordinal = ordinal + F.col(f"_{name}") * F.lit(size).cast("long")
        size *= n
    # large axes first: the small ones are broadcast to them
    frames.sort(key=lambda f: f.columns[0] in [k for k, v in axes.items() if isinstance(v, DataFrame)], reverse=True)
    crossed = reduce(lambda a, b: a.crossJoin(b), frames)
    return crossed.withColumn("ordinal", ordinal).select(*axes, "ordinal")


def evaluate(variants: DataFrame, group: str | list[str], key: str, schemes: list[str], sizes: list[int], seeds: list[int], cap: int = 256) -> DataFrame:
    """A row of :func:`ridge_grid` for each group, scheme, n and seed of variants (group, key, vec, y, fold columns).

    ``group`` may list further axes that have features of their own, such as the checkpoint and the readout. Validation is
    capped and, like the test rows of fold 0, the same for all n and seeds: these rows are not copied for them.
    """
    group = [group] if isinstance(group, str) else list(group)
    long = fold_roles(variants, schemes)
    fixed = [*group, "scheme"]
    pool = draws(long.where("role = 'pool'"), fixed, key, sizes, seeds).withColumn("role", F.lit("train"))
    val = capped(long.where("role = 'val'"), fixed, key, cap)
    held = val.unionByName(long.where("role = 'test'")).select(*fixed, "role", "vec", "y")
    return ridge_grid(pool.select(*fixed, "n", "seed", "role", "vec", "y"), [*fixed, "n", "seed"], held=held)


def shard_faults(shards: DataFrame, expected: DataFrame, config: list[str], name: str = "shard") -> DataFrame:
    """fault, n: missing and foreign configurations, shards that do not hold one row, rows that contradict their shard's name."""
    sides = coverage(expected, shards, *config).groupBy(F.col("side").alias("fault")).agg(F.count("*").alias("n"))
    sizes = shards.groupBy(name).agg(F.count("*").alias("_n")).where("_n <> 1").agg(F.count("*").alias("n")).select(F.lit("not one row").alias("fault"), "n")
    wrong = shards.where(F.col(name) != shard_name(config)).agg(F.count("*").alias("n")).select(F.lit("contradicts its name").alias("fault"), "n")
    return sides.unionByName(sizes.unionByName(wrong).where("n > 0"))


def shard_name(config: list[str]):
    """A name that no other configuration has: every field, with its own length before it."""
    return F.concat_ws("_", *[F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit("-"), F.col(c).cast("string")) for c in config])


def in_grid_order(results: DataFrame, expected: DataFrame, config: list[str]) -> DataFrame:
    return results.join(expected.select(*config, "ordinal"), config).orderBy("ordinal")
