"""Contrasts between arms and methods of result tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import global_rank, hash_order, quantiles
from ..functions.shared import cut
from .metrics import average_ranks


def gain_decomposition(summary: DataFrame, arm: str, score: str, baseline: str, ablated: str, control: str, grounded: str) -> DataFrame:
    """The gain of ``grounded`` over ``baseline`` and its shares: lost by volume, lost by vocabulary, surviving."""
    at = lambda name: F.max(F.when(F.col(arm) == name, F.col(score)))
    wide = summary.agg(at(baseline).alias("b"), at(ablated).alias("a"), at(control).alias("c"), at(grounded).alias("g"))
    gain = F.col("g") - F.col("b")
    share = lambda part: F.when(gain != 0, part / gain)
    return wide.select(gain.alias("gain"), share(F.col("g") - F.col("c")).alias("lost_by_volume"), share(F.col("c") - F.col("a")).alias("lost_by_vocabulary"), share(F.col("a") - F.col("b")).alias("surviving"))


def class_gains(f1: DataFrame, arm: str, label: str, baseline: str, other: str) -> DataFrame:
    """label, baseline, other, gain, ordered by the baseline."""
    base = f1.where(F.col(arm) == baseline).select(label, F.col("f1").alias("baseline"))
    more = f1.where(F.col(arm) == other).select(label, F.col("f1").alias("other"))
    return base.join(more, label).withColumn("gain", F.col("other") - F.col("baseline")).orderBy("baseline", label)


def paired(results: DataFrame, method: str, score: str, config: list[str], first: str, second: str, keep=None) -> DataFrame:
    """config, first, second, delta for configurations that both methods have; ``keep`` filters them first."""
    rows = results if keep is None else results.where(keep)
    a = rows.where(F.col(method) == first).select(*config, F.col(score).alias("first"))
    b = rows.where(F.col(method) == second).select(*config, F.col(score).alias("second"))
    return a.join(b, config).withColumn("delta", F.col("first") - F.col("second"))


def paired_summary(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, n, mean_delta, win_share."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.avg((F.col("delta") > 0).cast("double")).alias("win_share"))


def signed_rank(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, w_plus, z: Wilcoxon's signed ranks with average ranks, zeros left out, by the normal approximation with ties corrected."""
    rows = pairs.where("delta <> 0").withColumn("_a", F.abs("delta"))
    ranks = average_ranks(rows, by, "_a", "_r")
    ties = rows.groupBy(*by, "_a").agg(F.count("*").alias("_t")).groupBy(*by).agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    sums = rows.join(ranks, [*by, "_a"]).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("delta") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"))
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    return sums.join(ties, by).select(*by, "n", "w_plus", F.when(variance > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance)).alias("z"))


def p_value(z: float) -> float:
    """Two-sided, from the normal distribution."""
    from math import erfc, sqrt

    return erfc(abs(z) / sqrt(2))


def erfc(x: Column) -> Column:
    """The complementary error function of numbers from 0 on: a series of positive terms below 3, a continued fraction above."""
    term = lambda s, k: F.struct((s["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * 2 * x * x / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("term"), x.alias("sum")), term, lambda s: s["sum"])
    scale = 2 / math.sqrt(math.pi)
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda t, k: x + (k / F.lit(2.0)) / t)
    return F.when(x < 3, 1 - scale * F.exp(-x * x) * series).otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * fraction))


#: Pairs up to which the distribution of the rank sum is counted out, if no two differences are equal in size.
EXACT = 25


def signed_rank_test(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, w_plus, z, p, exact: as :func:`signed_rank`, with the two-sided chance of a rank sum as far out.

    Up to EXACT pairs without ties it is counted over all 2^n signs (``exact``); else it is that of the normal
    distribution. Without a pair that differs there is no row; where z is undefined, p is null.
    """
    rows = pairs.where("delta <> 0").withColumn("_a", F.abs("delta"))
    tied = rows.groupBy(*by, "_a").agg(F.count("*").alias("_t")).groupBy(*by).agg((F.max("_t") > 1).alias("_tied"))
    ranked = signed_rank(pairs, by).join(tied, by) if by else signed_rank(pairs, by).crossJoin(tied)
    # how many of the 2^k signs of the ranks 1 to k give each sum, rank by rank
    more = lambda counts, k: F.transform(F.sequence(F.lit(0), F.size(counts) + k - 1), lambda i: F.coalesce(F.get(counts, i), F.lit(0.0)) + F.coalesce(F.when(i >= k, F.get(counts, i - k)), F.lit(0.0)))
    known = ~F.col("_tied") & (F.col("n") <= EXACT)
    few = F.when(known, F.col("n")).otherwise(1).cast("int")
    counted = ranked.withColumn("_known", known).withColumn("_ways", F.aggregate(F.sequence(F.lit(1), few), F.array(F.lit(1.0)), more))
    at = F.col("w_plus").cast("int")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    below, above = total(F.slice("_ways", F.lit(1), at + 1)), total(F.slice("_ways", at + 1, F.greatest(F.size("_ways") - at, F.lit(1))))
    p = F.when(F.col("_known"), F.least(F.lit(1.0), 2 * F.least(below, above) / F.pow(F.lit(2.0), few))).otherwise(erfc(F.abs("z") / math.sqrt(2)))
    return counted.select(*by, "n", "w_plus", "z", p.alias("p"), F.col("_known").alias("exact"))


#: Clusters whose sums are broadcast in one row at most.
CLUSTERS = 1 << 20


def cluster_bootstrap(pairs: DataFrame, cluster: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """mean, low, high: an interval of the mean delta from resampling whole clusters; each draw is a hash of seed, replicate and place.

    Clusters are reduced to sums and numbered first. Up to CLUSTERS of them travel in one row, so that a place looks up
    the clusters that its hashes name, and what is shuffled is a row for each replicate and task; more of them meet the
    places in a join.
    """
    sums = cut(global_rank(pairs.groupBy(F.col(cluster).alias("_k")).agg(F.sum("delta").alias("s"), F.count("*").alias("c")), ["_k"], "_i").select("_i", "s", "c"), "clusters")
    n = sums.count()
    drawn = sums.select(F.col("_i").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    at = F.pmod(F.conv(F.substring(hash_order(seed, F.col("replicate"), F.col("place")), 1, 8), 16, 10).cast("long"), F.lit(max(n, 1)))
    if n <= CLUSTERS:
        packed = sums.agg(F.array_sort(F.collect_list(F.struct("_i", "s", "c"))).alias("_all"))
        met = drawn.select("replicate", at.cast("int").alias("_at")).join(F.broadcast(packed)).select("replicate", F.get("_all", F.col("_at")).alias("_d")).select("replicate", "_d.s", "_d.c")
    else:
        met = drawn.select("replicate", at.alias("_i")).join(sums, "_i")
    means = met.groupBy("replicate").agg((F.sum("s") / F.sum("c")).alias("m"))
    tail = (1 - level) / 2
    return quantiles(means, "m", {"low": tail, "high": 1 - tail}).crossJoin(sums.agg((F.sum("s") / F.sum("c")).alias("mean"))).select("mean", "low", "high")


def sign_consistency(pairs: DataFrame, seed: str) -> DataFrame:
    """seed, mean_delta, all_negative."""
    return pairs.groupBy(seed).agg(F.avg("delta").alias("mean_delta"), F.bool_and(F.col("delta") < 0).alias("all_negative"))


def crossover(curve: DataFrame, by: list[str], n: str) -> DataFrame:
    """by, crossover: the smallest n whose mean exceeds the floor; null if none does."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("mean") > F.col("floor"), F.col(n))).alias("crossover"))
