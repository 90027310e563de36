"""Splits that keep groups together, keyed draws, permutations and stratified picks: the same on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import global_rank, hash_order, running_total, uniform
from ..functions.shared import cut
from .gates import GateError, overlap

ROLES = ("train", "val", "test")


def _checked(fractions: Sequence[float]) -> None:
    if len(fractions) != 3 or min(fractions) < 0 or abs(sum(fractions) - 1) > 1e-9:
        raise GateError(f"fractions {fractions} are not three that add up to one")


def hash_split(key: Column, fractions: Sequence[float], seed: int) -> Column:
    """The role of a group by its hash: no shuffle, group sizes decide how near the sizes come."""
    _checked(fractions)
    u = uniform(hash_order(seed, key))
    return F.when(u < fractions[0], "train").when(u < fractions[0] + fractions[1], "val").otherwise("test")


def balanced_split(df: DataFrame, key: str, fractions: Sequence[float], seed: int, large: float = 0.001) -> DataFrame:
    """``df`` with ``role``: groups in hash order fill the splits, so that each size is within one group of its target.

    Groups above the share ``large`` of all rows (so 1 / large at most) go one by one to the split that lacks most.
    The others lie in hash order on a line of their sizes, which the remaining targets cut; a running sum over ranges
    of hashes replaces one over all groups. Rows without a group are one group, named by null. A positive fraction that
    gets no row is an error, and so is an empty table.
    """
    _checked(fractions)
    groups = cut(df.groupBy(key).agg(F.count("*").alias("size")).withColumn("h", F.coalesce(hash_order(seed, F.col(key)), F.lit(""))), "groups")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        raise GateError("there is nothing to split")
    lack = [f * total for f in fractions]
    big = groups.where(F.col("size") > F.lit(large * total)).orderBy("h", key).collect()
    placed = []
    for r in big:
        k = max((i for i in range(3) if fractions[i] > 0), key=lambda i: (lack[i], -i))
        lack[k] -= r["size"]
        placed.append((r[key], ROLES[k]))
    small = groups.where(F.col("size") <= F.lit(large * total))
    lined = running_total(small, ["h", key], "size", "upto")
    at = lined.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    rest = [max(0.0, x) if f > 0 else 0.0 for x, f in zip(lack, fractions, strict=True)]
    scale = at / sum(rest) if sum(rest) else 0.0
    first, second = rest[0] * scale, (rest[0] + rest[1]) * scale
    middle = F.col("upto") - F.col("size") / 2
    roles = lined.select(key, F.when(middle < first, "train").when(middle < second, "val").otherwise("test").alias("role"))
    if placed:
        roles = roles.unionByName(df.sparkSession.createDataFrame(placed, roles.schema))
    roles = cut(roles, "roles")
    if empty := empty_roles(roles, fractions):
        raise GateError(f"no group for {empty}")
    # null meets null
    joined = df.join(roles.withColumnRenamed(key, "_group"), F.col(key).eqNullSafe(F.col("_group"))).drop("_group")
    return joined.select(key, *[c for c in df.columns if c != key], "role")


def empty_roles(split: DataFrame, fractions: Sequence[float]) -> list[str]:
    """Roles with a positive fraction and no row."""
    there = {r[0] for r in split.select("role").distinct().collect()}
    return [r for r, f in zip(ROLES, fractions, strict=True) if f > 0 and r not in there]


def inherited_split(df: DataFrame, is_test: Column, key: Column, fractions: Sequence[float], seed: int) -> DataFrame:
    """The given test rows stay test; the others are split by the hash of their group."""
    return df.withColumn("role", F.when(is_test, "test").otherwise(hash_split(key, fractions, seed)))


def fold_roles(df: DataFrame, schemes: Sequence[str]) -> DataFrame:
    """Long form: scheme, fold, role (fold 0 test, 1 validation, others pool). An unknown scheme is an error, as is a fold that is null or negative."""
    if lack := set(schemes) - set(df.columns):
        raise GateError(f"no scheme {sorted(lack)}")
    long = df.unpivot([c for c in df.columns if c not in schemes], list(schemes), "scheme", "fold")
    fault = F.raise_error(F.concat(F.lit("no fold in "), F.col("scheme")))
    return long.withColumn("role", F.when(F.col("fold").isNull() | (F.col("fold") < 0), fault).when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("pool"))


def capped(df: DataFrame, by: Sequence[str], key: str, most: int, salt: str = "validation") -> DataFrame:
    """At most ``most`` rows of each group, the first by hash; small groups stay whole. The limit is pushed into the sort."""
    w = Window.partitionBy(*by).orderBy(hash_order(salt, *[F.col(c) for c in by], F.col(key)), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def draws(pool: DataFrame, by: Sequence[str], key: str, sizes: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """``pool`` rows for each (n, seed): n of each group without replacement, drawn independently. Too small a pool is an error.

    Rows fan out to an axis only below a hash threshold of twice their share. Groups that come out short, if any, are
    drawn again from all of their rows, and only these.
    """
    spark = pool.sparkSession
    counts = cut(pool.groupBy(*by).agg(F.count("*").alias("_pool")), "pools")
    if short := counts.where(F.col("_pool") < max(sizes)).take(1):
        raise GateError(f"a pool of {short[0]['_pool']} rows is smaller than {max(sizes)}")
    axes = spark.createDataFrame([(n, s) for n in sizes for s in seeds], "n int, seed int")
    draw = hash_order(*[F.col(c) for c in by], F.col("n"), F.col("seed"), F.col(key))
    w = Window.partitionBy(*by, "n", "seed").orderBy("_h", key)
    pick = lambda rows: rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("n")).drop("_n", "_h", "_pool")
    fanned = pool.join(counts, list(by)).join(F.broadcast(axes)).withColumn("_h", draw)
    first = cut(pick(fanned.where(uniform(F.col("_h")) < (2 * F.col("n") + 50) / F.col("_pool"))), "drawn")
    got = first.groupBy(*by, "n", "seed").agg(F.count("*").alias("_got"))
    lacking = cut(counts.join(F.broadcast(axes)).join(got, [*by, "n", "seed"], "left").where(F.coalesce("_got", F.lit(0)) < F.col("n")).select(*by, "n", "seed"), "lacking")
    if not lacking.take(1):
        return first
    again = pool.join(lacking, list(by)).withColumn("_h", draw).withColumn("_pool", F.lit(0))
    return first.join(lacking, [*by, "n", "seed"], "left_anti").unionByName(pick(again).select(first.columns))


def split_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("role").agg(F.count("*").alias("n"))


def leak_audit(split: DataFrame, key: str) -> DataFrame:
    """role_a, role_b, n: keys that two roles share; no row where nothing leaks."""
    sets = split.select("role", key).distinct()
    pairs = sets.alias("a").join(sets.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}")).where("a.role < b.role")
    return pairs.groupBy(F.col("a.role").alias("role_a"), F.col("b.role").alias("role_b")).agg(F.count("*").alias("n"))


def leaks(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    return overlap(train, test, key)


def shuffled_pairs(df: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """key, other, value: each record with the value of another one by a permutation of the whole table."""
    ranked = global_rank(df.select(key, value), [key], "_rank")
    dealt = global_rank(df.select(F.col(key).alias("other"), value).withColumn("_h", hash_order(seed, F.col("other"))), ["_h", "other"], "_rank").drop("_h")
    return ranked.drop(value).join(dealt, "_rank").select(key, "other", value)


def stratified_sample(df: DataFrame, key: str, size_column: str, size: int, seed: int, strata: int = 10) -> DataFrame:
    """Exactly ``size`` rows: ``strata`` near-equal runs by (size, key), each with its rounded share by hash order.

    What rounding leaves over is topped up, or trimmed, in hash order over all strata. Only rows below a hash threshold
    well above the share that is wanted are sorted; should a stratum have too few of them, all rows are.
    """
    ranked = cut(global_rank(df, [size_column, key], "_rank"), "strata")
    n = ranked.count()
    if size > n:
        raise GateError(f"{size} of {n} rows are asked for")
    placed = ranked.withColumn("stratum", F.expr(f"int(_rank * {strata} div {max(n, 1)})")).withColumn("_h", hash_order(seed, F.col(key)))
    counts = {r["stratum"]: r["_all"] for r in placed.groupBy("stratum").agg(F.count("*").alias("_all")).collect()}  # ``strata`` rows
    quota = {s: int(size * c / n + 0.5) for s, c in counts.items()}
    share = size / max(n, 1)
    near = placed.where(uniform(F.col("_h")) < min(1.0, 2 * share + 50 * strata / max(n, 1)))
    enough = {r["stratum"]: r["_n"] for r in near.groupBy("stratum").agg(F.count("*").alias("_n")).collect()}
    rows = near if all(enough.get(s, 0) > q for s, q in quota.items()) else placed
    limits = df.sparkSession.createDataFrame([(s, q) for s, q in quota.items()], "stratum int, _quota int")
    w = Window.partitionBy("stratum").orderBy("_h", key)
    ordered = rows.join(F.broadcast(limits), "stratum").withColumn("_late", (F.row_number().over(w) > F.col("_quota")).cast("int"))
    # chosen ones first, then by hash: the limit trims or tops up
    return ordered.orderBy("_late", "_h", key).limit(size).drop("_rank", "_h", "_quota", "_late")


def evenly_spaced(df: DataFrame, key: str, size_column: str, picks: int) -> DataFrame:
    """The rows at ranks round(i (n - 1) / (picks - 1)) by (size, key); equal ranks are an error."""
    ranked = global_rank(df, [size_column, key], "rank")
    n = ranked.count()
    ranks = [round(i * (n - 1) / max(1, picks - 1)) for i in range(picks)]
    if len(set(ranks)) < picks:
        raise GateError(f"{picks} picks of {n} rows collide")
    return ranked.where(F.col("rank").isin(ranks))
