"""Keyed order: whatever is random is a hash of a seed and a key; ranks, running totals and quantiles are global without one task sorting all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def hash_order(*parts: object) -> Column:
    """md5 of the parts joined by ``:``; plain values are literals, columns are cast to text. Nulls are left out."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(digest: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


_PART_BITS = 33


def _dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` written in the order ``order``: ``_at`` rises with it, its bits above _PART_BITS are the part, those below the place in it.

    Parts are ranges of the order, of a size that shuffles choose. The table is written once: ranges that are drawn anew
    would not be the same ones.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranked")


def _part() -> Column:
    return F.shiftright("_at", _PART_BITS)


def _offsets(dealt: DataFrame, size: Column) -> DataFrame:
    """_part, _first: the sum of ``size`` over the parts before; a row for each part."""
    sums = {r["_part"]: r["_n"] for r in dealt.groupBy(_part().alias("_part")).agg(size.alias("_n")).collect()}
    first, rows = 0, []
    for p in sorted(sums):
        rows.append((p, first))
        first += sums[p]
    return dealt.sparkSession.createDataFrame(rows, "_part long, _first long")


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank of each row by the columns ``order``, which must be a total order; nulls come first.

    No task sees more than its range of the order, and no window is needed: a row's place in its range is known where it
    is written, and the sizes of the ranges before are added.
    """
    dealt = _dealt(df, order)
    ranked = dealt.withColumn("_part", _part()).join(F.broadcast(_offsets(dealt, F.count("*"))), "_part")
    return ranked.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))).drop("_part", "_first", "_at")


def running_total(df: DataFrame, order: list[str], value: str, name: str = "total") -> DataFrame:
    """``df`` with the sum of the whole numbers ``value`` up to and with each row, by the columns ``order``, a total order."""
    dealt = _dealt(df, order).withColumn("_part", _part())
    within = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(_offsets(dealt, F.sum(value))), "_part").withColumn(name, F.col("_first") + within).drop("_part", "_first", "_at")


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with a column for each share: that quantile of the values that are not null, linear between neighbours.

    Equal values are counted first, and their counts summed along the order, so that no buffer holds all values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    totals = running_total(counts, ["_v"], "_c", "_upto")
    n = totals.agg(F.max("_upto")).first()[0] or 0
    picks = []
    for name, share in shares.items():
        place = share * (n - 1)
        low = int(place // 1)
        at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
        picks.append((at(low) + (at(min(low + 1, max(n - 1, 0))) - at(low)) * (place - low)).cast("double").alias(name))
    return totals.agg(*picks)


def quantiles_by(df: DataFrame, by: list[str], value: str, shares: dict[str, float], windowed: int = 1 << 20) -> DataFrame:
    """by, and a column for each share: that quantile of each group's values that are not null, linear between neighbours.

    Values are counted first; counts are summed along the order of group and value, in windows up to ``windowed`` distinct
    values and along a written order beyond, so that no buffer holds a group. A group without values has nulls.
    """
    counts = cut(df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "counts")
    held = counts.where(F.col("_v").isNotNull())
    if counts.count() <= windowed:
        upto = held.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        total = running_total(held, [*by, "_v"], "_c", "_upto")
        before = total.groupBy(*[F.col(c).alias(f"_a{k}") for k, c in enumerate(by)]).agg(F.min(F.col("_upto") - F.col("_c")).alias("_before"))
        met = total.join(before, [F.col(c).eqNullSafe(F.col(f"_a{k}")) for k, c in enumerate(by)]) if by else total.crossJoin(before)
        upto = met.select(*by, "_v", "_c", (F.col("_upto") - F.col("_before")).alias("_upto"))
    sizes = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))), F.lit(0)).alias("_n"))
    named = sizes.toDF(*[f"_b{k}" for k in range(len(by))], "_n")
    met = named.join(upto, [F.col(f"_b{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by)] or F.lit(True), "left")
    picks = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_n") - 1)
        at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
        low = F.floor(place)
        picks += [at(low).alias(f"_low_{name}"), at(F.least(low + 1, F.col("_n") - 1)).alias(f"_high_{name}"), F.max(place - low).alias(f"_part_{name}")]
    keys = [f"_b{k}" for k in range(len(by))]
    out = met.groupBy(*keys).agg(*picks)
    return out.select(*[F.col(f"_b{k}").alias(c) for k, c in enumerate(by)], *[(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).cast("double").alias(n) for n in shares])
