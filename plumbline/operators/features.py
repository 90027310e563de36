"""Feature tables: encoders in batches, readouts, the content-addressed store, and the cost of padding."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import global_rank
from ..functions.layout import small_batches
from .gates import GateError

READOUTS = ("mean", "at_position", "difference_at_position")


def hashed_text_features(df: DataFrame, key: str, text: str, width: int = 256) -> DataFrame:
    """key, vec: L2-normalised counts of hashed words; a blank text is a zero vector, not the encoding of nothing."""
    words = df.select(key, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\W+"), lambda w: w != "").alias("_words"))
    counted = Normalizer(inputCol="_tf", outputCol="_v").transform(HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width).transform(words))
    return counted.select(key, vector_to_array("_v", "float32").alias("vec"))


def encoded(df: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], width: int, batch: int = 8, limit: int | None = None) -> DataFrame:
    """key, vec by a user's encoder, made once a task; texts stand in partitions by length, longest first, so batches pad little.

    A worker holds one small Arrow batch at a time, however long the longest texts are, which stand together here.
    Blank texts are zero vectors. A vector that is not finite or not ``width`` long is an error.
    """
    kind = dict(df.dtypes)[key]
    small_batches(df.sparkSession)
    cut_ = F.substring(F.coalesce(F.col(text), F.lit("")), 1, limit or 2**31 - 1)
    dealt = df.select(F.col(key), cut_.alias("_t"), F.length(cut_).alias("_n")).repartitionByRange(F.col("_n").desc(), F.col(key)).sortWithinPartitions(F.col("_n").desc(), key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for frame in frames:
            vectors = []
            for at in range(0, len(frame), batch):
                texts = frame["_t"].iloc[at : at + batch].tolist()
                full = [t for t in texts if t.strip()]
                made = iter(encode(full) if full else [])
                vectors += [next(made) if t.strip() else [0.0] * width for t in texts]
            if any(len(v) != width or not all(abs(x) < float("inf") for x in v) for v in vectors):
                raise ValueError("the encoder gave a vector of another width or with numbers that are not finite")
            yield pd.DataFrame({key: frame[key], "vec": vectors})

    return dealt.select(key, "_t").mapInPandas(run, f"`{key}` {kind}, vec array<float>")


def readout(residues: DataFrame, key: str, name: str, position: DataFrame | None = None, wildtype: DataFrame | None = None) -> DataFrame:
    """One vector a key from residue vectors (key, position, vec).

    ``mean`` averages all residues. ``at_position`` takes the one that ``position`` (key, position) names.
    ``difference_at_position`` subtracts the wild type's vector, of which each distinct position is read once.
    """
    if name not in READOUTS:
        raise GateError(f"{name} is none of {READOUTS}")
    if name == "mean":
        means = residues.groupBy(key).agg(Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>"))).alias("m"))
        return means.select(key, vector_to_array("m").cast("array<float>").alias("vec"))
    at = residues.join(position, [key, "position"])
    if name == "at_position":
        return at.select(key, "vec")
    wanted = position.select("position").distinct()
    base = wildtype.join(wanted, "position", "left_semi").select("position", F.col("vec").alias("_wt"))
    return at.join(base, "position").select(key, F.zip_with("vec", "_wt", lambda a, b: a - b).alias("vec"))


def colocated(residues: DataFrame, key: str, table: str, buckets: int = 64) -> DataFrame:
    """The residue vectors (key, position, vec) as a table in buckets by key and position, sorted within: :func:`readout` joins it without shuffling it.

    What is joined with it is dealt to its buckets, so that the largest table is shuffled once, when it is written. One
    file a bucket is written; the number of buckets is the parallelism of later joins.
    """
    dealt = residues.select(key, "position", "vec").repartition(buckets, key, "position")
    dealt.write.bucketBy(buckets, key, "position").sortBy(key, "position").format("parquet").option("compression", "zstd").saveAsTable(table)
    return residues.sparkSession.table(table)


def spec_text(spec: Mapping[str, object]) -> str:
    """The canonical text of everything that changes a vector; the batch size is not part of it."""
    return json.dumps({k: v for k, v in spec.items() if k != "batch_size"}, sort_keys=True, separators=(",", ":"))


def item_key(spec: str | Column, item: Column) -> Column:
    return F.sha2(F.concat(F.lit(spec) if isinstance(spec, str) else spec, F.decode(F.lit(b"\x00"), "UTF-8"), item), 256)


def cache_misses(items: DataFrame, item: str, spec: str, store: DataFrame) -> DataFrame:
    """The distinct items that the store has no vector for under this spec, with their keys."""
    keyed = items.select(F.col(item)).distinct().withColumn("item_key", item_key(spec, F.col(item)))
    return keyed.join(store.select("item_key"), "item_key", "left_anti")


def miss_reasons(specs: DataFrame) -> DataFrame:
    """Why a stored entry (old_spec, new_spec as JSON; old may be null) does not serve: predates, changed, removed, or other inputs."""
    kind = "map<string,string>"
    old, new = F.from_json("old_spec", kind), F.from_json("new_spec", kind)
    changed = F.array_sort(F.map_keys(F.map_filter(new, lambda k, v: ~(v.eqNullSafe(F.element_at(old, k))))))
    removed = F.array_sort(F.map_keys(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))))
    reason = F.when(F.col("old_spec").isNull(), "predates specs").when(F.size(changed) > 0, "changed").when(F.size(removed) > 0, "removed").otherwise("inputs changed")
    return specs.withColumn("reason", reason).withColumn("changed", changed).withColumn("removed", removed)


def fingerprint(df: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """One digest of the rows whatever their order: row digests add up within buckets by hash, buckets hash together."""
    row = F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))
    part = lambda at: F.conv(F.substring("_h", at, 8), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("_h")).groupBy((F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") % buckets).alias("_b")).agg(F.count("*").alias("n"), *[F.sum(part(1 + 8 * i)).alias(f"s{i}") for i in range(4)])
    line = F.concat_ws(":", F.format_string("%05d", "_b"), "n", *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("fingerprint"))


def ordered_fingerprint(df: DataFrame, columns: list[str], order: list[str], fan: int = 1024) -> DataFrame:
    """One digest of the rows in the order of ``order``, a total order: n, fingerprint. Two rows that change places change it; the layout does not.

    Digests of ``fan`` neighbours by rank hash together, then those of ``fan`` such runs, until one is left: a tree that
    depends on ranks alone, with ``fan`` digests at most in a task's hands. An empty table has the digest of nothing.
    """
    row = F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))
    level = global_rank(df.select(*order, row.alias("_h")), order, "_place").select("_place", "_h")
    count = n = level.count()
    while True:
        runs = level.groupBy(F.expr(f"_place div {fan}").alias("_place"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_h"))), lambda s: s["_h"]), "")
        level = runs.agg(F.sha2(joined, 256).alias("_h"))
        n = -(-n // fan)
        if n <= 1:
            break
    return level.agg(F.lit(count).cast("long").alias("n"), F.coalesce(F.first("_h"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


def assembled(blocks: dict[str, DataFrame], names: list[str], key: str) -> DataFrame:
    """The blocks of an arm (key, vec) concatenated in the given order; a key that lacks a block is an error."""
    if lack := [n for n in names if n not in blocks]:
        raise GateError(f"no block {lack}")
    out = blocks[names[0]].select(key, F.col("vec").alias("_0"))
    for i, n in enumerate(names[1:], 1):
        out = out.join(blocks[n].select(key, F.col("vec").alias(f"_{i}")), key, "full")
    parts = [F.col(f"_{i}") for i in range(len(names))]
    whole = F.concat(*parts)
    return out.select(key, F.when(whole.isNull(), F.raise_error(F.lit("a key lacks a block"))).otherwise(whole).alias("vec"))


def length_batches(df: DataFrame, key: str, size: str, batch: int) -> DataFrame:
    """``df`` with rank and batch by (longest first, key); every row is in one batch."""
    return global_rank(df.withColumn("_minus", -F.col(size)), ["_minus", key], "rank").drop("_minus").withColumn("batch", F.expr(f"rank div {batch}"))


def length_profile(df: DataFrame, size: str) -> DataFrame:
    """n, mean, upper median x[n // 2], p90 x[int(.9 (n - 1))], max and total, by counts of distinct sizes."""
    counts = df.groupBy(F.col(size).alias("v")).agg(F.count("*").alias("c"))
    # one row a distinct size: the lists below grow with the range of sizes, not with the rows
    packed = counts.agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("v", "c"))).alias("d"), F.sum(F.col("v") * F.col("c")).alias("total"), F.max("v").alias("max"))
    at = lambda rank: F.expr(f"aggregate(d, struct(0L as seen, cast(null as bigint) as v), (s, x) -> struct(s.seen + x.c as seen, if(s.v is null and s.seen + x.c > {rank}, cast(x.v as bigint), s.v) as v), s -> s.v)")
    return packed.select("n", (F.col("total") / F.col("n")).alias("mean"), at("n div 2").alias("median"), at("cast(floor(0.9D * (n - 1)) as bigint)").alias("p90"), F.col("max").cast("long").alias("max"), F.col("total").cast("long").alias("total"))


def padding_cost(df: DataFrame, key: str, size: str, batches: list[int]) -> DataFrame:
    """batch, order (given: by key; bucketed: longest first), slots, square_slots, waste, and reduction against the given order."""
    given, bucketed = global_rank(df.select(key, size), [key], "rank"), length_batches(df.select(key, size), key, size, 1).select(key, size, "rank")
    both = given.withColumn("order", F.lit("given")).unionByName(bucketed.withColumn("order", F.lit("bucketed")))
    axes = df.sparkSession.createDataFrame([(b,) for b in batches], "batch int")
    per = both.crossJoin(F.broadcast(axes)).groupBy("order", "batch", F.expr("rank div batch").alias("_b")).agg(F.max(size).cast("long").alias("m"), F.count("*").alias("k"), F.sum(size).alias("useful"))
    sums = per.groupBy("order", "batch").agg(F.sum(F.col("m") * F.col("k")).alias("slots"), F.sum(F.col("m") * F.col("m") * F.col("k")).alias("square_slots"), F.sum("useful").alias("useful"))
    plain = sums.where(F.col("order") == "given").select("batch", F.col("slots").alias("_given"))
    return sums.join(F.broadcast(plain), "batch").select("batch", "order", "slots", "square_slots", (1 - F.col("useful") / F.col("slots")).alias("waste"), (F.col("_given") / F.col("slots")).alias("reduction"))
