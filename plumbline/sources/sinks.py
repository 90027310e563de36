"""Writing results: shards that a rerun replaces, published in two phases, summaries, and a ledger of counts."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.commits import CommitLog
from ..operators.gates import GateError
from ..operators.grid import in_grid_order, shard_faults, shard_name


def write_prepared(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_shards(results: DataFrame, path: str, config: list[str]) -> None:
    """One partition for each configuration; writing again replaces only the configurations that are written."""
    shards = results.withColumn("shard", shard_name(config))
    shards.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def aggregate_shards(spark: SparkSession, path: str, expected: DataFrame, config: list[str]) -> DataFrame:
    """All shards in grid order; an incomplete, foreign, doubled or contradicting one is an error."""
    shards = spark.read.parquet(path)
    if bad := shard_faults(shards, expected, config).collect():  # a row for each kind of fault
        raise GateError("; ".join(f"{r.n} {r.fault}" for r in bad))
    return in_grid_order(shards.drop("shard"), expected, config)


def publish_shards(results: DataFrame, path: str, config: list[str]) -> int:
    """Stage one shard for each configuration, then name them in a commit: the new version.

    Shards of other configurations stay those of the commits before. The commit holds each shard's run, rows and digest.
    A run that dies before its commit changes nothing that is read, and :func:`torn_runs` names it; of two runs that
    publish one configuration at once the later commit counts, and none is lost.
    """
    log, run = CommitLog(results.sparkSession, path, ("runs",)), uuid.uuid4().hex
    schema = ", ".join(f"`{n}` {t}" for n, t in results.dtypes)
    if (held := log.head({"shards": {}, "schema": schema})["schema"]) != schema:
        raise GateError(f"the published shards are of {held}, these of {schema}")
    folder = f"{log.path}/runs/run={run}"
    results.withColumn("shard", shard_name(config)).write.partitionBy("shard").parquet(folder)
    staged = results.sparkSession.read.schema(f"{schema}, shard string").parquet(folder) if any(n.startswith("shard=") for n in log.names(f"runs/run={run}")) else None
    made = {r.shard: {"run": run, "rows": r.n, "digest": r.digest} for r in shard_digests(staged).toLocalIterator()} if staged is not None else {}
    while True:
        last = log.head({"shards": {}})
        if log.put({"version": last["version"] + 1, "shards": last["shards"] | made, "run": run, "schema": schema}):
            return last["version"] + 1


def shard_digests(shards: DataFrame) -> DataFrame:
    """shard, n, digest: an order-free digest of each shard's rows."""
    row = F.xxhash64(*[c for c in shards.columns if c != "shard"])
    return shards.groupBy("shard").agg(F.count("*").alias("n"), F.concat_ws("-", F.bit_xor(row).cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string")).alias("digest"))


def read_published(spark: SparkSession, path: str, expected: DataFrame, config: list[str]) -> DataFrame:
    """The shards of the last commit in grid order. Shards whose rows are not those of their commit are named in an error, as are the faults of :func:`aggregate_shards`."""
    log = CommitLog(spark, path, ("runs",))
    head = log.head({"shards": {}})
    if not (named := head["shards"]):
        raise GateError(f"nothing is published in {path}")
    runs = sorted({s["run"] for s in named.values()})
    table = spark.createDataFrame([(k, s["run"], s["rows"], s["digest"]) for k, s in named.items()], "shard string, run string, n long, digest string")
    read = spark.read.schema(f"{head['schema']}, run string, shard string").option("basePath", f"{log.path}/runs").parquet(*[f"{log.path}/runs/run={r}" for r in runs])
    held = read.join(table.select("shard", "run"), ["shard", "run"], "left_semi").drop("run")
    wrong = table.join(shard_digests(held).select("shard", F.col("n").alias("_n"), F.col("digest").alias("_digest")), "shard", "left").where("not (n <=> _n and digest <=> _digest)")
    if bad := [r.shard for r in wrong.select("shard").orderBy("shard").limit(20).collect()]:
        raise GateError(f"shards {bad} are not those that were committed")
    if bad := shard_faults(held, expected, config).collect():
        raise GateError("; ".join(f"{r.n} {r.fault}" for r in bad))
    return in_grid_order(held.drop("shard"), expected, config)


def torn_runs(spark: SparkSession, path: str) -> list[str]:
    """Runs that were staged and that no commit names: of writers that died, or are still at work."""
    log = CommitLog(spark, path, ("runs",))
    committed = {log.entry(v)["run"] for v in log.versions()}
    return [n.removeprefix("run=") for n in log.names("runs") if n.removeprefix("run=") not in committed]


def write_summary(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small table as CSV with a header, or JSON lines."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def with_ledger(df: DataFrame, step: str, counts: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df``, whose next action also fills the observation with named counts, in the same pass."""
    seen = Observation(step)
    return df.observe(seen, *[c.alias(n) for n, c in counts.items()]), seen


def ledger_rows(spark: SparkSession, observations: Mapping[str, Observation]) -> DataFrame:
    """step, name, value."""
    rows = [(step, n, float(v)) for step, o in observations.items() for n, v in o.get.items() if v is not None]
    return spark.createDataFrame(rows, "step string, name string, value double").orderBy(F.col("step"), F.col("name"))
