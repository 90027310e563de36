"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: What each open step has written, the innermost last.
_MADE: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of that label that nothing else uses."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


#: Whether Spark deletes what a query has shuffled as soon as the query is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that later steps neither recompute nor depend on executors.

    What was shuffled for it goes once it is written; else it would stay until the driver happens to collect its garbage.
    """
    path, conf = new_folder(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, sorted({f.rsplit("/", 1)[0] for f in t.inputFiles()}))


def step(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """The written table that ``build()`` gives; what was written on the way is deleted, the table is not."""
    _MADE.append([])
    try:
        out = build()
        made, _MADE[-1] = _MADE[-1], []
        out = cut(out, label)
        _delete(out.sparkSession, made)
    finally:
        own = _MADE.pop()
    if _MADE:
        _MADE[-1] += own
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
