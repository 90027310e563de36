"""Spreading small tables over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input for each core below which a table's few files would leave cores idle.
IDLE = 8 << 20
#: Bytes of input for each task of work on texts, which takes seconds a megabyte.
PIECE, MOST_PIECES = 8 << 20, 1 << 14
#: What one Arrow batch holds at most.
BATCH_ROWS, BATCH_BYTES = 20_000, 2 << 20


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its input is so small that its files hold fewer row groups than there are cores; else as it is.

    Work on texts is worth this shuffle only while the texts are few; larger inputs have enough splits of their own.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _size(df) < IDLE * cores else df


def in_pieces(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores, and over more tasks where its input is larger than PIECE for each core.

    For work that costs far more than this shuffle: how long a task takes then depends neither on the size of the input
    nor on how its files are split. Inputs of unknown size, which is taken for a huge one, stay as they are; inputs above
    MOST_PIECES have larger pieces.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, _size(df)
    return df if size > 1 << 50 else df.repartition(max(cores, min(MOST_PIECES, -(-size // PIECE))))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: very long texts stand beside short ones.

    The settings are read when a plan is run, which is after the operator has returned, so that they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
