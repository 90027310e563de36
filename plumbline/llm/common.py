"""What the operators of this subpackage share: tables, written cuts, Arrow batches and word scanning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.layout import small_batches
from ..functions.shared import cut, drop, shared_dir, step  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits for each marked id, and the largest bitmap; beyond it nothing is left out before a join.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: A key that makes up this share of the rows of a join is a frequent one: there are as many at most as the share says.
FREQUENT = 512


def _bitmap_size(n: int) -> int | None:
    size = 1 << max(16, (BITS_EACH * n - 1).bit_length())
    return size if size <= MOST_BITS else None


def _words(ids: Column, df: DataFrame, size: int) -> DataFrame:
    """word, bits: the words of a bitmap of ``size`` bits with the bit ``id mod size`` of each id set."""
    cells = df.select(F.pmod(ids, F.lit(size)).alias("_cell"))
    return cells.groupBy(F.expr("_cell div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(_cell % 64))")).alias("bits"))


def bits_of(ids: DataFrame, n: int) -> np.ndarray | None:
    """A bitmap of a column of about ``n`` longs, to be asked by :func:`has_bits`; None where it would be too large."""
    if (size := _bitmap_size(n)) is None:
        return None
    out = np.zeros(size // 64, np.int64)
    found = _words(ids[ids.columns[0]], ids, size).toArrow()  # MOST_BITS at most
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def has_bits(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where an id is not surely missing."""
    cells = ids & np.int64(64 * len(bitmap) - 1)
    return (bitmap[cells >> 6] >> (cells & 63)) & 1 == 1


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it a name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def marked_by(df: DataFrame, key: str, ids: DataFrame, mark: str = "marked") -> DataFrame:
    """``df`` with ``mark``: false where the key is surely not among ``ids`` (a written table), by a broadcast bitmap of BITS_EACH bits an id.

    Where that would be more than MOST_BITS, all rows are marked.
    """
    if (size := _bitmap_size(ids.count())) is None:
        return df.withColumn(mark, F.lit(True))
    cell, word, bits = unused(df, "_cell"), unused(df, "_word"), unused(df, "_bits")
    words = _words(F.xxhash64(ids[key]), ids, size).select(F.col("word").alias(word), F.col("bits").alias(bits))
    found = df.withColumn(cell, F.pmod(F.xxhash64(df[key]), F.lit(size))).join(F.broadcast(words), F.expr(f"{cell} div 64 = {word}"), "left")
    return found.select(*[df[c] for c in df.columns], F.coalesce(F.col(bits).bitwiseAND(F.expr(f"shiftleft(1L, int({cell} % 64))")) != 0, F.lit(False)).alias(mark))


def may_hold(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be among ``ids``; it spares the rest the shuffle of the exact join that is to follow."""
    mark = unused(df, "marked")
    return marked_by(df, key, ids, mark).where(mark).drop(mark)


def with_frequent(df: DataFrame, known: DataFrame, on: str | list[str], n: str, how: str = "inner") -> DataFrame:
    """The inner or left join of ``df`` with ``known``, a written table of keys and of the number ``n`` of rows of ``df`` that have each.

    Frequent keys meet in a broadcast of at most FREQUENT rows, so that none of them fills a task; the others in a shuffle.
    """
    on = [on] if isinstance(on, str) else on
    total = known.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    often = F.col(n) >= max(2, total / FREQUENT)
    values = [c for c in known.columns if c not in (*on, n)]
    top = F.broadcast(known.where(often).select(*on, F.struct(*values).alias("_top")))
    rest = known.where(~often).select(*[F.col(c).alias(f"_{c}") for c in on], F.struct(*values).alias("_rest"))
    met = df.join(top, on, "left")
    # a row that has met its key, or has none, goes anywhere, the same way each time a task is run
    meets = F.col("_top").isNull()
    for c in on:
        meets = meets & F.col(c).isNotNull()
    spread = F.when(meets, F.xxhash64(*on)).otherwise(F.xxhash64(*df.columns))
    keyed = rest.withColumn("_at", F.xxhash64(*[f"_{c}" for c in on]))
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    out = met.withColumn("_to", spread).join(keyed, [F.col("_to") == F.col("_at"), F.col("_top").isNull(), *same], "left")
    out = out.where("_top is not null or _rest is not null") if how == "inner" else out
    return out.select(*df.columns, *[F.coalesce(F.col(f"_top.{c}"), F.col(f"_rest.{c}")).alias(c) for c in values if c not in df.columns])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``fn`` on each Arrow batch of ``df``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(documents: DataFrame) -> DataFrame:
    """doc_id and text, null text as empty; other columns are left behind."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the n + 1 offsets into it."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of SplitMix64) over unsigned arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of ``base`` modulo 2**64."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = _POWERS[int(base)] = np.multiply.accumulate(known)
    return known[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text with A-Z lower-cased: 64-bit hash, start, end and row of each.

    ``inside`` tells for each byte whether words hold it, where they are other ones.

    A word's hash is a polynomial in its bytes, taken from prefix sums, then mixed; words never cross rows.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    solid = ~_SPACE[data] if inside is None else inside[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[_LOWER[data]] * powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(_BASE_INV, n)[starts] + (ends - starts).astype(np.uint64))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, starts, ends, rows


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` word hashes; a shorter sequence is one shingle, none gives none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)] + np.uint64(k + 1))
    return out
