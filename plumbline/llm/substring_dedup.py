"""Repeated passages by content-defined chunks (operator 4).

A gear hash of the last ``SPAN`` bytes rolls over each text and cuts it where the hash meets a mask, so that a passage is
cut alike wherever it stands and an insertion shifts no cut beyond its neighbourhood; where no hash meets it for long,
the greatest hash cuts. Cuts stand between characters. Chunks are named by a 64-bit
digest. Spark counts the documents of each digest; of a digest that more than one document holds, the smallest doc_id
keeps its text and the others repeat it. Neighbouring repeated chunks of a document form a passage, whichever document
keeps each of them, where another document holds the two as neighbours, too; passages of at least ``PASSAGE`` bytes are
reported, in pieces that are kept or not, and the pieces that are not kept are removed. A chunk is shorter than a passage,
so that nothing is removed on the word of a single digest: a passage has two digests or more, and their pairs, in common
with another document. The most frequent digests and pairs are sent to all tasks, so that none of them fills one.

Null texts count as empty and repeat nothing, as do rows with a null doc_id. A doc_id names one text; copies with one
doc_id count as one document. Whole texts are read whatever their length; a document's own repetitions are not passages
of two documents. An empty table gives no rows. Other columns play no part in passages, whatever their names, and are
kept as they are where passages are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, marked_by, mix, powers, table, texts_of, utf8, with_frequent

SPAN_STEPS = 4
SPAN = 1 << SPAN_STEPS
LEAST, MOST, MASK_BITS = 16, 128, 4
PASSAGE = 160
_GEAR = mix(np.arange(3000, 3256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the chunks of each text of a batch: LEAST to MOST bytes and what is left of a character, the last one may be shorter."""
    within = ((data & 0xC0) == 0x80).tobytes()  # bytes that a character goes on with
    h = _GEAR[data]
    for k in range(SPAN_STEPS):
        add = h[: -(1 << k)] << np.uint64(1 << k)
        h[1 << k :] += add
    # the hash of SPAN bytes counts, older bytes are shifted out of the tested bits
    found = np.flatnonzero((h >> np.uint64(SPAN - MASK_BITS)) & np.uint64((1 << MASK_BITS) - 1) == 0) + 1
    rows, starts, ends = [], [], []
    places = found.tolist()
    n_places, i = len(places), 0
    for row, (at, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while at < stop:
            least = at + LEAST
            while i < n_places and places[i] < least:
                i += 1
            if i < n_places and places[i] <= min(at + MOST, stop):
                end = places[i]
            elif stop - at <= MOST:
                end = stop
            else:  # such as one word over and over: where the hash is greatest, wherever the text began
                end = least + int(h[least - 1 : at + MOST].argmax())
            while end < stop and within[end]:
                end += 1
            rows.append(row)
            starts.append(at)
            ends.append(end)
            at = end
    return np.array(rows, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_GEAR[data] * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INV, len(data))[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, ord, start, stop (bytes), digest of every chunk."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column(1))
        rows, starts, ends = cuts(data, offsets)
        first = np.searchsorted(rows, np.arange(batch.num_rows))
        digests = _digests(data, starts, ends)
        columns = [batch.column(0).take(pa.array(rows)), pa.array(np.arange(len(rows)) - first[rows]), pa.array(starts - offsets[rows]), pa.array(ends - offsets[rows]), pa.array(digests)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ord", "start", "stop", "digest"])

    return map_batches(docs, run, "doc_id long, ord long, start long, stop long, digest long")


def repeated_passages(documents: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """doc_id, start, stop (UTF-8 bytes), first_doc_id, kept: pieces of passages that other documents hold too; ``kept`` in the document that comes first."""
    docs = texts_of(documents).where("doc_id is not null")
    of_digest = chunks(docs).groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    shared = cut(of_digest.where("first_doc_id <> last").select("digest", "first_doc_id", "n"), "shared")
    found = with_frequent(marked_by(chunks(docs), "digest", shared).where("marked").drop("marked"), shared, "digest", "n").withColumn("kept", F.col("doc_id") == F.col("first_doc_id"))
    in_order = Window.partitionBy("doc_id").orderBy("ord", "digest")
    pair = F.when(F.lag("ord").over(in_order) == F.col("ord") - 1, F.xxhash64(F.lag("digest").over(in_order), "digest"))
    near = cut(found.dropDuplicates(["doc_id", "ord", "digest"]).withColumn("pair", pair), "near")
    of_pair = near.where("pair is not null").groupBy("pair").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a <> b")
    of_pair = cut(of_pair.select("pair", "n", F.lit(0).alias("starts")), "pairs")
    near = with_frequent(near, of_pair, "pair", "n", "left").withColumn("run", F.sum(F.coalesce("starts", F.lit(1))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    of_run = Window.partitionBy("doc_id", "run")
    whole = near.withColumn("from", F.min("start").over(of_run)).withColumn("to", F.max("stop").over(of_run)).where(F.col("to") - F.col("from") >= passage)
    pieces = whole.withColumn("piece", F.col("ord") - F.row_number().over(Window.partitionBy("doc_id", "run", "kept").orderBy("ord", "digest")))
    pieces = pieces.groupBy("doc_id", "run", "kept", "piece", "from", "to").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc_id").alias("first_doc_id"), F.count("*").alias("n"))
    # one kept chunk at an end of a passage of others: chance may have drawn it in, and nothing of it is removed
    lone = F.col("kept") & (F.col("n") == 1) & ((F.col("start") == F.col("from")) != (F.col("stop") == F.col("to")))
    return pieces.where(~lone).select("doc_id", "start", "stop", "first_doc_id", "kept")


def without_repeats(documents: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """The documents with repeated passages cut out where they are not kept; texts may become empty, other columns stay."""
    spans = repeated_passages(documents, passage).where("not kept").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_spans"))
    names = documents.columns
    held = "_spans"
    while held in names:
        held += "_"
    joined = documents.join(spans.withColumnRenamed("_spans", held), "doc_id", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        for i, spans_ in enumerate(batch.column(held).to_pylist()):
            if spans_ and texts[i]:
                raw, at, out = texts[i].encode(), 0, []
                for s in spans_:
                    out.append(raw[at : s["start"]])
                    at = max(at, s["stop"])
                texts[i] = b"".join([*out, raw[at:]]).decode("utf-8", "ignore")
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return map_batches(joined, run, documents.schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
SQL: dict[str, str] = {}
