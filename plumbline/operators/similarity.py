"""Links between similar records, for splits that keep them together: MinHash bands find most of them, prefixes the rest.

A record is the set of its runs of ``size`` letters (or words); two are similar if their Jaccard similarity reaches the
threshold. Records with equal sets are one, found by a digest. The others get signatures, whose bands meet in buckets. A
bucket proposes no pairs of all its members: each member is held against ``LEADERS`` of them, the same ones for all, and in
larger buckets against the least of ever smaller parts that hash bits cut the bucket into, so that a record has as many
candidates as the logarithm of its buckets' size. Every candidate pair is decided on the whole sets.

What buckets have left apart is found exactly: in any order of the runs, two sets of similarity t share some of the first
``n - ceil(t n) + 1`` of each. Those prefixes are dealt out by run, runs that are frequent in the corpus last, and all pairs
of records that no links connect yet and that share enough of them are decided on the whole sets, without a bound on their
number. So the links connect exactly what all pairs of similar records would connect; a pair that they connect over others
need not be linked directly. Null and blank records, and those shorter than a run, are one set as they are: a short record
is its whole text, a blank one is linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import small_batches
from ..functions.shared import cut
from .clusters import clustered, components
from .splits import hash_split

BANDS, ROWS, LEADERS = 32, 4, 8
#: Cells of the sketch of the runs' frequencies, and the standard deviations of a cell's chance sum by which frequent ones exceed the mean.
CELL_BITS, STANDS_OUT = 20, 4
#: Against rounding of sizes times the threshold; it makes prefixes longer, never shorter.
SLACK = 1e-9


def runs(text: Column, size: int, words: bool) -> tuple[Column, Column]:
    """The parts of a text, to be named ``_parts``, and of these the sorted distinct 64-bit hashes of the runs of ``size`` letters or words; a shorter text is one run, a blank one none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+" if words else ""), lambda p: p != "")
    many = F.transform(F.sequence(F.lit(1), F.size("_parts") - size + 1), lambda i: F.xxhash64(F.slice("_parts", i, F.lit(size))))
    held = F.when(F.size("_parts") == 0, F.array().cast("array<bigint>")).when(F.size("_parts") < size, F.array(F.xxhash64("_parts"))).otherwise(many)
    return parts, F.array_sort(F.array_distinct(held))


def run_sets(df: DataFrame, key: str, text: str, size: int, words: bool) -> DataFrame:
    """The written table key, set, digest of the records that are not blank."""
    parts, held = runs(F.col(text), size, words)
    # a generator keeps the words from being split again for each use
    split = df.select(F.col(key).alias("key"), F.explode(F.array(parts)).alias("_parts"))
    sets = split.select("key", F.explode(F.array(held)).alias("set")).where(F.size("set") > 0)
    return cut(sets.withColumn("digest", F.sha2(F.array_join("set", ","), 256)), "sets")


def _bands(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """key, band, h: the hash of each band of each signature."""
    kind = dict(sets.dtypes)["key"]
    salts = [int(x) for x in np.random.default_rng(1).integers(1, 1 << 63, bands * rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            held = column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            starts = (offsets - offsets[0])[:-1]  # no set is empty
            if not len(starts):
                continue
            out = np.zeros((len(starts), bands), np.uint64)
            for k, salt in enumerate(salts):
                # a product with an odd number and a shift of its high bits, of well-spread hashes
                x = (held ^ np.uint64(salt)) * np.uint64(salt | 1)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0x9E3779B97F4A7C15)
                b = k // rows
                out[:, b] = (out[:, b] ^ np.minimum.reduceat(x, starts)) * np.uint64(0xBF58476D1CE4E5B9)
                out[:, b] ^= out[:, b] >> np.uint64(31)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * bands), pa.array(out.view(np.int64).ravel()))], names=["key", "hashes"])

    small_batches(sets.sparkSession)
    signed = sets.where(F.size("set") > 0).select("key", "set").mapInArrow(run, f"key {kind}, hashes array<long>")
    return signed.select("key", F.posexplode("hashes").alias("band", "h"))


def candidates(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """a, b (a < b): distinct pairs of keys that are held against each other, a bounded number for each record."""
    dealt = cut(_bands(sets, bands, rows), "bands")
    leader = lambda k: F.min_by("key", F.struct(F.xxhash64("key", F.lit(k)), F.col("key")))
    buckets = cut(dealt.groupBy("band", "h").agg(F.count("*").alias("n"), F.array(*[leader(k) for k in range(LEADERS)]).alias("leaders")).where("n > 1"), "buckets")
    member = dealt.join(buckets, ["band", "h"])
    led = member.select("key", F.explode(F.array_distinct("leaders")).alias("other"))
    # neighbours: each bucket is split in halves by hash bits again and again, and the part's least key leads it
    deeper = member.where(f"n > {LEADERS + 1}").select("band", "h", "key", F.explode(F.sequence(F.lit(1), F.least(F.lit(24), F.ceil(F.log2("n")).cast("int")))).alias("level"))
    cell = deeper.withColumn("cell", F.expr("pmod(xxhash64(key, band), shiftleft(1L, level))"))
    heads = cell.groupBy("band", "h", "level", "cell").agg(F.min("key").alias("other"))
    near = cell.join(heads, ["band", "h", "level", "cell"]).select("key", "other")
    return led.union(near).where("key <> other").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def _classes(sets: DataFrame) -> np.ndarray:
    """For each cell of hashes how far the runs in it exceed the mean, by powers of two; any classes give the same links, these few pairs."""
    cells = sets.select(F.explode("set").alias("run")).groupBy(F.shiftrightunsigned("run", 64 - CELL_BITS).alias("cell")).count().toArrow()  # 2**CELL_BITS rows
    sums = np.zeros(1 << CELL_BITS)
    sums[cells["cell"].to_numpy()] = cells["count"].to_numpy()
    mean = sums.mean()
    return np.clip(np.floor(np.log2(np.maximum((sums - mean) / max(2.0, STANDS_OUT * mean**0.5), 0.5))) + 1, 0, 15).astype(np.uint8)


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """key, n, prefix: the size of each set, and the first ``n - ceil(threshold n) + 1`` of its runs in the order of their class and hash."""
    kind, classes = dict(sets.dtypes)["key"], sets.sparkSession.sparkContext.broadcast(_classes(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            held, n = column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            held = held[np.lexsort((held, classes.value[(held.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)], row))]
            most = np.minimum(n, n - np.ceil(threshold * n - SLACK).astype(np.int64) + 1)
            prefix = held[np.arange(len(held)) - np.repeat(offsets[:-1] - offsets[0], n) < np.repeat(most, n)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]), pa.int32()), pa.array(prefix))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), lists], names=["key", "n", "prefix"])

    small_batches(sets.sparkSession)
    return sets.select("key", "set").mapInArrow(run, f"key {kind}, n long, prefix array<long>")


def _meetings(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """a, b, need of all pairs of other clusters, from rows (run, n, key, cluster, at) in the order of run and n; the rows of one run are held.

    Of the prefix of the larger set and what can count of the smaller one's, a similar pair shares ``need`` runs at least.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        token, n, at = (rows.column(k).to_numpy() for k in ("run", "n", "at"))
        cluster = rows.column("cluster").combine_chunks().dictionary_encode().indices.to_numpy()
        keys = rows.column("key").combine_chunks()
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lengths = np.diff(np.append(starts, len(token)))
        several = np.minimum.reduceat(cluster, starts) < np.maximum.reduceat(cluster, starts)
        after = np.repeat(starts + lengths, lengths) - np.arange(len(token)) - 1  # rows of the same run that follow
        i, step = np.flatnonzero(np.repeat(several, lengths) & (after > 0)), 1
        while len(i):
            j = i + step
            most = np.ceil(threshold * n[j] - SLACK)
            i, j, most = (x[n[i] >= most] for x in (i, j, most))  # those that follow are no smaller
            both = np.ceil(threshold / (1 + threshold) * (n[i] + n[j]) - SLACK)
            k = np.flatnonzero((cluster[i] != cluster[j]) & (at[i] <= n[i] - most))
            if len(k):
                need = np.maximum(both[k] - most[k] + 1, 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(i[k])), keys.take(pa.array(j[k])), pa.array(need)], names=["a", "b", "need"])
            step += 1
            i = i[after[i] >= step]

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if batch.column(0)[-1] == kept[0].column(0)[0]:
            continue
        rows = pa.Table.from_batches(kept)
        token = rows.column(0).to_numpy()
        last = int(np.searchsorted(token, token[-1]))
        yield from pairs(rows.slice(0, last))
        kept = rows.slice(last).to_batches()
    if kept:
        yield from pairs(pa.Table.from_batches(kept))


def _apart(sets: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b): all pairs of keys that may be similar and that ``links`` do not connect."""
    kind = dict(sets.dtypes)["key"]
    cluster = components(links).select(F.col("node").alias("key"), F.col("root").alias("_root"))
    placed = _prefixes(sets, threshold).join(cluster, "key", "left").withColumn("cluster", F.coalesce("_root", "key"))
    dealt = placed.select("n", "key", "cluster", F.posexplode("prefix").alias("at", "run")).select("run", "n", "key", "cluster", F.col("at").cast("long").alias("at"))
    small_batches(sets.sparkSession)
    met = dealt.repartition("run").sortWithinPartitions("run", "n").mapInArrow(lambda batches: _meetings(batches, threshold), f"a {kind}, b {kind}, need long")
    counted = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    return counted.where("shared >= need").select("a", "b")


def _decided(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs that reach the threshold."""
    side = lambda name: sets.select(F.col("key").alias(name), F.col("set").alias(f"_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    decided = met.select("a", "b", F.explode(F.array(F.struct(shared.alias("c"), (F.size("_a") + F.size("_b")).alias("n")))).alias("s"))
    close = decided.select("a", "b", (F.col("s.c") / (F.col("s.n") - F.col("s.c"))).alias("similarity"))
    return close.where(F.col("similarity") >= threshold)


def similar_links(df: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, words: bool = False, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """a, b, similarity: links between records, which connect all that are similar; those with equal sets are linked with the least of their keys."""
    sets = run_sets(df, key, text, size, words)
    same = cut(sets.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")), "same")
    equal = sets.select("key", "digest").join(same.where("n > 1"), "digest").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    one = cut(sets.join(same.select(F.col("first").alias("key")), "key", "left_semi").select("key", "set"), "distinct")
    close = cut(_decided(cut(candidates(one, bands, rows), "pairs"), one, threshold), "close")
    rest = _decided(cut(_apart(one, close, threshold), "apart"), one, threshold)
    return equal.union(close).union(rest)


def similarity_split(df: DataFrame, key: str, text: str, fractions: Sequence[float], seed: int, **how) -> DataFrame:
    """``df`` with cluster and role: records that are linked by similarity, over any number of links, are never in two roles."""
    links = cut(similar_links(df, key, text, **how).select("a", "b"), "links")
    return clustered(df, key, links).withColumn("role", hash_split(F.col("cluster"), fractions, seed))
