"""N-gram Jaccard join of whole documents by prefix trees (operator 5).

1. Each text becomes its set of word shingles (64-bit hashes). Equal sets are one class, which its smallest doc_id stands for.
2. A global order puts shingles that are frequent in the corpus last. Their frequencies come from a count sketch of
   fixed size over all texts, in which a frequent shingle stands out of what its cell holds by chance, however large the
   corpus is; any order gives the same links, a good one gives fewer candidates.
3. Two sets with Jaccard similarity t share a shingle among the first ``n - ceil(t n) + 1`` of each. Those prefixes are
   dealt out by shingle. In a group of up to ``GROUP`` sets all pairs are counted, and a pair stays if the shared part
   of its prefixes allows the overlap it needs. Larger groups are chained in order of size instead, which keeps all of
   their links within one cluster at linear cost. The largest groups are spread over tasks by size.
4. Clusters of candidates are cut into blocks. For each block, and each pair of blocks of a large cluster, the sets
   stand in a trie in global order, frequent shingles first; a probe walks it with partial overlaps that branches share,
   and leaves a subtree once the remaining lengths cannot reach the needed overlap, or all of it is linked already.
   Texts are dealt to pairs of blocks in rounds, so that no more copies than ``COPIES`` times the texts lie on disk.
5. Links become components by alternating star contraction on Spark.

Links are exact for 64-bit hashes of shingles. Null or wordless texts have an empty set, are linked with nothing and are their own component. Rows
with a null doc_id stay, with a null component if no row of their class has an id. Repeated rows share one component.
Texts may be of any length; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, may_hold, shingle_hashes, small_batches, table, texts_of, unused, utf8, with_frequent, word_hashes

WORDS = 5
PERCENT = 80
GROUP = 128
BLOCK = 256
#: Tokens that are dealt to many tasks: so many at most, with so many prefixes of one in HOT_SAMPLED sets.
HOT, HOT_LEAST, HOT_SAMPLED = 512, 64, 64
SKETCH_BITS, SKETCH_PARTS = 22, 64
#: Standard deviations of the chance sum of a cell by which the cell of a frequent shingle exceeds the mean.
STANDS_OUT = 4
#: Copies of texts that a round of pairs of blocks deals out, for each text of the corpus.
COPIES = 1
_KEY = np.uint64((1 << 60) - 1)


def sets_of(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, _, _, rows = word_hashes(*utf8(column))
    edges = np.searchsorted(rows, np.arange(len(column) + 1))
    return [np.unique(shingle_hashes(hashes[a:b], words)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def frequency_classes(cells: np.ndarray) -> np.ndarray:
    """How far the sum of each cell exceeds the mean, as a class of 4 bits: 0 up to what chance explains, then by powers of two.

    The mean grows with the corpus, and so do the sums of frequent shingles; chance grows with its root only. Measured by
    the mean itself, shingles of hundreds of sets would pass for rare ones in a large corpus.
    """
    mean = cells.mean()
    least = max(2.0, STANDS_OUT * mean**0.5)
    return np.clip(np.floor(np.log2(np.maximum((cells - mean) / least, 0.5))) + 1, 0, 15).astype(np.uint8)


def frequencies(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """The class of :func:`frequency_classes` of each of 2**SKETCH_BITS cells, which count the sets that hold their shingles."""
    size, part = 1 << SKETCH_BITS, 1 << SKETCH_BITS >> SKETCH_PARTS.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, np.int32)
        for batch in batches:
            for s in sets_of(batch.column(0), words):
                np.add.at(cells, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        packed = [zlib.compress(p.tobytes(), 1) for p in cells.reshape(SKETCH_PARTS, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary())], names=["part", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(p, np.zeros(part, np.int64)).__iadd__(np.frombuffer(zlib.decompress(c), np.int32))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["part", "cells"])

    small_batches(docs.sparkSession)
    kind = "part int, cells binary"
    parts = docs.select("text").mapInArrow(count, kind).repartition(SKETCH_PARTS // 4, "part").mapInArrow(add, kind)
    cells = np.zeros((SKETCH_PARTS, part), np.int64)
    for r in parts.toLocalIterator():  # SKETCH_PARTS rows
        cells[r.part] = np.frombuffer(zlib.decompress(bytes(r.cells)), np.int64)
    return frequency_classes(cells.reshape(-1))


def _ranked(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set in global order: frequency class, then hash."""
    cls = classes[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return np.unique((cls << np.uint64(60)) | (s & _KEY))


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def text_key() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def document_sets(docs: DataFrame, classes, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, key of the text, n, digest of the set, and its prefix in global order."""
    docs = docs.withColumn("key", text_key())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        order, sets = classes.value, sets_of(batch.column(1), words)
        prefixes = [_ranked(s, order)[: _prefix(len(s), percent)].view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "digest", "prefix"]
        )

    return map_batches(docs, run, "doc_id long, key binary, n long, digest binary, prefix array<long>")


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows (token, doc, n) in that order but for (token, n, doc): pairs within small groups, and chains (shared 0) along large ones.

    Of a group that is still open, GROUP + 1 rows are kept at most.
    """
    kept = np.zeros((3, 0), np.int64)
    open_large = False

    def made(rows: np.ndarray, large_first: bool, last: bool) -> tuple[list[np.ndarray], np.ndarray, bool]:
        token, doc, n = rows
        out: list[np.ndarray] = []
        if not len(token):
            return out, rows, False
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lengths = np.diff(np.append(starts, len(token)))
        large = lengths > GROUP
        large[0] |= large_first
        whole = np.ones(len(starts), bool)
        whole[-1] = last
        per_row, done = np.repeat(large, lengths), np.repeat(whole, lengths)
        run = np.repeat(np.arange(len(starts)), lengths)
        near = (run[1:] == run[:-1]) & per_row[1:] & (100 * n[:-1] >= percent * n[1:])
        i = np.flatnonzero(near)
        out.append(np.stack([doc[i], doc[i + 1], np.zeros(len(i), np.int64)]))
        short = ~per_row & done
        for step in range(1, min(GROUP, int(lengths.max()))):
            i = np.flatnonzero(short[step:] & (run[step:] == run[:-step]) & (100 * n[:-step] >= percent * n[step:]))
            if not len(i):
                if not (short[step:] & (run[step:] == run[:-step])).any():
                    break
                continue
            need = -(-percent * (n[i] + n[i + step]) // (100 + percent)) - (-(-percent * np.maximum(n[i], n[i + step]) // 100) - 1)
            out.append(np.stack([doc[i], doc[i + step], np.maximum(need, 1)]))
        if last:
            return out, rows[:, :0], False
        tail = starts[-1] if not large[-1] else len(token) - 1
        return out, rows[:, tail:], bool(large[-1])

    def batch_of(parts: list[np.ndarray]) -> pa.RecordBatch:
        a, b, need = np.concatenate(parts, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)], names=["a", "b", "need"])

    for batch in batches:
        rows = np.concatenate([kept, np.stack([np.array(batch.column(k)) for k in range(3)])], axis=1)
        out, kept, open_large = made(rows, open_large, False)
        if any(o.shape[1] for o in out):
            yield batch_of(out)
    out, *_ = made(kept, open_large, True)
    if any(o.shape[1] for o in out):
        yield batch_of(out)


def _hot_tokens(classes_of_sets: DataFrame) -> DataFrame:
    """At most HOT tokens that many prefixes hold, as one set in HOT_SAMPLED tells; which ones are found changes no link."""
    some = classes_of_sets.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLED)) == 0).select(F.explode("prefix").alias("token"))
    return cut(some.groupBy("token").count().where(F.col("count") >= HOT_LEAST).orderBy(F.col("count").desc(), "token").limit(HOT).select("token"), "hot")


def _spread_chains(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: what keeps each large group (token, doc_id, n) in one cluster, without a task that holds a group.

    Sets of one size are joined to the first of that size, and the firsts of neighbouring sizes to each other.
    """
    firsts = cut(rows.groupBy("token", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")), "firsts")
    star = with_frequent(rows, firsts, ["token", "n"], "c").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    in_order = Window.partitionBy("token").orderBy("n")
    after = firsts.select("first", "n", F.lead("first").over(in_order).alias("next"), F.lead("n").over(in_order).alias("next_n"))
    line = after.where(F.col("next_n") * percent <= 100 * F.col("n")).select(F.least("first", "next").alias("a"), F.greatest("first", "next").alias("b"))
    return star.unionByName(line).where("a < b")


def candidate_pairs(classes_of_sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: pairs of representatives that may be linked, and chains through large groups."""
    held = classes_of_sets.select(F.explode("prefix").alias("token"), "doc_id", "n")
    hot = _hot_tokens(classes_of_sets)
    some_hot = bool(hot.take(1))
    cold = held.join(F.broadcast(hot), "token", "left_anti") if some_hot else held  # HOT rows at most
    rows = cold.repartition("token").sortWithinPartitions("token", "n", "doc_id")
    small_batches(classes_of_sets.sparkSession)
    pairs = rows.mapInArrow(lambda batches: _pairs(batches, percent), "a long, b long, need long")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    found = counted.where("shared >= need and a < b").select("a", "b")
    return found.unionByName(_spread_chains(held.join(F.broadcast(hot), "token"), percent)) if some_hot else found


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each one reaches over edges (a, b), by alternating large and small stars."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Trie:
    """Sets of local shingle numbers in a compressed prefix tree; each node has a run of numbers, the ends below it and their bounds."""

    def __init__(self):
        self.children: dict[int, list] = {}

    @staticmethod
    def _node(run: np.ndarray) -> list:
        return [run, {}, [], len(run), 0, set()]  # run, children, sets that end here, least and most length below, sets below

    def add(self, s: np.ndarray, name: int) -> None:
        """``s`` is in trie order."""
        at, children, n = 0, self.children, len(s)
        while True:
            node = children.get(int(s[at]))
            if node is None:
                node = self._node(s[at:])
                node[3:] = [n, n, {name}]
                node[2].append((name, n))
                children[int(s[at])] = node
                return
            run, rest = node[0], s[at:]
            m = min(len(run), len(rest))
            differ = np.flatnonzero(run[:m] != rest[:m])
            same = int(differ[0]) if len(differ) else m
            if same < len(run):  # split the node
                lower = [run[same:], node[1], node[2], node[3], node[4], set(node[5])]
                node[0], node[1], node[2] = run[:same], {int(run[same]): lower}, []
            node[3], node[4] = min(node[3], n), max(node[4], n)
            node[5].add(name)
            at += same
            if at == n:
                node[2].append((name, n))
                return
            children = node[1]

    def linked(self, s: np.ndarray, member: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Names of the sets that reach the similarity with ``s``; ``member`` marks its numbers. Subtrees are skipped when ``skip(names)``."""
        n = len(s)
        stack = [(node, 0, 0) for node in self.children.values()]
        while stack:
            node, depth, shared = stack.pop()
            run, children, ends, least, most, names = node
            if 100 * most < percent * n or 100 * n < percent * least or skip(names):
                continue
            shared += int(member[run].sum())
            depth += len(run)
            # the best that a set below can reach: all its remaining numbers are shared, and its length suits that
            m = max(least, min(most, depth + n - shared))
            best = min(n, shared + m - depth)
            if 100 * best < percent * (n + m - best):
                continue
            for name, m in ends:
                if 100 * shared >= percent * (n + m - shared):
                    yield name
            stack += [(child, depth, shared) for child in children.values()]


def links_of(sets: list[np.ndarray], sides: list[int] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (positions) that connect what is linked among ``sets``; with ``sides``, between side 0 and side 1 only."""
    if len(sets) == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (len(a) + len(b) - both) else []
    flat, number = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(number, minlength=len(flat))
    place = np.empty(len(flat), np.int64)
    place[np.lexsort((flat, -count))] = np.arange(len(flat))  # frequent first
    cuts = np.cumsum([0, *map(len, sets)])
    local = [np.sort(place[number[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    trie, out, member = Trie(), [], np.zeros(len(flat), np.int64)
    order = range(len(sets)) if sides is None else [i for i, k in enumerate(sides) if k == 0]
    if sides is not None:
        for i in order:
            trie.add(local[i], i)
        order = [i for i, k in enumerate(sides) if k == 1]
    for i in order:
        member[local[i]] = 1
        for j in trie.linked(local[i], member, percent, lambda names, i=i: all(root(x) == root(i) for x in names)):
            if root(i) != root(j):
                parent[root(j)] = root(i)
                out.append((j, i))
        member[local[i]] = 0
        if sides is None:
            trie.add(local[i], i)
    return out


def _verify(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From rows (cluster, p, q, block, doc_id, text) with equal (cluster, p, q) next to each other: links a, b."""
    key, ids, texts, blocks = None, [], [], []

    def done() -> list[tuple[int, int]]:
        if len(ids) < 2:
            return []
        sets = sets_of(pa.array(texts, pa.string()), words)
        sides = None if key[1] == key[2] else [int(b == key[2]) for b in blocks]
        return [(ids[i], ids[j]) for i, j in links_of(sets, sides, percent)]

    for batch in batches:
        out = []
        for c, p, q, block, doc, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (c, p, q) != key:
                out += done()
                key, ids, texts, blocks = (c, p, q), [], [], []
            ids.append(doc)
            texts.append(text)
            blocks.append(block)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
    if out := done():
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """a, b: links among the clusters of candidates ``pairs``; they connect all that is linked."""
    clusters = components(pairs)
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = clusters.join(sizes, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    placed = cut(placed, "placed")
    near = may_hold(docs, "doc_id", placed.select("doc_id"))
    spread = placed.select("cluster", "block", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "doc_id")
    rounds = _rounds(placed.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0], docs)
    small_batches(docs.sparkSession)

    def links(of_round: DataFrame) -> DataFrame:
        texts = near.join(of_round, "doc_id").select("cluster", "p", "q", "block", "doc_id", "text")
        dealt = texts.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "doc_id")
        return dealt.mapInArrow(lambda batches: _verify(batches, words, percent), "a long, b long")

    if rounds == 1:
        return links(spread)
    at = F.pmod(F.xxhash64("cluster", "p", "q"), F.lit(rounds))
    return reduce(DataFrame.unionByName, [cut(links(spread.where(at == k)), "links") for k in range(rounds)])  # what a round has shuffled goes with it


def _rounds(copies: int, docs: DataFrame) -> int:
    """In how many parts the pairs of blocks are worked off, so that each deals out COPIES copies for each text at most."""
    return max(1, -(-copies // max(1, COPIES * docs.count()))) if copies else 1


def _components(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, key (of the text), n_shingles, digest (of the set), component_id for each row of ``documents``."""
    docs, spark = texts_of(documents), documents.sparkSession
    classes = spark.sparkContext.broadcast(frequencies(docs, words))  # 2**SKETCH_BITS bytes
    sets = cut(document_sets(docs, classes, words, percent), "sets")
    of_class = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    reps = sets.join(of_class, ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"]).select("doc_id", "n", "prefix")
    pairs = cut(candidate_pairs(reps, percent), "pairs")
    links = cut(verified(docs, pairs, words, percent), "links")
    roots = components(links).select(F.col("node").alias("rep"), "root")
    of_digest = of_class.select("digest", F.col("doc_id").alias("rep")).join(roots, "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    labelled = sets.select("doc_id", "key", F.col("n").alias("n_shingles"), "digest").join(of_digest, "digest", "left")
    return labelled.select("doc_id", "key", "n_shingles", "digest", F.coalesce("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id"))


def jaccard_components(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``documents``."""
    return _components(documents, words, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without all but one row of each component: the one with the smallest doc_id stays.

    Of rows that share that doc_id and their set of shingles, or are repeated, one stays; rows that share it with another
    set are other texts and stay. A row without an id goes if a row with one stands for its set; of the others, one stays
    for each set. Rows without an id and without words all stay.
    """
    kinds = dict(documents.dtypes)
    found = cut(_components(documents), "components")
    own = found.where("doc_id = component_id").groupBy("doc_id", "digest").agg(F.min("key").alias("_key")).select("doc_id", "_key")
    nameless = found.where("doc_id is null and component_id is null and n_shingles > 0").groupBy("digest").agg(F.min("key").alias("_key")).select(F.lit(None).cast("long").alias("doc_id"), "_key")
    key, number = unused(documents, "_key"), unused(documents, "_number")
    chosen = own.unionByName(nameless).toDF(unused(documents, "_id"), unused(documents, "_chosen"))
    twice = found.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    keyed = documents.withColumn(key, text_key())
    kept = keyed.join(chosen, [keyed["doc_id"].cast("long").eqNullSafe(F.col(chosen.columns[0])), F.col(key) == F.col(chosen.columns[1])], "left_semi")
    if twice:
        order = F.xxhash64(*[c for c in documents.columns if "map<" not in kinds[c]])
        kept = kept.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(order))).where(F.col(number) == 1)
    wordless = documents.where(F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(documents.columns).unionByName(wordless)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op5_ngram_join": op5_ngram_join}
SQL = {
    "op5_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT w.doc_id, count(g.s) AS n_shingles FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
links AS (
  SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y WHERE 100 * c >= 80 * (nx.n_shingles + ny.n_shingles - c)
), reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT n.doc_id, n.n_shingles, least(n.doc_id, coalesce(min(r.y), n.doc_id)) AS component_id FROM n LEFT JOIN reach r ON r.x = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
}
