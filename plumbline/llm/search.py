"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards (operator 11).

:func:`build` reads the texts once. Every task gathers documents until they hold ``SHARD_BYTES`` and writes an index of
this shard: a row for each term with its postings in blocks, and one row (null term) with the documents' ids and lengths
and the shard's totals. Postings are gaps of document numbers and frequencies, in as many bytes as the block needs. A
block carries its last document and the pairs (frequency, length) that no other pair of it beats on both, so that the
maximum of a block is exact for any statistics of the corpus, which only the finished index tells.

:func:`search` takes the items in blocks of at most ``ITEM_TERMS`` terms, which travel to the tasks; so do their weights.
Only lists of these terms are read; they meet by shard, each shard in one task. There the lists of an item are put in the
order of their maxima. Those whose maxima together stay below the 20th score so far are not essential: documents are
taken from the essential lists, and kept only while their partial score, the block maxima and the maxima of the lists
still to come can reach that score; only blocks that a kept document falls in are decompressed. A task's shards share its
heaps; the heaps of the tasks are merged by a ranking window, to which each brings ``k`` rows an item at most. Every
document is indexed and nothing is cut: the bounds are exact, and documents that can reach the 20th score are compared.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased; null texts have none.
Every row of ``documents`` is a document, repeated or not; among equal scores smaller doc_ids come first, and rows without
one last. Rows of ``benchmark`` with equal item_id and text are one item; rows that share only the item_id are ranked
separately. Items without a term that a document holds give no rows, nor does an empty table on either side. Texts of any
length are read in pieces. Other columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.layout import BATCH_ROWS
from .common import cut, map_batches, small_batches, table, texts_of, utf8, word_hashes

#: Bytes of text in a shard, postings in a block, results for an item.
SHARD_BYTES, BLOCK, TOP = 12 << 20, 128, 20
#: Bytes of text that are split into terms at once.
PIECE = 1 << 20
#: Terms of the items that are searched at once: what travels to the tasks.
ITEM_TERMS = 1 << 18
#: Documents of a shard that are ranked before the first bound is taken; each later window is four times as long.
WINDOW = 256

TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

INDEX = "shard long, term string, n int, last binary, pairs binary, sizes binary, postings binary, docs long, tokens long"


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``data`` of about PIECE bytes that split no term."""
    at, n = 0, len(data)
    while at < n:
        end = at + PIECE
        while end < n:
            gaps = np.flatnonzero(~TERM_BYTE[data[at:end]])
            edge = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            best = max(at + int(gaps[-1]) + 1 if len(gaps) else at, edge)
            if best > at:
                end = best
                break
            end += PIECE
        end = min(end, n)
        yield at, end
        at = end


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, start, end and row of every term of the texts, by the offsets of their bytes."""
    found = []
    for lo, hi in _pieces(data, offsets):
        inner = np.clip(offsets, lo, hi) - lo
        hashes, starts, ends, rows = word_hashes(data[lo:hi], inner, TERM_BYTE)
        found.append((hashes, starts + lo, ends + lo, rows))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binaries of these lengths, cut from the bytes of ``data`` one after another."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _postings(firsts: np.ndarray, docs: np.ndarray, freqs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """The blocks of all lists, which begin at ``firsts``: blocks a list, last documents, pairs, pairs a block, bytes, bytes a block, widths."""
    total = len(docs)
    counts = np.diff(np.append(firsts, total))
    blocks = -(-counts // BLOCK)
    heads = np.repeat(firsts, blocks) + BLOCK * _within(blocks)
    held = np.diff(np.append(heads, total))
    of = np.repeat(np.arange(len(heads)), held)
    last = docs[heads + held - 1]
    before = np.concatenate([[0], docs[:-1]])
    before[heads] = 0  # the first of a block is told in full
    gaps = docs - before
    wide, tall = _width(np.maximum.reduceat(gaps, heads)), _width(np.maximum.reduceat(freqs, heads))
    size = held * (wide + tall)
    begins = np.cumsum(size) - size
    place = _within(held)
    out = np.zeros(int(size.sum()), np.uint8)
    for value, width, at in ((gaps, wide[of], begins[of] + place * wide[of]), (freqs, tall[of], (begins + held * wide)[of] + place * tall[of])):
        for byte in range(4):
            if (own := width > byte).any():
                out[at[own] + byte] = (value[own] >> (8 * byte)) & 255
    # by falling frequency in each block, the pairs that are shorter than all before
    order = np.lexsort((lengths, -freqs, of))
    kept = lengths[order] - of * np.int64(1 << 40)
    least = np.minimum.accumulate(kept)
    best = np.ones(total, bool)
    best[1:] = kept[1:] < least[:-1]
    pairs = np.stack([freqs[order][best], lengths[order][best]], 1)
    return blocks, last, pairs, np.bincount(of[best], minlength=len(heads)), out, size, wide, tall


def _shard(number: int, parts: list[tuple[np.ndarray, ...]], ids: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """The index rows of a shard."""
    data = np.concatenate([p[0] for p in parts])
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    hashes = np.concatenate([p[1] for p in parts])
    starts = np.concatenate([p[2] + s for p, s in zip(parts, shift, strict=False)])
    ends = np.concatenate([p[3] + s for p, s in zip(parts, shift, strict=False)])
    rows = np.concatenate([p[4] for p in parts])
    names = pa.concat_arrays(ids)
    lengths = np.bincount(rows, minlength=len(names)).astype(np.int64)
    number_of = np.array(names.is_valid(), bool)
    norms = [np.ascontiguousarray(x).tobytes() for x in (names.fill_null(0).to_numpy().astype(np.int64), number_of, lengths)]
    whole = [[number], [None], [len(names)], [norms[0]], [norms[1]], [b""], [norms[2]], [int((lengths > 0).sum())], [int(lengths.sum())]]
    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
    heads = ["shard", "term", "n", "last", "pairs", "sizes", "postings", "docs", "tokens"]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(whole, kinds, strict=True)], heads)
    if not len(hashes):
        return
    order = np.argsort(hashes, kind="stable")  # rows rise already
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    heads_at = np.flatnonzero(first)
    freqs = np.diff(np.append(heads_at, len(hashes)))
    docs = rows[heads_at].astype(np.int64)
    term = np.ones(len(heads_at), bool)
    term[1:] = hashes[heads_at][1:] != hashes[heads_at][:-1]
    firsts = np.flatnonzero(term)
    shown = order[heads_at[firsts]]
    del hashes, rows, first
    blocks, last, pairs, held, out, size, wide, tall = _postings(firsts, docs, freqs, lengths[docs])
    spell = (ends - starts)[shown]
    text = _LOWER[data[np.repeat(starts[shown], spell) + _within(spell)]]
    of = np.repeat(np.arange(len(firsts)), blocks)
    added = lambda x: np.bincount(of, x, len(firsts)).astype(np.int64)
    sizes = np.stack([held.astype(np.uint8), (wide * 16 + tall).astype(np.uint8)], 1)
    n = np.diff(np.append(firsts, len(docs))).astype(np.int32)
    columns = [
        pa.array(np.full(len(firsts), number)), _binary(text, spell).cast(pa.string()), pa.array(n),
        _binary(last.astype(np.int32), 4 * blocks), _binary(pairs.astype(np.int32), 8 * added(held)), _binary(sizes, 2 * blocks), _binary(out, added(size)),
        pa.nulls(len(firsts), pa.int64()), pa.nulls(len(firsts), pa.int64()),
    ]
    made = pa.RecordBatch.from_arrays(columns, heads)
    for at in range(0, len(firsts), BATCH_ROWS):
        yield made.slice(at, BATCH_ROWS)


def build(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index of all rows: shard, term, n (postings), and blocks; see the module's text."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        parts, ids, held, docs = [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column(1))
            hashes, starts, ends, rows = terms_of(data, offsets)
            parts.append((data, hashes, starts.astype(np.int32), ends.astype(np.int32), (rows + docs).astype(np.int32)))
            ids.append(batch.column(0))
            held, docs = held + len(data), docs + batch.num_rows
            if held >= shard_bytes:
                yield from _shard(number, parts, ids)
                number, parts, ids, held, docs = number + 1, [], [], 0, 0
        if docs:
            yield from _shard(number, parts, ids)

    return cut(texts_of(documents).mapInArrow(run, INDEX), "index")


class _List:
    """The postings of a term in a shard as documents and shares of the term's weight; blocks are decompressed when asked for."""

    def __init__(self, row: tuple, lengths: np.ndarray, impact) -> None:
        n, last, pairs, sizes, self.data = row
        self.lengths, self.impact = lengths, impact
        self.last = np.frombuffer(last, np.int32)
        pairs = np.frombuffer(pairs, np.int32).reshape(-1, 2).astype(np.int64)
        sizes = np.frombuffer(sizes, np.uint8).reshape(-1, 2)
        heads = np.cumsum(sizes[:, 0], dtype=np.int64) - sizes[:, 0]
        self.most = np.maximum.reduceat(impact(pairs[:, 0], pairs[:, 1]), heads)
        self.top = int(self.most.max())
        self.wide, self.tall = sizes[:, 1] >> 4, sizes[:, 1] & 15
        self.held = np.full(len(self.last), BLOCK, np.int64)
        self.held[-1] = n - BLOCK * (len(self.last) - 1)
        size = self.held * (self.wide + self.tall)
        self.begins = np.cumsum(size) - size
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def _blocks(self, blocks: range | list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents and shares of blocks one after another."""
        if self.whole is not None:
            return self.whole
        for b in blocks:
            if b not in self.known:
                held, wide, tall, at = int(self.held[b]), int(self.wide[b]), int(self.tall[b]), int(self.begins[b])
                docs = np.cumsum(np.frombuffer(self.data, f"<u{wide}", held, at), dtype=np.int64)
                freqs = np.frombuffer(self.data, f"<u{tall}", held, at + held * wide).astype(np.int64)
                self.known[b] = (docs, self.impact(freqs, self.lengths[docs]))
        if len(self.known) == len(self.last):
            self.whole = self.known[0] if len(self.last) == 1 else tuple(np.concatenate([self.known[b][k] for b in range(len(self.last))]) for k in (0, 1))
            return self.whole
        return tuple(np.concatenate([self.known[b][k] for b in blocks]) for k in (0, 1))

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from lo up to hi, without hi, and their shares."""
        first = int(self.last.searchsorted(lo))
        end = min(int(self.last.searchsorted(hi)) + 1, len(self.last))
        if first >= end:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, shares = self._blocks(range(first, end))
        a, z = docs.searchsorted((lo, hi))
        return docs[a:z], shares[a:z]

    def among(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The share in each of the documents, which rise; ``blocks`` says where each would be."""
        first = np.ones(len(blocks), bool)
        first[1:] = blocks[1:] != blocks[:-1]
        there, shares = self._blocks(blocks[first].tolist())
        at = np.minimum(there.searchsorted(docs), len(there) - 1)
        return np.where(there[at] == docs, shares[at], 0)


class _Heap:
    """The best documents of an item: score, and among equal ones the smaller id; rows without an id come last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.named, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), 1

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            # what is below the k-th of its own kind stays out, ties with it do not
            over = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, named = scores[over], ids[over], named[over]
        scores, ids, named = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.named, named)
        best = np.lexsort((ids, ~named, -scores))[: self.k]
        self.scores, self.ids, self.named = scores[best], ids[best], named[best]
        if len(best) == self.k:
            self.least = max(1, int(self.scores[-1]))


def _rank(terms: list[tuple[str, int]], lists: dict[str, _List], ids: np.ndarray, named: np.ndarray, heap: _Heap) -> None:
    """Add the documents of a shard that can be among the best of an item, given as terms and weights."""
    own = sorted(((w * lists[t].top, w, lists[t]) for t, w in terms if w > 0 and t in lists), key=lambda x: x[0])
    if not own:
        return
    upto = [0]
    for most, _, _ in own:
        upto.append(upto[-1] + most)
    lo, hi, n = 0, WINDOW, len(ids)
    while lo < n:
        hi = min(hi, n)
        spare = 0  # so many lists can't bring a document to the least score on their own
        while spare < len(own) and upto[spare + 1] < heap.least:
            spare += 1
        if spare == len(own):
            return
        partial = np.zeros(hi - lo, np.int64)
        for _, w, x in own[spare:]:
            docs, shares = x.between(lo, hi)
            partial[docs - lo] += w * shares
        docs = np.flatnonzero(partial)
        docs, scores = docs + lo, partial[docs]
        for j in range(spare - 1, -1, -1):
            if not len(docs):
                break
            _, w, x = own[j]
            at = x.last.searchsorted(docs)
            past = at == len(x.last)
            here = np.minimum(at, len(x.last) - 1)
            keep = scores + np.where(past, 0, w * x.most[here]) + upto[j] >= heap.least
            docs, scores, here, past = docs[keep], scores[keep], here[keep], past[keep]
            if len(inside := np.flatnonzero(~past)):
                scores[inside] += w * x.among(docs[inside], here[inside])
        keep = scores >= heap.least
        if keep.any():
            heap.add(scores[keep], ids[docs[keep]], named[docs[keep]])
        lo, hi = hi, hi + 4 * (hi - lo)


def _impact(n: int, tokens: int):
    """The share of a term's weight that its frequency in a document of some length gives, for n documents of ``tokens`` terms."""

    def impact(freqs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * lengths * n) // tokens
        return (1_000_000_000 * freqs) // (1000 * freqs + 12 * m)

    return impact


def _searched(index: DataFrame, items: list[tuple[int, list[tuple[str, int]]]], n: int, tokens: int, tasks: int, k: int) -> DataFrame:
    """query, doc_id, score: at most k rows a query and task, the best ones of its shards."""
    impact = _impact(n, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {q: _Heap(k) for q, _ in items}
        shard, norms, lists = None, None, {}

        def close() -> None:
            if norms is None:
                return
            ids, named, lengths = (np.frombuffer(x, t) for x, t in zip(norms, (np.int64, bool, np.int64), strict=True))
            found = {term: _List(row, lengths, impact) for term, row in lists.items()}
            for q, terms in items:
                _rank(terms, found, ids, named, heaps[q])

        for batch in batches:
            at = batch.column(0).to_numpy()
            rows = batch.to_pydict()
            for i in range(batch.num_rows):
                if at[i] != shard:
                    close()
                    shard, norms, lists = at[i], None, {}
                if rows["term"][i] is None:
                    norms = rows["last"][i], rows["pairs"][i], rows["postings"][i]
                else:
                    lists[rows["term"][i]] = tuple(rows[c][i] for c in ("n", "last", "pairs", "sizes", "postings"))
        close()
        full = [(q, h) for q, h in heaps.items() if len(h.scores)]
        if full:
            columns = [np.repeat([q for q, _ in full], [len(h.scores) for _, h in full]), *(np.concatenate([getattr(h, c) for _, h in full]) for c in ("ids", "scores", "named"))]
            ids = pa.array(columns[1], pa.int64(), mask=~columns[3])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), ids, pa.array(columns[2], pa.int64())], ["query", "doc_id", "score"])

    terms = sorted({t for _, own in items for t, _ in own})
    wanted = index.sparkSession.createDataFrame([(t,) for t in terms], "term string")  # ITEM_TERMS at most
    columns = ["shard", "term", "n", "last", "pairs", "sizes", "postings"]
    lists = index.select(columns).join(F.broadcast(wanted), "term", "left_semi").select(columns)
    met = lists.union(index.where(F.col("term").isNull()).select(columns)).repartition(tasks, "shard").sortWithinPartitions("shard")
    return met.mapInArrow(run, "query long, doc_id long, score long")


def _item_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each term of each item with its repeats."""
    data, offsets = utf8(batch.column(1))
    _, starts, ends, rows = terms_of(data, offsets)
    raw = _LOWER[data].tobytes()
    items = batch.column(0).to_numpy()[rows] if len(rows) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array([raw[a:b].decode() for a, b in zip(starts, ends, strict=True)], pa.string())], ["query", "term"])


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of an index for each of ``items`` (item_id, text)."""
    spark = index.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    whole = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    named = cut(whole.withColumn("query", F.xxhash64("item_id", "text")), "items")
    counts = cut(map_batches(named.select("query", "text"), _item_terms, "query long, term string").groupBy("query", "term").agg(F.count("*").alias("repeats")), "terms")
    totals = index.where(F.col("term").isNull()).agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.countDistinct("shard")).first()
    n, tokens, shards = totals
    parts = max(1, -(-counts.count() // ITEM_TERMS))
    tasks = max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    found = None
    for part in range(parts if n else 0):
        own = counts.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).toArrow().to_pydict()
        terms = spark.createDataFrame([(t,) for t in sorted(set(own["term"]))], "term string")
        held = index.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).toArrow().to_pydict()
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in zip(held["term"], held["df"], strict=True)}
        queries: dict[int, list[tuple[str, int]]] = {}
        for q, t, times in zip(own["query"], own["term"], own["repeats"], strict=True):
            if t in weight:
                queries.setdefault(q, []).append((t, weight[t] * times))
        if queries:
            best = _searched(index, sorted(queries.items()), n, tokens, tasks, k)
            found = best if found is None else found.union(best)
    if found is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(named.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_UPPER, _BELOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"""unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_BELOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
OP11_SQL = f"""
with held as (select doc_id, {_TERMS} as term from documents),
tf as (select doc_id, term, count(*)::bigint as tf from held group by all),
size as (select doc_id, sum(tf)::bigint as n from tf group by 1),
total as (select count(*)::bigint as docs, sum(n)::bigint as tokens from size),
weight as (select term, floor(1000 * ln((2.0::double * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, total group by 1),
asked as (select item_id, {_TERMS} as term from benchmark),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // tokens))))::bigint as score
  from asked join weight using (term) join tf using (term) join size using (doc_id), total group by 1, 2),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= {TOP}
"""

QUERIES = {"op11_search": op11_search}
SQL = {"op11_search": OP11_SQL}
