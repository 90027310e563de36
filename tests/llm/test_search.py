import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, term string, score int, query long"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    """(item, rank, doc, score) by plain counting."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, tokens = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // tokens if tokens else 1
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n, words=40):
    vocabulary = [f"w{i}" for i in range(words)] + ["Ünïcode", "naïve", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 3, 10, 60])))) for i in range(n)]


@pytest.mark.parametrize("shard", [1, 600, 1 << 20])
def test_same_as_brute_force(spark, shard):
    rng = random.Random(shard)
    docs = corpus(rng, 300) + [(7, "w1 w2 W2, w3"), (7, "w1 w2 W2, w3"), (None, "w1 w9"), (None, None), (500, None), (501, ""), (502, "-- \x7f {}"), (503, "w5-" * 4000)]
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(42)], k=rng.choice([1, 4, 12])))) for i in range(12)]
    items += [(20, "w3 w3 W3 ÜNÏCODE naïve"), (21, None), (22, ""), (23, "nowhere"), (None, "w4 x1")]
    frame = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, rank int")
    got = S.search(S.build(frame, shard), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_many_equal_documents_keep_the_smallest_ids(spark):
    frame = spark.createDataFrame([(i, "the same text") for i in range(500)][::-1], "doc_id long, text string").repartition(5)
    got = S.search(S.build(frame, 500), spark.createDataFrame([(1, "same"), (1, "same"), (2, "text same")], "item_id long, text string")).collect()
    # a weight of zero: ln((2*500+2)/(2*500+1)) is under a thousandth, so that nothing scores above 0
    assert got == []
    frame = frame.union(spark.createDataFrame([(1000 + i, "other words") for i in range(500)], "doc_id long, text string"))
    got = S.search(S.build(frame, 500), spark.createDataFrame([(1, "same"), (1, "same"), (2, "text same")], "item_id long, text string")).collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in got) == [(i, r, r - 1) for i in (1, 2) for r in range(1, 21)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.search(S.build(none), items).collect() == []
    assert S.search(S.build(some), items.limit(0)).collect() == []
    assert S.search(S.build(none.union(some.limit(0))), items).collect() == []


def kernel(docs, items, block, window, monkeypatch):
    """Results and blocks (decompressed, all) of one shard without Spark."""
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "WINDOW", window)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
    data, offsets = S.utf8(batch.column(1))
    rows = [r for b in S._shard(0, [(data, *S.terms_of(data, offsets))], [batch.column(0)]) for r in b.to_pylist()]
    norms = rows[0]
    lengths = np.frombuffer(norms["postings"], np.int64)
    impact = S._impact(norms["docs"], norms["tokens"])
    lists = {r["term"]: S._List(tuple(r[c] for c in ("n", "last", "pairs", "sizes", "postings")), lengths, impact) for r in rows[1:]}
    df = {t: r["n"] for t, r in zip(lists, rows[1:], strict=True)}
    out = []
    for item, text in items:
        heap = S._Heap(20)
        own = [(t, c * math.floor(1000 * math.log((2 * norms["docs"] + 2) / (2 * df[t] + 1)))) for t, c in Counter(terms(text)).items() if t in df]
        S._rank(own, lists, np.frombuffer(norms["last"], np.int64), np.frombuffer(norms["pairs"], bool), heap)
        out += [(item, r, int(d), int(s)) for r, (d, s) in enumerate(zip(heap.ids, heap.scores, strict=True), 1)]
    return sorted(out, key=str), sum(len(x.known) for x in lists.values()), sum(len(x.last) for x in lists.values())


@pytest.mark.parametrize(("block", "window"), [(1, 1), (2, 5), (7, 64), (128, 256)])
def test_blocks_and_windows_change_nothing(monkeypatch, block, window):
    rng = random.Random(block)
    docs = corpus(rng, 800, 120)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(120)], k=6))) for i in range(15)]
    assert kernel(docs, items, block, window, monkeypatch)[0] == brute(docs, items)


def test_block_maxima_spare_decompression(monkeypatch):
    """A rare term decides the first 20; of the common term only blocks that hold these documents are read."""
    docs = [(i, "common " * (1 + i % 3) + ("rare " * 5 if i % 500 == 0 or i < 30 else "")) for i in range(20_000)]
    got, read, held = kernel(docs, [(1, "rare common")], 16, 64, monkeypatch)
    assert got == brute(docs, [(1, "rare common")])
    assert read < held / 4


def test_postings_of_every_width(monkeypatch):
    docs = [(i, "z " * f) for i, f in ((0, 1), (1, 300), (2, 70_000))] + [(i, "y") for i in range(3, 400)] + [(400, "z y")]
    assert kernel(docs, [(1, "z"), (2, "y z")], 2, 10, monkeypatch)[0] == brute(docs, [(1, "z"), (2, "y z")])


def test_pieces_split_no_term(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 8)
    texts = ["ab cd ef", "", "a" * 50, "x y", "äöü" * 9, " ", "end"]
    data, offsets = S.utf8(pa.array(texts))
    _, starts, ends, rows = S.terms_of(data, offsets)
    raw = data.tobytes()
    assert [(int(r), raw[a:b].decode()) for r, a, b in zip(rows, starts, ends, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(t)]


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(S.OP11_SQL).fetchall()
    assert sorted(map(tuple, S.op11_search(spark, sf).collect())) == sorted(want)
    assert len(want) > 100
