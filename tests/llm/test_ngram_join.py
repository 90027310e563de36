import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import ngram_join as J


def brute(rows):
    """doc_id -> (size, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 80 * len(sets[x] | sets[y]):
                    a, b = sorted((root(x), root(y)))
                    comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, families=12, copies=14, words=60):
    rng = random.Random(seed)
    vocab = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(3000)]
    shared = [rng.choices(vocab, k=12) for _ in range(3)]
    rows = []
    for _ in range(families):
        base = rng.choices(vocab, k=rng.randint(words // 3, words * 3))
        if rng.random() < 0.5:
            base = base + rng.choice(shared)
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.3:
                t = t[: len(t) - rng.randint(0, 6)]
            rows.append(rng.choice([" ", "\n", " \t"]).join(t))
    rows += [rows[0], rows[0].upper(), "", None, "  \n", "one two", "One Two", "one", "x"]
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize(("seed", "group", "block", "hot"), [(1, 128, 256, 64), (2, 3, 4, 64), (3, 8, 2, 64), (4, 128, 256, 3), (5, 3, 4, 5)])
def test_against_all_pairs(spark, monkeypatch, seed, group, block, hot):
    if hot < 64:
        monkeypatch.setattr(J, "HOT_SAMPLED", 1)
    monkeypatch.setattr(J, "HOT_LEAST", hot)
    monkeypatch.setattr(J, "GROUP", group)
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, digest string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()}
    assert found == brute(rows)


def test_edges(spark):
    kind = "doc_id long, text string"
    assert J.jaccard_components(spark.createDataFrame([], kind)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "zz"), (9, None)], kind)
    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect() if r.component_id is not None)
    assert out == [(-1, 2, 3), (3, 2, 3), (3, 2, 3), (9, 0, 9)]


def test_one_of_each(spark):
    """One row of each group: repeated rows, one id with two texts, null ids, wordless rows, columns with names of the operator's own."""
    kind = "doc_id long, text string, key int, digest string, component_id map<string, int>"
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    near = words + " end"
    rows = [
        (3, words), (3, words), (4, words), (5, near), (3, "quite another text of this id here"), (6, "some more words for a set of its own"),
        (None, words), (None, "nobody has an id for this text here"), (None, "nobody has an id for this text here"), (None, None), (None, " "), (8, None), (8, None), (9, ""), (10, "long " * 40_000), (11, "long " * 40_001),
    ]
    df = spark.createDataFrame([(*r, k, "d", {"a": k}) for k, r in enumerate(rows)], kind).repartition(4)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "")[:12]) for r in kept.collect()))
    want = [(3, words), (3, "quite another text of this id here"), (6, "some more words for a set of its own"), (8, None), (9, ""), (10, "long " * 40_000)]
    want += [(None, "nobody has an id for this text here"), (None, None), (None, " ")]
    assert got == sorted((i is None, i or 0, (t or "")[:12]) for i, t in want)
    assert J.one_of_each(df.limit(0)).count() == 0


def test_streamed_groups():
    rng = random.Random(5)
    rows = []
    for token in range(40):
        for doc in range(rng.choice([1, 2, 5, 9, 300])):
            rows.append((token, doc, 100 + doc // 50))
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    for size in (7, 64, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size], strict=True)], names=["token", "doc", "n"]) for k in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in J._pairs(iter(batches), 80) for x in b.to_pylist()]
        if size == 7:
            first = sorted(got)
        assert sorted(got) == first


def test_trie_links():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.choice(400, 60, replace=False).astype(np.uint64)
        sets = []
        for _ in range(12):
            s = base.copy()
            s[rng.choice(60, rng.integers(0, 14), replace=False)] = rng.integers(1000, 9999, 1)[0]
            sets.append(np.unique(s))
        links = J.links_of(sets, None)
        want = {(i, j) for i in range(12) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))}
        assert all((max(p), min(p)) in want for p in links)

        def parts(edges):
            comp = list(range(12))
            for _ in range(12):
                for a, b in edges:
                    comp[a] = comp[b] = min(comp[a], comp[b])
            return comp

        assert parts(links) == parts(want)


def test_common_phrases_of_a_large_corpus_come_last():
    """With hundreds of shingles to a cell, those of a few hundredths of the sets stand out of their cells, others do not."""
    rng = np.random.default_rng(7)
    cells = rng.poisson(330, 1 << 16)
    common = rng.choice(1 << 16, 500, replace=False)
    cells[common] += 200
    classes = J.frequency_classes(cells)
    assert (classes[common] > 0).mean() > 0.99
    assert (np.delete(classes, common) > 0).mean() < 0.001
    assert J.frequency_classes(cells + 10_000 * (np.arange(1 << 16) == common[0]))[common[0]] > classes[common].max()


def test_common_phrases_chain_no_candidates(monkeypatch):
    """Texts that share a line with a hundred others, and nothing more, are in no group that is chained."""
    monkeypatch.setattr(J, "SKETCH_BITS", 11)
    monkeypatch.setattr(J, "GROUP", 16)
    rng = np.random.default_rng(3)
    shingles = lambda k: rng.integers(0, 1 << 64, k, np.uint64)
    lines = [shingles(8) for _ in range(30)]
    sets = [np.unique(np.concatenate([shingles(100), lines[i % 30]])) for i in range(3000)]
    cells = np.zeros(1 << 11, np.int64)
    for s in sets:
        np.add.at(cells, (s >> np.uint64(53)).astype(np.int64), 1)
    classes = J.frequency_classes(cells)
    rows = sorted((int(t), len(s), i) for i, s in enumerate(sets) for t in J._ranked(s, classes)[: J._prefix(len(s), 80)].view(np.int64))
    token, n, doc = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
    chained = [x for b in J._pairs(iter([pa.RecordBatch.from_arrays([token, doc, n], names=["token", "doc", "n"])]), 80) for x in b.to_pylist() if x["need"] == 0]
    assert not chained


def test_pairs_of_blocks_in_rounds(spark, monkeypatch):
    """One cluster of many blocks: each round deals out a bounded number of copies, and all rounds together find what is linked."""
    monkeypatch.setattr(J, "BLOCK", 4)
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = [i for i, t in rows if (t or "").split()]
    pairs = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    dealt = []
    monkeypatch.setattr(J, "cut", lambda t, label="cut", f=J.cut: (dealt.append(label), f(t, label))[1])
    links = J.components(J.verified(J.texts_of(df), pairs))
    found = {r.node: r.root for r in links.collect()}
    copies = len(ids) * -(-len(ids) // 4)
    assert dealt.count("links") == -(-copies // len(rows)) > 5
    assert {i: found.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute(rows).items()}
