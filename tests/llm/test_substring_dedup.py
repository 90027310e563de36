import random
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import substring_dedup as D
from plumbline.llm.common import texts_of, utf8


def prose(seed, n):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "né"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_cuts_are_local():
    a, b = prose(1, 400), prose(2, 30)
    data, offsets = utf8(pa.array([a, b + a, "", "x"], pa.string()))
    rows, starts, ends = D.cuts(data, offsets)
    for k, t in enumerate([a, b + a, "", "x"]):
        own = rows == k
        raw = t.encode()
        assert b"".join(raw[s - offsets[k] : e - offsets[k]] for s, e in zip(starts[own], ends[own], strict=True)) == raw
    whole = [set(data[s:e].tobytes() for s, e in zip(starts[rows == k], ends[rows == k], strict=True)) for k in (0, 1)]
    assert len(whole[0] & whole[1]) >= len(whole[0]) - 6
    digests = D._digests(data, starts, ends)
    assert len({(d, data[s:e].tobytes()) for d, s, e in zip(digests.tolist(), starts, ends, strict=True)}) == len(set(digests.tolist()))


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    shared = [prose(1000 * seed + k, 60) for k in range(4)]
    rows, holders = [], {}
    for i in range(40):
        text = prose(seed * 77 + i + 5000, rng.randint(0, 200))
        if i % 4 == 0:
            k = (i // 4) % 4
            text = prose(i + 99, rng.randint(1, 40)) + " " + shared[k] + " " + text
            holders.setdefault(k, []).append(i)
        rows.append((i, text, 1))
    rows += [(100, None, 1), (101, "", 1), (None, rows[0][1], 1), (102, "z" * 20_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ord int").repartition(3)
    out = D.repeated_passages(df).collect()
    assert {r.doc_id for r in out} == {i for h in holders.values() for i in h}
    assert {r.doc_id for r in out if r.kept} == {min(h) for h in holders.values()}
    texts = {i: t for i, t, _ in rows}
    for r in out:
        k = next(k for k, h in holders.items() if r.doc_id in h)
        piece = texts[r.doc_id].encode()[r.start : r.stop]
        assert piece in texts[r.first_doc_id].encode() or r.kept
        assert len(set(piece.split()) & set(shared[k].encode().split())) >= 0.8 * len(set(piece.split()))
    cut = {r.doc_id: r.text for r in D.without_repeats(df).collect()}
    assert len(cut) == len(rows) and cut[100] is None and cut[min(holders[0])] == texts[min(holders[0])]
    assert all(len(cut[i]) < len(texts[i]) - 150 for h in holders.values() for i in h if i != min(h))


def test_one_word_over_and_over(spark):
    rows = [(1, "Thhe " * 90), (2, prose(8, 31) + " " + "Thhe " * 80), (3, prose(9, 90))]
    out = D.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out} == {1, 2}


def test_passage_with_two_owners(spark):
    for seed in range(4):
        a, b = prose(seed + 300, 29)[:150], prose(seed + 400, 29)[:150]
        texts = {5: prose(1, 60) + " " + a + " " + prose(2, 60), 10: prose(3, 60) + " " + a + b + " " + prose(4, 60), 20: prose(5, 50) + " " + a + b + " " + prose(6, 60)}
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        out = D.repeated_passages(df).collect()
        assert {(r.doc_id, r.kept) for r in out} == {(10, True), (10, False), (20, False)}
        size = {i: sum(r.stop - r.start for r in out if r.doc_id == i) for i in (10, 20)}
        assert min(size.values()) >= D.PASSAGE
        left = {r.doc_id: r.text for r in D.without_repeats(df).collect()}
        assert left[5] == texts[5] and b[50:100] in left[10] and b[50:100] not in left[20] and a[50:100] not in left[10] + left[20]


def plain_passages(texts):
    """The definition over plain lists: repeated chunks, pairs that two documents hold, runs that are long enough, their pieces."""
    chunks = {}
    for i, t in texts.items():
        data, offsets = D.utf8(pa.array([t]))
        _, starts, ends = D.cuts(data, offsets)
        chunks[i] = [(k, int(a), int(b), int(d)) for k, (a, b, d) in enumerate(zip(starts, ends, D._digests(data, starts, ends), strict=True))]
    holders, pairs = defaultdict(set), defaultdict(set)
    for i, c in chunks.items():
        for *_, d in c:
            holders[d].add(i)
    near = {i: [x for x in c if len(holders[x[3]]) > 1] for i, c in chunks.items()}
    for i, c in near.items():
        for x, y in pairwise(c):
            if y[0] == x[0] + 1:
                pairs[x[3], y[3]].add(i)
    out = set()
    for i, c in near.items():
        runs = []
        for n, y in enumerate(c):
            joined = n and y[0] == c[n - 1][0] + 1 and len(pairs[c[n - 1][3], y[3]]) > 1
            if joined:
                runs[-1].append(y)
            else:
                runs.append([y])
        for run in runs:
            start, stop = run[0][1], run[-1][2]
            if stop - start < D.PASSAGE:
                continue
            pieces = []
            for x in run:
                kept = min(holders[x[3]]) == i
                if pieces and pieces[-1][0] == kept:
                    pieces[-1][1].append(x)
                else:
                    pieces.append((kept, [x]))
            for kept, part in pieces:
                a, b = part[0][1], part[-1][2]
                if not (kept and len(part) == 1 and (a == start) != (b == stop)):
                    out.add((i, a, b, min(min(holders[x[3]]) for x in part), kept))
    return out


def test_by_brute_force(spark):
    rng = random.Random(12)
    pool = [prose(4000 + k, 25) for k in range(12)]
    texts = {i: " ".join(rng.choice(pool) if rng.random() < 0.4 else prose(9000 + 50 * i + k, 12) for k in range(rng.randint(1, 8))) for i in range(60)}
    texts |= {i: pool[0] + " " + pool[1] + " " + pool[2] for i in range(60, 90)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.start, r.stop, r.first_doc_id, r.kept) for r in D.repeated_passages(df).collect()}
    assert got == plain_passages(texts) and len(got) > 40


def test_repeated_rows_and_clashing_columns(spark):
    shared = prose(77, 60)
    rows = [(1, "a b " + shared, 0, "x"), (1, "a b " + shared, 0, "x"), (2, shared + " c", 0, "y"), (None, shared, 0, "z"), (3, shared + shared[:20], 5, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans int, digest string")
    out = D.repeated_passages(df)
    assert {r.doc_id for r in out.collect()} == {1, 2, 3} and out.count() == len({tuple(r) for r in out.collect()})
    left = D.without_repeats(df)
    assert left.columns == df.columns and left.count() == len(rows)
    assert sorted(len(r.text) for r in left.where("doc_id = 1 or doc_id is null").collect()) == sorted(len(rows[k][1]) for k in (0, 1, 3))
    assert D.without_repeats(df.limit(0)).count() == 0


def test_empty(spark):
    assert D.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_stand_between_characters(spark):
    """Text of several-byte letters: every chunk decodes, spans begin and end at characters, and no byte is lost where repeats go."""
    rng = random.Random(12)
    letters = "äöüßéñ漢字かな😀𝄞абв"
    some = lambda n: "".join(rng.choice(letters) + (" " if rng.random() < 0.2 else "") for _ in range(n))
    passage = some(400)
    rows = [(1, some(90) + passage + some(80)), (2, some(50) + passage + some(120)), (3, some(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in D.chunks(texts_of(df)).collect():
        texts[r.doc_id].encode()[r.start : r.stop].decode()
    spans = [r for r in D.repeated_passages(df).collect()]
    assert {r.doc_id for r in spans} == {1, 2}
    gone = {d: [] for d in texts}
    for r in spans:
        texts[r.doc_id].encode()[r.start : r.stop].decode()
        if not r.kept:
            gone[r.doc_id].append((r.start, r.stop))
    for r in D.without_repeats(df).collect():
        raw = texts[r.doc_id].encode()
        assert len(r.text.encode()) == len(raw) - sum(b - a for a, b in gone[r.doc_id])
