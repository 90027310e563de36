"""Similarity links against brute force, and splits that keep linked records together."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators.similarity import _meetings, candidates, run_sets, similar_links, similarity_split


def brute(rows, size, threshold, words):
    sets = {}
    for k, t in rows:
        p = (t or "").split() if words else [c for c in t or "" if c]
        if p:
            sets[k] = {tuple(p[i : i + size]) for i in range(max(1, len(p) - size + 1))}
    out = {}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if s >= threshold:
                out[a, b] = s
    return out


def roots(keys, links):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def families(rng, n, letters="ACDEFGHIKLMNPQRSTVWY"):
    """Sequences in families: copies with a few letters changed, inserted or lost."""
    rows = []
    for _ in range(n):
        base = "".join(rng.choices(letters, k=rng.randint(60, 300)))
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(other))
                other[at : at + rng.choice([0, 1, 1])] = rng.choice(letters) * rng.choice([0, 1, 1])
            rows.append("".join(other))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words", [False, True])
def test_recall_and_precision(spark, words):
    rng = random.Random(11)
    rows = families(rng, 60)
    if words:
        rows = [(k, " ".join(t)) for k, t in rows]
    rows += [(1000, None), (1001, ""), (1002, "  "), (1003, "AC"), (1004, "AC"), (1005, "AD")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, seq string, a int, set string").repartition(3)
    want = brute(rows, 5, 0.6, words)
    got = {(r.a, r.b): r.similarity for r in similar_links(df, "id", "seq", 5, 0.6, words).collect()}
    assert len(want) > 200
    assert all(want[p] == pytest.approx(s) for p, s in got.items())  # no link that is none
    first = {}
    for k, t in rows:  # copies are linked with the least of them, other links are those of the least
        first[t] = min(first.get(t, k), k)
    least = set(first.values())
    direct = {p for p in want if want[p] < 1 and least >= set(p)}
    assert sum(p in got for p in direct) >= 0.9 * len(direct)
    keys = [k for k, _ in rows]
    assert roots(keys, got) == roots(keys, want)


def test_one_large_bucket_has_few_candidates(spark):
    """3,000 near copies: the candidates grow with the records, not with their pairs, and all are one cluster."""
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, seq string").repartition(8)
    pairs = candidates(run_sets(df, "id", "seq", 5, True).select("key", "set")).count()
    assert pairs < 3000 * (12 + 13 * 32)
    split = similarity_split(df, "id", "seq", (0.5, 0.25, 0.25), 3, words=True)
    assert split.agg(F.count_distinct("cluster")).first()[0] == 1


def test_no_linked_records_in_two_roles(spark):
    rows = families(random.Random(5), 80)
    df = spark.createDataFrame(rows, "id long, seq string")
    role = {r.id: (r.cluster, r.role) for r in similarity_split(df, "id", "seq", (0.6, 0.2, 0.2), 7, threshold=0.6).collect()}
    assert len(role) == len(rows) and {r for _, r in role.values()} == {"train", "val", "test"}
    for a, b in brute(rows, 5, 0.6, False):
        assert role[a] == role[b]
    again = {r.id: (r.cluster, r.role) for r in similarity_split(df.repartition(9), "id", "seq", (0.6, 0.2, 0.2), 7, threshold=0.6).collect()}
    assert again == role


def test_empty(spark):
    none = spark.createDataFrame([], "id long, seq string")
    assert similar_links(none, "id", "seq").count() == 0
    assert similarity_split(none, "id", "seq", (0.6, 0.2, 0.2), 7).count() == 0
    lone = spark.createDataFrame([(1, None), (2, "")], "id long, seq string")
    assert sorted(r.cluster for r in similarity_split(lone, "id", "seq", (0.6, 0.2, 0.2), 7).collect()) == [1, 2]


def test_signatures_are_worked_out_in_batches(spark):
    """All hashes of a batch of sets are taken together, and a set has the same bands in whatever batch it is."""
    from plumbline.operators.similarity import _bands

    sets = spark.range(300).selectExpr("string(id) as key", "transform(sequence(1L, 1 + id % 7), i -> xxhash64(i)) as set")
    bands = _bands(sets.repartition(3), 4, 2)
    assert "MapInArrow" in bands._jdf.queryExecution().executedPlan().toString()
    told = bands.selectExpr("band", "h", "int(key) % 7 as size").distinct().groupBy("size").count().collect()
    assert bands.count() == 1200 and {r["count"] for r in told} == {4}


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_what_the_buckets_leave_apart_is_linked(spark, threshold):
    """With signatures that hardly ever meet, what is connected is still exactly what all similar pairs connect."""
    rng = random.Random(23)
    rows = [(k, " ".join(t)) for k, t in families(rng, 50)]
    base = [f"w{i}" for i in range(40)]
    rows += [(2000 + k, " ".join(base[:36] + [f"x{k}", f"y{k}"])) for k in range(150)]  # a frequent line that makes up most of a text
    rows += [(3000, None), (3001, " "), (3002, "one two"), (3003, "one two"), (3004, "one"), (3005, "one two three four five"), (3006, "a b c d e f g h i"), (3007, "b c d e f g h i"), (3008, "b c d e f g h i j")]
    df = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    want, keys = brute(rows, 5, threshold, True), [k for k, _ in rows]
    got = {(r.a, r.b): r.similarity for r in similar_links(df, "id", "seq", 5, threshold, True, bands=1, rows=12).collect()}
    assert all(want[p] == pytest.approx(s) for p, s in got.items())
    assert roots(keys, got) == roots(keys, want)
    named = spark.createDataFrame([(f"k{k:05}", t) for k, t in rows], "id string, seq string")
    got = {(int(r.a[1:]), int(r.b[1:])) for r in similar_links(named, "id", "seq", 5, threshold, True, bands=1, rows=12).collect()}
    assert roots(keys, got) == roots(keys, want)


def test_rows_of_a_run_in_many_batches():
    """The pairs of a run are the same however its rows are cut into batches, and those of one cluster are none."""
    rng = random.Random(2)
    rows = sorted((token, rng.randint(40, 60), k, rng.choice([k, -1]), rng.randint(0, 5)) for token in range(-9, 9) for k in range(rng.choice([1, 2, 9, 120])))
    found = []
    for size in (5, 64, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size], strict=True)], names=["run", "n", "key", "cluster", "at"]) for k in range(0, len(rows), size)]
        found.append(sorted(tuple(x.values()) for b in _meetings(iter(batches), 0.8) for x in b.to_pylist()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 1000
    whole = [tuple(x.values()) for b in _meetings(iter([pa.RecordBatch.from_arrays([pa.array([r[k] if k != 3 else 0 for r in rows], pa.int64()) for k in range(5)], names=["run", "n", "key", "cluster", "at"])]), 0.8) for x in b.to_pylist()]
    assert whole == []
