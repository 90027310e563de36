import random

import duckdb
import numpy as np
import pytest

from plumbline.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, anchor_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(3)


def brute(rows, every):
    kept = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    chosen = {}
    for r in kept:
        if r[0] % every == 0:
            chosen[r[0]] = min(chosen.get(r[0], r), r, key=lambda x: x[1:])
    out = []
    for i, lab, v in chosen.values():
        others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in kept if j != i and len(w) == len(v)]
        others = [(max(-(2**63 - 1), min(2**63, s)), j, m) for s, j, m in others]
        for s, p, _ in sorted(x for x in others if x[2] == lab)[:5]:
            fit = sorted(x for x in others if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, p, r, j, -s, -t) for r, (t, j, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every):
    from pyspark.sql import functions as F

    own = N.usable(frame(spark, rows))
    return sorted(map(tuple, N.mine(own, own.where(F.col("vec_id") % every == 0)).collect()))


@pytest.mark.parametrize(("seed", "width", "every"), [(1, 3, 3), (2, 8, 10), (3, 16, 1)])
def test_same_as_brute_force(spark, seed, width, every):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    rows = [(i, [float(x) for x in centres[i % 4] + 0.7 * rng.normal(size=width)], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(1000 + i, [0.5] * width, i % 3) for i in range(60)]  # ties
    got = mined(spark, rows, every)
    assert got == brute(rows, every)
    assert len(got) > 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2), (5, None, 2), (6, [], 2), (7, [1.0, 1.0], None)]
    rows += [(None, [0.5, 0.5], 2), (8, [0.5], 2), (9, [0.4, None], 2), (10, [0.0, 0.0], 2), (0, [1.0, 0.0], 1), (11, [-1.0, 0.0], 3), (12, [0.0, 0.0], 3), (20, [0.0, 0.0], 3), (2, [0.5, 0.5], 2)]
    got = mined(spark, rows, 10)
    assert got == brute(rows, 10)
    assert [r[3] for r in got if r[:2] == (0, 1)] == [2, 2]


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(5)], i % 2) for i in range(60)]
    rows += [(100, [1e20, 1.0, 0.0, 0.0, 0.0], 0), (101, [1e20, 2.0, 0.0, 0.0, 0.0], 0)]
    keep = [r for r in rows if r[0] < 100]
    assert mined(spark, keep, 5) == brute(keep, 5)
    assert mined(spark, rows, 5) is not None


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(N, "ANCHORS", 7)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(120)]
    assert mined(spark, rows, 4) == brute(rows, 4)


def test_empty_and_alone(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(0, [1.0], 1)], 1) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)], 10) == []


def test_lists_are_shared_and_end_early():
    """The bound holds for every member, and on clustered rows members stop long before the end."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    vectors = np.floor(256 * (centres[np.arange(6000) % 6] + 0.05 * rng.normal(size=(6000, 16)))).astype(np.int64)
    rows = {"vec_id": np.arange(60), "label": np.zeros(60, int)}
    import pyarrow as pa

    block = pa.table({"vec_id": rows["vec_id"], "label": rows["label"], "vector": pa.array([list(map(int, v)) for v in vectors[:60]], pa.list_(pa.int64()))})
    (anchors,) = N._grouped(block, None)
    for members, order, bound in N._lists(anchors, vectors):
        length = np.sqrt((anchors.vectors[members].astype(float) ** 2).sum(1))
        assert (N._exact(anchors.vectors[members], vectors[order]) <= length[:, None] * bound * (1 + 1e-9) + 1e-3).all()
    best = [[N._Best(5, -N._LONG - 1)] for _ in anchors.ids]
    seen = []
    meet = N._positives(anchors, best)
    N._walk(anchors, best, np.arange(6000), np.zeros(6000, int), vectors, lambda m, s, i, lab: (seen.append(len(i)), meet(m, s, i, lab)))
    assert sum(seen) < 60 * 6000 / 2
    for m, own in enumerate(best):
        scores = vectors @ anchors.vectors[m]
        scores[anchors.ids[m]] = -(1 << 60)
        assert own[0].scores.tolist() == sorted(scores.tolist(), reverse=True)[:5]


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(N.OP12_SQL).fetchall()
    assert sorted(map(tuple, N.op12_hard_negatives(spark, sf).collect())) == sorted(want)
    assert len(want) > 100
