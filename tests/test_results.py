"""Tests of ranks with exact chances, one-pass bootstrap, grouped quantiles, published shards and assay scans."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.keys import quantiles_by
from plumbline.operators import contrasts as C
from plumbline.operators import grid as R
from plumbline.operators import metrics as K
from plumbline.operators.gates import GateError
from plumbline.sources import readers, sinks


def brute_p(deltas):
    ranks = pd.Series(np.abs(deltas)).rank().to_numpy()
    w = ranks[np.array(deltas) > 0].sum()
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(deltas))]
    return min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))


def test_exact_chances_up_to_twelve(spark):
    rng = np.random.default_rng(2)
    groups = {n: [float(x) for x in rng.normal(0.4, 1, n)] for n in range(1, 13)}
    df = spark.createDataFrame([(n, d) for n, ds in groups.items() for d in [*ds, 0.0]], "g int, delta double")
    got = {r.g: r for r in C.signed_rank_test(df, ["g"]).collect()}
    for n, ds in groups.items():
        assert got[n].exact and got[n].n == n and got[n].p == pytest.approx(brute_p(ds))


def test_chances_up_to_25_and_beyond(spark):
    """Known values of the distribution, ties, and the normal tail far out."""
    ways = {0: 1}
    for k in range(1, 26):
        ways = {s: ways.get(s, 0) + ways.get(s - k, 0) for s in range(k * (k + 1) // 2 + 1)}
    rows = [("all", float(k)) for k in range(1, 26)] + [("one", float(-k if k == 7 else k)) for k in range(1, 26)] + [("long", float(k)) for k in range(1, 400)] + [("tied", x) for x in (1.0, 1.0, -2.0, 3.0)] + [("none", 0.0)]
    got = {r.g: r for r in C.signed_rank_test(spark.createDataFrame(rows, "g string, delta double"), ["g"]).collect()}
    assert got["all"].p == pytest.approx(2 / 2**25) and got["all"].exact
    assert got["one"].p == pytest.approx(2 * sum(w for s, w in ways.items() if s >= 325 - 7) / 2**25)
    assert not got["long"].exact and got["long"].p == pytest.approx(math.erfc(got["long"].z / math.sqrt(2)), rel=1e-9) and got["long"].p < 1e-60
    assert not got["tied"].exact and got["tied"].p == pytest.approx(math.erfc(abs(got["tied"].z) / math.sqrt(2)))
    assert "none" not in got


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.1, 0.7, 1.5, 2.9, 2.999, 3.0, 4.0, 6.5, 12.0, 25.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.erfc(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=1e-9, abs=1e-15) for r in got)


def test_bootstrap_in_one_row_or_in_a_join(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(c), float(x)) for c in range(40) for x in rng.normal(c % 3, 1, 1 + c % 5)], "c int, delta double")
    one = C.cluster_bootstrap(df, "c", 100, 3).first()
    monkeypatch.setattr(C, "CLUSTERS", 10)
    other = C.cluster_bootstrap(df, "c", 100, 3).first()
    assert tuple(one) == pytest.approx(tuple(other)) and one.low < one.mean < one.high


@pytest.mark.parametrize("windowed", [1 << 20, 5])
def test_grouped_quantiles(spark, windowed):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=101).round(1).tolist(), "b": [3.0], "c": [1.0, 2.0], None: rng.integers(0, 4, 50).astype(float).tolist(), "d": []}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles_by(df, ["g"], "v", {"low": 0.1, "median": 0.5, "top": 1.0}, windowed).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = [float(np.quantile(vs, q)) for q in (0.1, 0.5, 1.0)] if vs else [None] * 3
        assert [got[g].low, got[g].median, got[g].top] == (pytest.approx(want) if vs else want)
    whole = [v for vs in groups.values() for v in vs]
    assert quantiles_by(df, [], "v", {"q": 0.3}, windowed).first().q == pytest.approx(np.quantile(whole, 0.3))
    assert {r.g: r["median"] for r in K.median_score(df, "v", ["g"]).collect()}["c"] == 1.5


SCHEMA = "arm string, n int, score double"


def results(spark, scores):
    return spark.createDataFrame([(a, n, float(s)) for (a, n), s in scores.items()], SCHEMA)


def test_published_shards(spark, tmp_path):
    path, config = f"file://{tmp_path}/out", ["arm", "n"]
    expected = R.grid(spark, {"arm": ["x", "y"], "n": [1, 2]})
    read = lambda: [r.score for r in sinks.read_published(spark, path, expected, config).collect()]
    with pytest.raises(GateError, match="nothing is published"):
        read()
    assert sinks.publish_shards(results(spark, {("x", 1): 0, ("x", 2): 1}), path, config) == 1
    with pytest.raises(GateError, match="2 missing|2 only"):
        read()
    assert sinks.publish_shards(results(spark, {("y", 1): 2, ("y", 2): 3}), path, config) == 2
    assert read() == [0, 1, 2, 3]
    assert sinks.publish_shards(results(spark, {("x", 2): 9}), path, config) == 3
    assert read() == [0, 9, 2, 3] and sinks.torn_runs(spark, path) == []
    with pytest.raises(GateError, match="are of"):
        sinks.publish_shards(results(spark, {("x", 2): 9}).withColumn("more", F.lit(1)), path, config)


def test_a_killed_rerun_leaves_the_old_results(spark, tmp_path, monkeypatch):
    path, config = f"file://{tmp_path}/out", ["arm", "n"]
    expected = R.grid(spark, {"arm": ["x"], "n": [1, 2]})
    sinks.publish_shards(results(spark, {("x", 1): 0, ("x", 2): 1}), path, config)

    def killed(self, entry):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sinks.CommitLog, "put", killed)
        with pytest.raises(KeyboardInterrupt):
            sinks.publish_shards(results(spark, {("x", 1): 7, ("x", 2): 8}), path, config)
    assert [r.score for r in sinks.read_published(spark, path, expected, config).collect()] == [0, 1]
    assert len(sinks.torn_runs(spark, path)) == 1
    assert sinks.publish_shards(results(spark, {("x", 1): 7, ("x", 2): 8}), path, config) == 2
    assert [r.score for r in sinks.read_published(spark, path, expected, config).collect()] == [7, 8]


def test_two_publishers_lose_nothing(spark, tmp_path, monkeypatch):
    path, config = f"file://{tmp_path}/out", ["arm", "n"]
    put, raced = sinks.CommitLog.put, []

    def slow(self, entry):
        if not raced:
            raced.append(1)
            sinks.publish_shards(results(spark, {("y", 1): 5}), path, config)
        return put(self, entry)

    monkeypatch.setattr(sinks.CommitLog, "put", slow)
    assert sinks.publish_shards(results(spark, {("x", 1): 4}), path, config) == 2
    out = sinks.read_published(spark, path, R.grid(spark, {"arm": ["x", "y"], "n": [1]}), config)
    assert [r.score for r in out.collect()] == [4, 5]


def test_changed_shards_are_named(spark, tmp_path):
    path, config = f"file://{tmp_path}/out", ["arm", "n"]
    sinks.publish_shards(results(spark, {("x", 1): 0, ("x", 2): 1}), path, config)
    (run,) = [p for p in (tmp_path / "out" / "runs").iterdir()]
    shard = next(p for p in run.iterdir() if p.name.endswith("-2"))
    results(spark, {("x", 2): 99}).write.mode("overwrite").parquet(f"file://{shard}")
    with pytest.raises(GateError, match="not those that were committed"):
        sinks.read_published(spark, path, R.grid(spark, {"arm": ["x"], "n": [1, 2]}), config)


def test_many_assays_in_a_few_jobs(spark, tmp_path):
    """217 assays of two header layouts, with further columns and files that are not listed, in as many jobs as 80."""
    names = list(readers.VARIANT_COLUMNS)
    value = {"DMS_score": "0.5"} | {c: "3" for c in names if c.startswith("fold_")}

    def write(i, columns):
        lines = [",".join(columns), *[",".join(value.get(c, f"{c}{k}") for c in columns) for k in range(2)]]
        (tmp_path / f"{i}.csv").write_text("\n".join(lines))

    ids = [f"A {k}+ü" if k == 0 else f"A{k}" for k in range(217)]
    for k, i in enumerate(ids):
        write(i, names if k % 2 else [*reversed(names), "more"])
    write("other", names)
    jobs = []
    for n in (80, 217):
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        out = readers.read_assays(spark, f"file://{tmp_path}", ids[:n])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before))
        rows = out.collect()
        assert len(rows) == 2 * n and {r.dms_id for r in rows} == set(ids[:n])
        assert {r.DMS_score for r in rows} == {0.5} and {r.fold_random_5 for r in rows} == {3}
        assert out.columns == ["dms_id", *names] and {r.mutant for r in rows} == {"mutant0", "mutant1"}
    assert jobs[0] == jobs[1] <= 6
    with pytest.raises(GateError, match="missing"):
        readers.read_assays(spark, f"file://{tmp_path}", ["A1", "nowhere"])
    write("short", [c for c in names if c != "DMS_score"])
    with pytest.raises(GateError, match="short lacks"):
        readers.read_assays(spark, f"file://{tmp_path}", ["A1", "short"])
