"""Fits of many configurations and arms against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import arms as A
from plumbline.operators import fits as M
from plumbline.operators import gates as G
from plumbline.operators import grid as R
from plumbline.operators import metrics as K
from plumbline.operators import normal as N
from plumbline.operators import splits as S
from plumbline.plans import models

from .test_operators import plain_ridge

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("block", "held"), [(2, 1), (3, 200), (128, 1 << 20)])
def test_summed_products_in_blocks(spark, block, held):
    """Any block width and any memory give the same matrices, for keys of other widths and null keys too."""
    rng = np.random.default_rng(block)
    rows = [(c, n, [float(x) for x in rng.integers(-5, 5, w)]) for c, w in (("a", 1), ("b", 7), (None, 4)) for n in (0, 1) for _ in range(30)]
    df = spark.createDataFrame(rows, "c string, n int, v array<double>").repartition(5)
    sums = N.summed_products(df, ["c", "n"], "v", block, held)
    got = {(r.c, r.n): np.frombuffer(r.m) for r in N.each_matrix(sums, ["c", "n"], lambda m: [[m.tobytes()]], "m binary", block).collect()}
    assert len(got) == 6
    for (c, n), m in got.items():
        x = np.array([v for k, j, v in rows if (k, j) == (c, n)])
        assert np.array_equal(m.reshape(x.shape[1], -1), x.T @ x)
    one = N.each_matrix(N.summed_products(df.where("c = 'b'"), [], "v", block, held), [], lambda m: [[float(m.sum())]], "s double", block).collect()
    assert one[0].s == sum(np.sum(np.outer(v, v)) for k, _, v in rows if k == "b")
    assert N.summed_products(df.limit(0), ["c"], "v", block, held).count() == 0


def test_a_task_holds_few_blocks():
    """However many configurations there are, what is held before it is passed on stays within the bound."""
    passed = []
    rng = np.random.default_rng(0)

    class Rows:  # stands in for a table: only the function that a task runs is of interest
        dtypes = [("c", "int"), ("v", "array<double>")]

        def select(self, *_):
            return self

        def mapInPandas(self, fn, _):  # noqa: N802
            frame = pd.DataFrame({"c": np.repeat(np.arange(324), 2), "v": list(rng.normal(size=(648, 300)))})
            for out in fn(iter([frame])):
                passed.append(sum(len(b) for b in out["_sums"]))
            raise StopIteration

    with pytest.raises(StopIteration):
        N.summed_products(Rows(), ["c"], "v", held=4 << 20)
    whole = 324 * sum((min(300, i + 128) - i) * (min(300, j + 128) - j) * 8 for i in range(0, 300, 128) for j in range(i, 300, 128))
    assert sum(passed) == whole and max(passed) <= (4 << 20) + 128 * 128 * 8


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_grid_of_many_configurations(spark, monkeypatch, limit):
    """324 configurations at once, weights broadcast or salted, against the plain fit; held rows serve all n and seeds."""
    monkeypatch.setattr(M, "WEIGHTS", limit)
    rng = np.random.default_rng(3)
    train, held, want = [], [], {}
    for a in range(27):
        w = rng.normal(size=5)
        make = lambda n, w=w: (x := rng.normal(2, 3, (n, 5)), x @ w + rng.normal(0, 3, n))
        part = {role: make(n) for role, n in (("val", 12), ("test", 15))}
        held += [(a, role, x.tolist(), float(y)) for role, (xs, ys) in part.items() for x, y in zip(xs, ys, strict=True)]
        for n in (8, 16, 32):
            for seed in range(4):
                own = make(n)
                train += [(a, n, seed, "train", x.tolist(), float(y)) for x, y in zip(*own, strict=True)]
                want[a, n, seed] = plain_ridge(own, part["val"], part["test"], M.PENALTIES)
    rows = spark.createDataFrame(train, "assay int, n int, seed int, role string, vec array<double>, y double").repartition(4)
    fixed = spark.createDataFrame(held, "assay int, role string, vec array<double>, y double").repartition(3)
    got = {(r.assay, r.n, r.seed): (r.penalty, r.val_mse, r.spearman, r.n_train, r.n_test) for r in M.ridge_grid(rows, ["assay", "n", "seed"], held=fixed).collect()}
    assert len(got) == 324 and got.keys() == want.keys()
    for c in want:
        assert got[c] == pytest.approx(want[c], rel=1e-6), c


def test_registered_evaluation_is_the_plain_one(spark):
    """m9_evaluate, each configuration fitted again with NumPy on the rows that the draws name."""
    got = {(r.checkpoint, r.readout, r.scheme, r.n, r.seed): r for r in models.m9_evaluate(spark, SF).collect()}
    assert len(got) == 2 * 2 * 2 * 2 * 2
    e = {r.vec_id: (np.array(r.embedding, np.float32).astype(float), float(r.label)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    folds = {"fold_modulo": lambda i: i % 5, "fold_contiguous": lambda i: i // 7 % 5}
    base = spark.createDataFrame([("a", i, folds["fold_modulo"](i), folds["fold_contiguous"](i)) for i in e], "assay string, vec_id long, fold_modulo int, fold_contiguous int")
    for checkpoint, width in (("small", 8), ("large", 24)):
        for readout in ("mean", "at_position"):
            tagged = base.select(F.lit("a").alias("assay"), F.lit(checkpoint).alias("checkpoint"), F.lit(readout).alias("readout"), "vec_id", "fold_modulo", "fold_contiguous")
            drawn = S.draws(S.fold_roles(tagged, list(folds)).where("role = 'pool'"), ["assay", "checkpoint", "readout", "scheme"], "vec_id", [16, 48], [0, 1]).collect()
            feature = lambda i, w=width, r=readout: e[i][0][:w] if r == "mean" else (e[i][0][:w].astype(np.float32) ** 2).astype(float)
            of = lambda ids: (np.array([feature(i) for i in ids]), np.array([e[i][1] for i in ids]))
            for scheme, fold in folds.items():
                val, test = ([i for i in e if fold(i) == k] for k in (1, 0))
                for n in (16, 48):
                    for seed in (0, 1):
                        train = [r.vec_id for r in drawn if (r.scheme, r.n, r.seed) == (scheme, n, seed)]
                        want = plain_ridge(of(train), of(val), of(test), M.PENALTIES)
                        r = got[checkpoint, readout, scheme, n, seed]
                        assert (r.penalty, r.val_mse, r.spearman, r.n_train, r.n_test) == pytest.approx(want, rel=1e-4)


def test_axes_named_like_results(spark):
    rows = spark.createDataFrame([(n, ("train", "val", "test")[i % 3], [float(i), float(i * i % 7)], float(i)) for n in (1, 2) for i in range(30)], "n int, role string, vec array<double>, y double")
    out = M.ridge_grid(rows, ["n"]).collect()
    assert sorted((r.n, r.n_train, r.n_test) for r in out) == [(1, 10, 10), (2, 10, 10)]


def arm_case(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label long")
    table = lambda x: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<float>")
    label = np.array([r[1] for r in rows])
    blocks = {"seq": np.eye(4)[label] + rng.normal(0, 0.6, (300, 4)), "text": (label[:, None] % 2) + rng.normal(0, 0.5, (300, 3))}
    drawn = {s: rng.normal(0, 1, (300, 2)) for s in (0, 1, 2)}
    frames = {k: table(v) for k, v in blocks.items()} | {"drawn": lambda seed: table(drawn[seed])}
    arms = [{"name": "seq", "blocks": ["seq"]}, {"name": "both", "blocks": ["text", "seq"]}, {"name": "other", "blocks": ["seq", "text"], "shuffle": ["text"]}, {"name": "drawn", "blocks": ["seq", "drawn"], "redrawn": ["drawn"]}, {"name": "fixed", "blocks": ["seq", "drawn"]}]
    split = lambda seed: df.select("id", "label", S.hash_split(F.col("id"), (0.6, 0.2, 0.2), seed).alias("role"))
    return df, label, arms, frames, split


def test_centroid_arms_are_the_arms_one_by_one(spark):
    _, _, arms, frames, split = arm_case(spark)
    names = ("accuracy", "precision", "recall", "f1", "balanced_accuracy")
    values = lambda df: {(r.arm, r.seed): (r.n, *[round(r[c], 9) for c in names]) for r in df.collect()}
    assert values(A.centroid_arms(arms, frames, split, "id", "label", [0, 2])) == values(M.run_arms(arms, frames, split, "id", "label", [0, 2]))


def test_ridge_arms_against_numpy(spark):
    df, label, arms, frames, split = arm_case(spark)
    got = {(r.arm, r.seed): (r.penalty, r.n, r.accuracy, r.f1) for r in A.ridge_arms(arms, frames, split, "id", "label", [0, 1]).collect()}
    assert len(got) == 10
    for arm in arms:
        for seed in (0, 1):
            x = {r.id: r.vec for r in M.arm_features(arm, frames, "id", seed).collect()}
            role = {r.id: r.role for r in split(seed).collect()}
            ids = {k: [i for i in x if role[i] == k] for k in ("train", "val", "test")}
            of = lambda k: (np.array([x[i] for i in ids[k]], float), label[ids[k]])
            xs, ys = of("train")
            mean, sd, hot = xs.mean(0), xs.std(0) + 1e-8, np.eye(4)[ys]
            best = None
            for p in M.PENALTIES:
                z = (xs - mean) / sd
                w = np.linalg.solve(z.T @ z + p * np.eye(z.shape[1]), z.T @ (hot - hot.mean(0)))
                say = lambda k, w=w: (((of(k)[0] - mean) / sd) @ w + hot.mean(0)).argmax(1)
                loss = (say("val") != of("val")[1]).mean()
                if best is None or loss < best[1]:
                    best = p, loss, say("test")
            truth = of("test")[1]
            f1 = K.classification(spark.createDataFrame([(int(a), int(b)) for a, b in zip(truth, best[2], strict=True)], "t long, p long"), "t", "p").first()
            assert got[arm["name"], seed] == pytest.approx((best[0], len(truth), f1.accuracy, f1.f1))


def test_arms_fail_loudly(spark):
    df, _, arms, frames, split = arm_case(spark)
    short = frames | {"text": frames["text"].where("id > 3")}
    with pytest.raises(PySparkException, match="lacks a block"):
        A.centroid_arms(arms, short, split, "id", "label", [0]).collect()
    with pytest.raises(G.GateError, match="no block"):
        A.centroid_arms([{"name": "a", "blocks": ["x"]}], frames, split, "id", "label", [0])


def test_classes_in_several_rows(spark, monkeypatch):
    """Class means that one broadcast row may not hold come in several, with the same result."""
    rng = np.random.default_rng(9)
    rows = [(i, i % 23, "test" if i % 4 == 0 else "train", [float(x) for x in rng.normal(i % 23, 6, 5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, role string, vec array<double>")
    one = sorted(map(tuple, M.nearest_centroid(df, "id", "label", "vec").collect()))
    monkeypatch.setattr(M, "MEANS", 12)
    assert sorted(map(tuple, M.nearest_centroid(df, "id", "label", "vec").collect())) == one


def test_ranks_by_windows_and_by_order(spark, monkeypatch):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 500), "x": rng.integers(0, 40, 500), "y": rng.normal(size=500).round(1)})
    df = spark.createDataFrame(frame).repartition(4)
    want = {g: p["x"].rank().corr(p["y"].rank()) for g, p in frame.groupby("g")}
    for most in (1 << 20, 1):
        monkeypatch.setattr(K, "WINDOWED", most)
        got = K.spearman_by(df, ["g"], "x", "y", "held").collect()
        assert {r.g: r.spearman for r in got} == pytest.approx(want)
        assert sum(r.held for r in got) == 500


def test_grid_order(spark):
    out = R.grid(spark, {"a": ["x", "y"], "n": [1, 2, 3]}).orderBy("ordinal").collect()
    assert [(r.a, r.n, r.ordinal) for r in out] == [(a, n, k) for k, (a, n) in enumerate((a, n) for a in "xy" for n in (1, 2, 3))]
