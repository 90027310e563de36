import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions import shared
from plumbline.functions.keys import global_rank, quantiles, running_total
from plumbline.operators import contrasts as C
from plumbline.operators import features as E
from plumbline.operators import fits as M
from plumbline.operators import gates as G
from plumbline.operators import grid as R
from plumbline.operators import metrics as K
from plumbline.operators import prep as P
from plumbline.operators import scoring as Z
from plumbline.operators import splits as S
from plumbline.operators.clusters import cluster_split
from plumbline.sources import readers, sinks


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(i, f"f{i % 37}", i % 11) for i in range(1500)], "id long, family string, size long")


def test_rank_ignores_layout(spark, records):
    want = {r.id: k for k, r in enumerate(sorted(records.collect(), key=lambda r: (r.size, r.id)))}
    for df in (records, records.repartition(7), records.orderBy(F.rand(1))):
        assert {r.id: r["rank"] for r in global_rank(df, ["size", "id"]).collect()} == want
    assert global_rank(records.limit(0), ["size", "id"]).count() == 0


@pytest.mark.parametrize("fractions", [(0.6, 0.2, 0.2), (0.85, 0.15, 0.0), (1.0, 0.0, 0.0)])
def test_balanced_split(spark, records, fractions):
    split = S.balanced_split(records, "family", fractions, 3)
    assert split.count() == 1500 and split.groupBy("family").agg(F.count_distinct("role").alias("n")).where("n > 1").count() == 0
    sizes = {r.role: r.n for r in S.split_sizes(split).collect()}
    for role, f in zip(S.ROLES, fractions, strict=True):
        assert abs(sizes.get(role, 0) - 1500 * f) <= 2 * 41 and (f > 0 or role not in sizes)
    again = S.balanced_split(records.repartition(5), "family", fractions, 3)
    assert again.select("id", "role").exceptAll(split.select("id", "role")).count() == 0
    assert S.leak_audit(split, "family").count() == 0 and S.empty_roles(split, fractions) == []
    with pytest.raises(G.GateError):
        S.balanced_split(records, "family", (0.5, 0.2, 0.2), 3)


def test_balanced_split_keeps_rows_and_fails_loudly(spark):
    rows = [(i, None if i % 10 == 0 else f"f{i % 4}", "old") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, family string, role_ string")
    split = S.balanced_split(df, "family", (0.5, 0.3, 0.2), 3)
    assert split.count() == 50 and split.where("family is null").select("role").distinct().count() == 1
    one = spark.createDataFrame([(i, "x") for i in range(9)], "id long, family string")
    with pytest.raises(G.GateError, match="no group"):
        S.balanced_split(one, "family", (0.4, 0.3, 0.3), 3)
    assert S.balanced_split(one, "family", (1.0, 0.0, 0.0), 3).where("role = 'train'").count() == 9
    with pytest.raises(G.GateError, match="nothing to split"):
        S.balanced_split(one.limit(0), "family", (0.4, 0.3, 0.3), 3)


def test_running_totals_and_quantiles(spark, records):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 40, 500)
    df = spark.createDataFrame([(int(v), None if k % 9 == 0 else float(v) / 7) for k, v in enumerate(values)], "v long, x double").repartition(5)
    totals = {r.v: r.total for r in running_total(df.groupBy("v").agg(F.count("*").alias("c")), ["v"], "c").collect()}
    assert totals == {int(v): int((values <= v).sum()) for v in set(values)}
    x = np.array([float(v) / 7 for k, v in enumerate(values) if k % 9])
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    got = quantiles(df, "x", shares).first()
    assert all(got[k] == pytest.approx(np.quantile(x, q)) for k, q in shares.items())
    assert quantiles(df.limit(0), "x", {"m": 0.5}).first().m is None
    assert quantiles(df.where("v = 3").limit(1).withColumn("x", F.lit(2.5)), "x", {"m": 0.5}).first().m == 2.5


def test_fold_gates(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "id long, fold_a int")
    with pytest.raises(PySparkException):
        S.fold_roles(df, ["fold_a"]).collect()
    assert [r.role for r in S.fold_roles(df.where("id = 1"), ["fold_a"]).collect()] == ["test"]


def test_labels(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id long, label string")
    assert {r.id: r.label_index for r in P.label_index(df, "label").collect()} == {1: 1, 2: None, 3: 0, 4: 1}
    assert sorted(r.id for r in P.single_label(df, "label", "b").collect()) == [2, 3]


def test_draws_again(spark):
    """Groups so small against the threshold that some come out short are drawn from all of their rows, like a plain sort by hash."""
    df = spark.createDataFrame([(i, "g") for i in range(3000)], "id long, g string")
    out = {(r.n, r.seed): set() for r in S.draws(df, ["g"], "id", [5, 1500], [0, 1]).collect()}
    for r in S.draws(df, ["g"], "id", [5, 1500], [0, 1]).collect():
        out[r.n, r.seed].add(r.id)
    for (n, seed), ids in out.items():
        want = sorted(range(3000), key=lambda i: (hashlib.md5(f"g:{n}:{seed}:{i}".encode()).hexdigest(), i))[:n]
        assert ids == set(want)


def test_draws(spark, records):
    out = S.draws(records, ["size"], "id", [10, 40], [0, 1])
    sizes = out.groupBy("size", "n", "seed").agg(F.count("*").alias("c"), F.count_distinct("id").alias("d")).collect()
    assert len(sizes) == 44 and all(r.c == r.d == r.n for r in sizes)
    again = S.draws(records.repartition(9), ["size"], "id", [10, 40], [0, 1])
    assert out.select("id", "n", "seed").exceptAll(again.select("id", "n", "seed")).count() == 0
    with pytest.raises(G.GateError):
        S.draws(records, ["size"], "id", [5000], [0])


def test_shuffled_pairs_are_a_permutation(records):
    out = S.shuffled_pairs(records, "id", "size", 1).collect()
    assert len({r.other for r in out}) == 1500 and sum(r.id == r.other for r in out) < 20
    assert {(r.id, r.other) for r in out} != {(r.id, r.other) for r in S.shuffled_pairs(records, "id", "size", 2).collect()}


def test_picks(records):
    assert S.stratified_sample(records, "id", "size", 93, 1).count() == 93
    with pytest.raises(G.GateError):
        S.stratified_sample(records, "id", "size", 2000, 1)
    with pytest.raises(G.GateError):
        S.evenly_spaced(records.limit(3), "id", "size", 9)


def test_gates(spark, records):
    with pytest.raises(G.GateError, match="big: 136"):
        G.check(records, {"big": F.col("size") == 10, "fine": F.col("id") < 0}, strict=True)
    with pytest.raises(G.GateError):
        P.annotated(records, spark.createDataFrame([("f1", "a"), ("f1", "b")], "family string, t string"), "family")
    with pytest.raises(G.GateError):
        P.eligible(records, "size", "size", "size")
    with pytest.raises(G.GateError):
        P.first_by_group(records, "family", "id", ["f1", "nowhere"])
    with pytest.raises(G.GateError):
        S.fold_roles(records, ["fold"])
    with pytest.raises(G.GateError):
        G.union()


def test_metrics(spark):
    perfect = spark.createDataFrame([("a", "a"), ("b", "b")], "t string, p string")
    r = K.classification(perfect, "t", "p").first()
    assert r.accuracy == r.f1 == r.balanced_accuracy == 1
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b"), ("b", "a")], "t string, p string")
    r = K.classification(df, "t", "p").first()
    assert r.balanced_accuracy == 0.5 and r.recall == pytest.approx(1 / 3) and {x.label: x.support for x in K.confusion(df, "t", "p").collect()}["c"] == 0
    assert K.classification(df.limit(0), "t", "p").first().n is None
    with pytest.raises(G.GateError):
        K.classification(df, "t", "p", "weighted")
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, 300), rng.integers(0, 5, 300)
    pairs = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert K.spearman(pairs, "x", "y") == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()))
    with pytest.raises(G.GateError):
        K.spearman(pairs.withColumn("y", F.lit(1)), "x", "y")
    assert K.spearman_by(pairs.withColumn("g", F.lit(1)).withColumn("y", F.lit(1)), ["g"], "x", "y").first().spearman is None


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(120, 3)), rng.normal(size=120)
    x = (x - x.mean(0)) / x.std(0)
    df = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)], "vec array<double>, y double")
    want = np.linalg.solve(x.T @ x + 5 * np.eye(3), x.T @ (y - y.mean()))
    assert np.allclose(M.ridge(df, "vec", "y", 5.0).coefficients.toArray(), want, atol=1e-8)
    rows = df.withColumn("k", F.monotonically_increasing_id()).withColumn("role", F.when(F.pmod("k", F.lit(4)) == 0, "val").when(F.pmod("k", F.lit(4)) == 1, "test").otherwise("train"))
    out = M.ridge_grid(rows.select(F.lit(1).alias("c"), "role", "vec", "y"), ["c"]).first()
    assert out.penalty in M.PENALTIES and out.n_train + out.n_test < 120


def plain_ridge(train, val, test, penalties):
    """The grid's fit of one configuration, by a decomposition of the standardised rows."""
    x, y = train
    mean, sd = x.mean(0), x.std(0) + 1e-8
    best = None
    for p in penalties:
        z = (x - mean) / sd
        w = np.linalg.solve(z.T @ z + p * np.eye(x.shape[1]), z.T @ (y - y.mean()))
        say = lambda v, w=w: (v - mean) / sd @ w + y.mean()
        loss = ((say(val[0]) - val[1]) ** 2).mean()
        if best is None or loss < best[1]:
            best = (p, loss, pd.Series(say(test[0])).rank().corr(pd.Series(test[1]).rank()), len(y), len(test[1]))
    return best


def test_ridge_grid_is_the_plain_fit(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for c, width in (("a", 3), ("b", 6), (None, 4)):
        w = rng.normal(size=width)
        part = {}
        for role, n in (("train", 60), ("val", 20), ("test", 30)):
            x = rng.normal(3, 5, (n, width))
            y = x @ w + rng.normal(0, 4, n)
            part[role] = (x, y)
            rows += [(c, role, [float(v) for v in a], float(b), len(rows)) for a, b in zip(x, y, strict=True)]
        want[c] = plain_ridge(part["train"], part["val"], part["test"], M.PENALTIES)
    del want[None]
    df = spark.createDataFrame([r for r in rows if r[0]], "c string, role string, vec array<double>, y double, k int").repartition(6)
    got = {r.c: (r.penalty, r.val_mse, r.spearman, r.n_train, r.n_test) for r in M.ridge_grid(df, ["c"]).collect()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == pytest.approx(want[c], rel=1e-6)
    flat = df.withColumn("y", F.when(F.col("role") == "test", 1.0).otherwise(F.col("y")))
    assert {r.spearman for r in M.ridge_grid(flat, ["c"]).collect()} == {None}


def test_scores(spark):
    site = spark.createDataFrame([("a", p, t, v) for p in (0, 1) for t, v in (("A", -1.0), ("G", -2.0 - p))], "assay string, position int, token string, logp double")
    make = lambda subs: spark.createDataFrame([("v", "a", subs)], "v string, assay string, subs array<struct<pos:int,wt:string,mut:string>>")
    got = lambda subs: Z.masked_marginals(make(subs), site, "v", "assay").first().score
    assert got([(0, "A", "G")]) == -1 and got([(0, "A", "A")]) == 0 and got([(0, "A", "G"), (1, "A", "G")]) == -3
    for bad in ([], [(7, "A", "G")], [(0, "A", "X")]):
        with pytest.raises(PySparkException):
            got(bad)


def test_features(spark):
    res = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 0, [5.0, 6.0])], "id int, position int, vec array<float>")
    at = spark.createDataFrame([(1, 1), (2, 0)], "id int, position int")
    assert {r.id: r.vec for r in E.readout(res, "id", "mean").collect()} == {1: [2.0, 3.0], 2: [5.0, 6.0]}
    diff = E.readout(res, "id", "difference_at_position", at, spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 0.0])], "position int, vec array<float>"))
    assert {r.id: r.vec for r in diff.collect()} == {1: [2.0, 4.0], 2: [4.0, 5.0]}
    with pytest.raises(G.GateError):
        E.readout(res, "id", "last")
    assert E.spec_text({"b": 1, "a": 2, "batch_size": 8}) == E.spec_text({"a": 2, "b": 1, "batch_size": 64})
    texts = spark.createDataFrame([(1, "two words"), (2, " "), (3, None)], "id int, t string")
    zero = {r.id: any(r.vec) for r in E.hashed_text_features(texts, "id", "t", 16).collect()}
    assert zero == {1: True, 2: False, 3: False}
    lengths = lambda: lambda ts: [[float(len(t)), 1.0] for t in ts]
    for batch in (1, 8):
        assert {r.id: r.vec for r in E.encoded(texts, "id", "t", lengths, 2, batch).collect()} == {1: [9.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    with pytest.raises(PySparkException):
        E.encoded(texts, "id", "t", lengths, 3).collect()
    a = E.fingerprint(texts, ["id", "t"]).first()
    assert a == E.fingerprint(texts.repartition(3), ["id", "t"]).first() and a != E.fingerprint(texts.limit(2), ["id", "t"]).first()
    with pytest.raises(G.GateError):
        E.assembled({"x": res}, ["x", "y"], "id")


def test_arms_and_contrasts(spark):
    for bad in ([{"name": "a", "blocks": ["x"]}] * 2, [{"name": "a", "blocks": ["y"]}], [{"name": "a", "blocks": ["x"], "shuffle": ["x"], "redrawn": ["x"]}]):
        with pytest.raises(G.GateError):
            M.checked_arms(bad, {"x": lambda seed: None})
    for bad in ({"name": "a", "blocks": ["x"], "shuffle": ["y"]}, {"name": "a", "blocks": ["x"], "redrawn": ["x"]}, {"name": "a", "blocks": ["x"], "shuffle": ["z"]}):
        with pytest.raises(G.GateError):
            M.checked_arms([bad], {"x": None, "y": None})
    assert C.p_value(1.959964) == pytest.approx(0.05, abs=1e-6)
    curve = spark.createDataFrame([("a", 8, 0.1, 0.3), ("a", 16, 0.4, 0.3), ("b", 8, 0.1, 0.3)], "arm string, n int, mean double, floor double")
    assert {r.arm: r.crossover for r in C.crossover(curve, ["arm"], "n").collect()} == {"a": 16, "b": None}


def test_arms_honour_their_flags(spark):
    """The label stands in the block: an arm that uses it is perfect, one that shuffles it is not, and a redrawn block is that of the seed."""
    rows = [(i, i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label long")
    vec = lambda *c: df.select("id", F.array(*c).cast("array<float>").alias("vec"))
    blocks = {"true": vec("label"), "noise": vec(F.col("id") % 7), "drawn": lambda seed: vec(F.col("label") if seed == 1 else F.lit(0))}
    arms = [
        {"name": "true", "blocks": ["true", "noise"]}, {"name": "shuffled", "blocks": ["true"], "shuffle": ["true"]},
        {"name": "drawn", "blocks": ["drawn"], "redrawn": ["drawn"]}, {"name": "fixed", "blocks": ["drawn"]},
    ]
    split = lambda seed: df.select("id", "label", S.hash_split(F.col("id"), (0.6, 0.2, 0.2), seed).alias("role"))
    got = {(r.arm, r.seed): r.accuracy for r in M.run_arms(arms[1:], blocks, split, "id", "label", [0, 1]).collect()}
    assert got["shuffled", 0] < 0.7 and got["shuffled", 1] < 0.7 and got["shuffled", 0] != got["shuffled", 1]
    assert got["drawn", 1] == 1 and got["drawn", 0] < 0.6 and got["fixed", 0] == got["drawn", 0] and got["fixed", 1] < 0.6
    heads = M.run_arms(arms[:1], blocks, split, "id", "label", [1], fit=M.head_fit).first()
    assert heads.accuracy > 0.9
    wide = spark.createDataFrame([(i, i, "train") for i in range(20)] + [(99, 1, "test")], "id long, label long, role string").withColumn("vec", F.array(F.lit(0.0)))
    assert [r.predicted for r in M.nearest_centroid(wide, "id", "label", "vec").collect()] == [0]


def test_cluster_split(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    df = spark.range(500).toDF("k").repartition(3)
    out = cluster_split(df, "k", spark.createDataFrame(pairs, "a long, b long"), (0.6, 0.2, 0.2), 5)
    assert {r.k: r.cluster for r in out.collect()} == {k: root(k) for k in range(500)}
    assert S.leak_audit(out, "cluster").count() == 0
    alone = cluster_split(df, "k", spark.createDataFrame([], "a long, b long"), (0.6, 0.2, 0.2), 5)
    assert alone.where("k <> cluster").count() == 0 and alone.count() == 500


def test_grid_axes(spark):
    names = spark.createDataFrame([("b",), ("a",), ("b",)], "x string")
    rows = R.grid(spark, {"rung": ["r"], "assay": names, "n": [8, 16]}).orderBy("ordinal").collect()
    assert [(r.assay, r.n, r.ordinal) for r in rows] == [("a", 8, 0), ("a", 16, 1), ("b", 8, 2), ("b", 16, 3)]


def test_shared_folder_and_steps(spark):
    made = []

    def build():
        made.append(shared.new_folder(spark, "inner"))
        spark.range(3).write.parquet(made[0])
        return spark.read.parquet(made[0])

    out = shared.step(build, "outer")
    assert out.count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "arm string, n long")
    sinks.write_summary(df, str(tmp_path / "s.csv"))
    sinks.write_summary(df, str(tmp_path / "s.json"), "json")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "s.csv"), header=True, schema="arm string, n long").orderBy("n").collect()] == [("a", 1), ("b", 2)]
    assert spark.read.json(str(tmp_path / "s.json")).count() == 2


def test_shards(spark, tmp_path):
    expected = R.grid(spark, {"arm": ["x", "y"], "n": [1, 2]})
    rows = expected.select("arm", "n", (F.col("ordinal") * 1.5).alias("score"))
    path = str(tmp_path / "shards")
    sinks.write_shards(rows, path, ["arm", "n"])
    sinks.write_shards(rows.limit(1), path, ["arm", "n"])
    assert [r.score for r in sinks.aggregate_shards(spark, path, expected, ["arm", "n"]).collect()] == [0, 1.5, 3, 4.5]
    with pytest.raises(G.GateError, match="missing"):
        sinks.aggregate_shards(spark, path, R.grid(spark, {"arm": ["x", "y", "z"], "n": [1, 2]}), ["arm", "n"])
    with pytest.raises(G.GateError, match="foreign"):
        sinks.aggregate_shards(spark, path, R.grid(spark, {"arm": ["x"], "n": [1, 2]}), ["arm", "n"])
    wrong = rows.withColumn("shard", R.shard_name(["arm", "n"])).withColumn("arm", F.lit("x"))
    assert "contradicts its name" in {r.fault for r in R.shard_faults(wrong, expected, ["arm", "n"]).collect()}


def test_fasta(spark, tmp_path):
    good = tmp_path / "a.fasta"
    good.write_text(">P1 Cell.membrane-M test\nmkv\nLLA\n>P2 Cytoplasm-S\nMK\n>P3 Cytoplasm-Nucleus-U\nMM\n")
    records, rejects = readers.read_labelled_fasta(spark, str(good))
    assert sorted(tuple(r) for r in records.collect()) == [("P1", "MKVLLA", "Cell.membrane", "M", True), ("P2", "MK", "Cytoplasm", "S", False), ("P3", "MM", "Cytoplasm-Nucleus", "U", False)]
    assert rejects.count() == 0
    bad = tmp_path / "b.fasta"
    bad.write_text("MKV\n>P1 Cytoplasm-S\nMK\n>P1 Cytoplasm-S\nMK\n>P4 Nucleus-U\n\n>P5 Nucleus\nMK\n>P6 Nowhere-S\nMK\n>P7 Nucleus-S\nM1K\n>P8 Nucleus-S\nMK\n")
    records, rejects = readers.read_labelled_fasta(spark, str(bad))
    assert [r.accession for r in records.collect()] == ["P8"]
    assert sorted(r.reason for r in rejects.collect()) == sorted(["data before a header", "accession stands twice", "accession stands twice", "empty or malformed sequence", "malformed header", "unknown label", "empty or malformed sequence"])
    empty = tmp_path / "c.fasta"
    empty.write_text("")
    with pytest.raises(G.GateError):
        readers.read_labelled_fasta(spark, str(empty))


def test_other_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("DMS_id,taxon\na,Human\n")
    with pytest.raises(G.GateError):
        readers.read_assay_reference(spark, str(tmp_path / "r.csv"))
    with pytest.raises(G.GateError):
        readers.read_assays(spark, str(tmp_path), ["nowhere"])
    with pytest.raises(G.GateError):
        readers.read_results(spark, [str(tmp_path / "none.csv")])
    tsv = tmp_path / "t.tsv"
    tsv.write_text("\t".join(readers.ANNOTATION_NAMES) + '\nP1\tan "unpaired\t\t\tx\ty\nP1\tother\t\t\tx\ty\n')
    out = readers.read_annotations(spark, str(tsv)).collect()
    assert len(out) == 1 and out[0].function_text == 'an "unpaired' and out[0].go_component == ""


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
