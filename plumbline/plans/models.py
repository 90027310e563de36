"""Feature tables, scores, metrics, contrasts and grids over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import arms as A
from ..operators import contrasts as C
from ..operators import features as E
from ..operators import fits as M
from ..operators import gates as G
from ..operators import grid as R
from ..operators import metrics as K
from ..operators import scoring as Z
from ..operators import splits as S
from ..operators import store as V
from ..sources import sinks
from .cohorts import _folder
from .splits import _t

SPEC = {"encoder": "hashed words", "width": 64, "pooling": "mean", "batch_size": 8}
TOKENS = ("click", "error", "purchase", "signup", "view")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


def _residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as residue vectors: the label is the sequence, the rank within it the position."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return _embeddings(spark, sf_dir).select("label", (F.row_number().over(w) - 1).alias("position"), "vec")


def w4_length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.length_batches(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 16).select("doc_id", "batch")


def a5_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.length_profile(_t(spark, sf_dir, "documents"), "n_chars")


def a6_padding_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.padding_cost(_t(spark, sf_dir, "documents"), "doc_id", "n_chars", [8, 16])


def e1_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be said of hashed features without their hash: width, length, and that blank texts are zero."""
    out = E.hashed_text_features(_t(spark, sf_dir, "documents"), "doc_id", "text", 64)
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return out.select("doc_id", F.size("vec").alias("width"), F.round(F.sqrt(squares), 4).alias("norm"), (~F.exists("vec", lambda x: x != 0)).alias("blank"))


def e2_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    def encoder():
        def encode(texts):
            return [[float(len(t)), float(t.count(" ")), float(sum(map(ord, t)) % 1_000_003)] for t in texts]

        return encode

    out = E.encoded(_t(spark, sf_dir, "documents"), "doc_id", "text", encoder, 3)
    return out.select("doc_id", *[F.col("vec")[i].cast("double").alias(f"v{i}") for i in range(3)])


def e3_mean_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.readout(_residues(spark, sf_dir), "label", "mean")
    return out.select("label", F.posexplode("vec").alias("i", "x")).select("label", "i", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


def e4_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _residues(spark, sf_dir).select("label", F.pmod("label", F.lit(7)).alias("position")).distinct()
    out = E.readout(_residues(spark, sf_dir), "label", "at_position", wanted)
    return out.select("label", F.col("vec")[0].cast("double").alias("first"), F.col("vec")[63].cast("double").alias("last"))


def e5_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    residues = _residues(spark, sf_dir)
    wanted = residues.select("label", F.pmod("label", F.lit(7)).alias("position")).distinct()
    wild = residues.where("label = 0").select("position", "vec")
    out = E.readout(residues, "label", "difference_at_position", wanted, wild)
    return out.select("label", (F.round(F.col("vec")[0].cast("double"), 5) + 0.0).alias("first"))


def e5_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As e5_difference, from a residue table in buckets."""
    residues = E.colocated(_residues(spark, sf_dir), "label", f"residues_{uuid.uuid4().hex}", 8)
    wanted = residues.select("label", F.pmod("label", F.lit(7)).alias("position")).distinct()
    out = E.readout(residues, "label", "difference_at_position", wanted, residues.where("label = 0").select("position", "vec"))
    return out.select("label", (F.round(F.col("vec")[0].cast("double"), 5) + 0.0).alias("first"))


def e6_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spec = _t(spark, sf_dir, "documents").select("doc_id", "text"), E.spec_text(SPEC)
    store = docs.where(F.pmod("doc_id", F.lit(3)) == 0).select(E.item_key(spec, F.col("text")).alias("item_key"))
    return E.cache_misses(docs, "text", spec, store).select("item_key")


def _store_runs(spark: SparkSession, sf_dir: str):
    """A store that is filled in three runs: a third of the documents, all of them, and half of them under a changed spec; then compacted."""

    def encoder(extra: float):
        def make():
            return lambda texts: [[float(len(t)), float(t.count(" ")), extra] for t in texts]

        return make

    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    store = V.VectorStore(spark, _folder(spark, "vectors"))
    spec = lambda layer: E.spec_text(SPEC | {"layer": layer})
    through = lambda rows, layer: store.read_through(rows, "text", spec(layer), V.by_encoder("text", encoder(float(layer)), 3))
    through(docs.where("doc_id % 3 = 0"), 1)
    whole = through(docs, 1)
    changed = through(docs.where("doc_id % 2 = 0"), 2)
    store.compact()
    return store, whole, changed


def e6_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its vector under both specs, read back from the store."""
    _, whole, changed = _store_runs(spark, sf_dir)
    at = lambda i: F.col("vec")[i].cast("double")
    return whole.select("doc_id", at(0).alias("v0"), at(1).alias("v1"), at(2).alias("v2")).join(changed.select("doc_id", at(2).alias("other")), "doc_id", "left")


def e6_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run has appended: only what the store lacked."""
    store, _, _ = _store_runs(spark, sf_dir)
    layer = F.coalesce(F.get_json_object("spec", "$.layer").cast("int"), F.lit(0))
    return store.history().select("version", "kind", "rows", "parts", layer.alias("layer"))


def e7_miss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = E.spec_text(SPEC)
    width = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit(64)).otherwise(F.lit(32)).cast("string")
    old = F.concat(F.lit('{"encoder":"hashed words","pooling":"mean","width":'), width, F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit(',"layer":1}')).otherwise(F.lit("}")))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(7)) > 0, old).alias("old_spec"), F.lit(new).alias("new_spec"))
    out = E.miss_reasons(rows)
    return out.groupBy("reason", F.array_join("changed", ",").alias("changed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed")).agg(F.count("*").alias("n"))


def e8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fingerprint(_t(spark, sf_dir, "documents"), ["doc_id", "lang", "n_chars"])


def e8_ordered_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ordered_fingerprint(_t(spark, sf_dir, "documents"), ["doc_id", "lang", "n_chars"], ["n_chars", "doc_id"])


def e9_finite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.when(F.pmod("vec_id", F.lit(50)) == 0, F.transform("vec", lambda _: F.lit(float("nan")).cast("float"))).otherwise(F.col("vec"))
    return G.check(_embeddings(spark, sf_dir).select("vec_id", vec.alias("vec")), {"finite": G.not_finite(F.col("vec"))}).select("rule", "n_bad")


def f9_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    blocks = {"whole": e.select("vec_id", "vec"), "head": e.select("vec_id", F.slice("vec", 1, 4).alias("vec"))}
    out = E.assembled(blocks, ["head", "whole"], "vec_id")
    return out.select("vec_id", F.size("vec").alias("width"), F.col("vec")[4].cast("double").alias("fifth"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.lit("a").alias("assay"), F.col("user_id").alias("position"), F.col("event_type").alias("token"))
    return Z.site_profile(e, ["assay", "position"], "token", e.select("token"))


def m3_site_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).select("position", "token", "n", F.round("logp", 9).alias("logp"))


def m2_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 10000).alias("logit"))
    return Z.log_softmax(logits, ["user_id"]).select("user_id", "event_type", F.round("logp", 9).alias("logp"))


def _marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    sub = lambda pos, wt, mut: F.struct(pos.alias("pos"), wt.alias("wt"), mut.alias("mut"))
    subs = F.array(sub(F.col("user_id"), F.col("event_type"), F.lit("view")), sub(F.col("user_id"), F.lit("error"), F.lit("click")))
    return Z.masked_marginals(e.select("event_id", F.lit("a").alias("assay"), subs.alias("subs")), _profile(spark, sf_dir), "event_id", "assay")


def m1_masked_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marginals(spark, sf_dir).select("event_id", F.round("score", 9).alias("score"))


def _position_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", F.round("o_totalprice", 2).alias("score"))
    return o.withColumn("role", F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "test").otherwise("train"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _position_rows(spark, sf_dir)
    return Z.position_means(rows.where("role = 'train'"), rows.where("role = 'test'").drop("role"), ["o_orderstatus"], "o_custkey", "score")


def m4_position_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).select("o_orderkey", F.round("predicted", 4).alias("predicted"))


def k7_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.mean_squared_error(_predicted(spark, sf_dir), "score", "predicted", ["o_orderstatus"]).select("o_orderstatus", F.round(F.col("mse") / 1e6, 3).alias("mse"))


def m10_zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _position_rows(spark, sf_dir)
    scored = rows.select("o_orderkey", "o_orderstatus", F.pmod("o_custkey", F.lit(13)).alias("zero"), "score")
    return Z.zero_shot(scored, rows.select("o_orderkey", "role"), "o_orderkey", ["o_orderstatus"], "zero", "score").select("o_orderstatus", "n", F.round("spearman", 9).alias("spearman"))


def k1_spearman_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.spearman_by(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", "n", F.round("spearman", 9).alias("spearman"))


def k1_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(round(K.spearman(li, "l_quantity", "l_extendedprice"), 9),)], "spearman double").crossJoin(li.agg(F.count("*").alias("n")))


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).withColumn("role", F.when(F.pmod("vec_id", F.lit(5)) == 0, "test").otherwise("train"))


def m7_centroid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nearest_centroid(_roles(spark, sf_dir), "vec_id", "label", "vec")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: the truth is the status, the prediction a mix that names one class that never occurs."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k = F.pmod("o_orderkey", F.lit(7))
    return o.withColumn("said", F.when(k < 4, F.col("o_orderstatus")).when(k == 4, "F").when(k == 5, "O").otherwise("X"))


def k2_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.confusion(_predictions(spark, sf_dir), "o_orderstatus", "said")


def k3_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.per_class(_predictions(spark, sf_dir), "o_orderstatus", "said").select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def k4_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.classification(_predictions(spark, sf_dir), "o_orderstatus", "said"))


def k4_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.classification(_predictions(spark, sf_dir), "o_orderstatus", "said", "micro"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as results: return flag the arm, line number the seed, order month the configuration, mean quantity the score."""
    li = _t(spark, sf_dir, "lineitem").where("not (l_returnflag = 'R' and l_linenumber > 1)")
    return li.groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("seed"), F.pmod("l_suppkey", F.lit(12)).cast("int").alias("n"), F.col("l_linestatus").alias("assay")).agg((F.sum("l_quantity") / F.count("*")).alias("score"))


def a11_seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_seed = _runs(spark, sf_dir).groupBy("arm", "seed").agg(F.avg("score").alias("score"))
    return _rounded(K.seed_spread(by_seed, "arm", ["score"]))


def a12_seed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_seed = _runs(spark, sf_dir).groupBy("arm", "seed").agg(F.round(F.avg("score"), 9).alias("score"))
    return K.seed_matrix(by_seed, "arm", "score", [1, 2, 3])


def a13_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.median_score(_runs(spark, sf_dir), "score", ["arm"]))


def a14_at_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.at_edge(_runs(spark, sf_dir), "n", [0, 3, 11])


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    floor = runs.where("arm = 'R'").groupBy("assay").agg(F.avg("score").alias("floor"))
    return K.efficiency_curve(runs.where("arm <> 'R'"), ["assay", "arm"], "n", "score", floor)


def a15_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_curve(spark, sf_dir))


def a16_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.readout_means(_runs(spark, sf_dir), ["seed"], "arm", "score", ["A", "N", "R"]))


def w5_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).withColumn("loss", F.round("score", 1))
    return M.best_by_validation(r.groupBy("arm", "seed").agg(F.min("loss").alias("loss")), ["arm"], "loss", "seed")


def c1_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _runs(spark, sf_dir).groupBy(F.concat("arm", "assay").alias("arm")).agg(F.avg("score").alias("score"))
    return _rounded(C.gain_decomposition(s, "arm", "score", "AF", "NF", "NO", "RF"))


def c2_class_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    f1 = K.per_class(p.withColumn("arm", F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "a").otherwise("b")), "o_orderstatus", "said", ["arm"])
    return _rounded(C.class_gains(f1, "arm", "label", "a", "b"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paired(_runs(spark, sf_dir), "arm", "score", ["assay", "n", "seed"], "A", "N", F.col("seed") < 7).withColumn("delta", F.round("delta", 6))


def c3_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.paired_summary(_pairs(spark, sf_dir), ["seed"]))


def c4_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.signed_rank(_pairs(spark, sf_dir), ["assay"]))


def c4_signed_rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By assay and seed, so that some groups are small enough to be counted out."""
    small = _pairs(spark, sf_dir).withColumn("seed", F.when(F.col("n") < 9, F.col("seed")).otherwise(0))
    return _rounded(C.signed_rank_test(small, ["assay", "seed"]))


def c5_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.cluster_bootstrap(_pairs(spark, sf_dir), "n", 200, 1))


def c6_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.sign_consistency(_pairs(spark, sf_dir), "seed"))


def c7_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.crossover(_curve(spark, sf_dir), ["assay", "arm"], "n")


def m5_ridge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight configurations: a slice of the vector, the y and the roles of each are its own."""
    c = F.col("config")
    e = _embeddings(spark, sf_dir).select("vec_id", "label", "vec", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("config"))
    role = F.element_at(F.array(F.lit("train"), F.lit("train"), F.lit("val"), F.lit("test")), (F.pmod(F.col("vec_id") + c, F.lit(4)) + 1).cast("int"))
    rows = e.select("config", role.alias("role"), F.slice("vec", F.lit(1), 4 + 4 * c).alias("vec"), (F.col("label").cast("double") + F.get("vec", c) * 20).alias("y"))
    return M.ridge_grid(rows, ["config"])


def m5_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _roles(spark, sf_dir).withColumn("y", F.col("label").cast("double") + F.col("vec")[0] * 3)
    model = M.ridge(rows.where("role = 'train'"), "vec", "y", 1.0)
    return M.predictions(model, rows.where("role = 'test'"), "vec").select("vec_id", "y", "prediction")


def m6_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _roles(spark, sf_dir)
    model, _, _ = M.head(rows.where("role = 'train' and pmod(vec_id, 5) < 4"), rows.where("pmod(vec_id, 5) = 4"), "vec", "label", 10, 1)
    return M.predictions(model, rows.where("role = 'test'"), "vec").select("vec_id", "label", "prediction")


def m8_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole and a half block, the half with the whole one shuffled, and a block that is drawn anew for each seed."""
    e = _embeddings(spark, sf_dir)
    blocks = {"whole": e.select("vec_id", "vec"), "half": e.select("vec_id", F.slice("vec", 1, 32).alias("vec")), "drawn": lambda seed: e.select("vec_id", F.slice("vec", 1 + 8 * seed, 8).alias("vec"))}
    arms = [{"name": "whole", "blocks": ["whole"]}, {"name": "half", "blocks": ["half"]}, {"name": "control", "blocks": ["half", "whole"], "shuffle": ["whole"]}, {"name": "redrawn", "blocks": ["drawn"], "redrawn": ["drawn"]}]
    role = lambda seed: e.select("vec_id", "label", S.hash_split(F.col("vec_id"), (0.7, 0.0, 0.3), seed).alias("role"))
    return _rounded(M.run_arms(arms, blocks, role, "vec_id", "label", [0, 1]))


#: Twelve arms over four blocks and a block drawn by seed: each alone, together, with a shuffled partner, ablated and with its random control.
ARMS = [
    {"name": name, "blocks": blocks.split(), "shuffle": shuffle.split(), "redrawn": redrawn.split()}
    for name, blocks, shuffle, redrawn in (
        ("sequence", "sequence", "", ""), ("text", "text", "", ""), ("fields", "fields", "", ""), ("sequence+text", "sequence text", "", ""), ("sequence+fields", "sequence fields", "", ""), ("text+fields", "text fields", "", ""),
        ("all", "sequence text fields", "", ""), ("other text", "sequence text", "text", ""), ("other fields", "sequence fields", "fields", ""), ("ablated", "sequence ablated", "", ""), ("random", "sequence drawn", "", "drawn"), ("ablated alone", "ablated", "", ""),
    )
]


def _arm_blocks(spark: SparkSession, sf_dir: str):
    e = _embeddings(spark, sf_dir)
    part = lambda at, n: e.select("vec_id", F.slice("vec", at, n).alias("vec"))
    blocks = {"sequence": part(1, 24), "text": part(25, 16), "fields": part(41, 8), "ablated": part(49, 8), "drawn": lambda seed: part(9 + 8 * seed, 8)}
    role = lambda fractions: lambda seed: e.select("vec_id", "label", S.hash_split(F.col("vec_id"), fractions, seed).alias("role"))
    return blocks, role


def m8_all_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve arms and three seeds from one wide table, judged by the nearest class mean."""
    blocks, role = _arm_blocks(spark, sf_dir)
    return _rounded(A.centroid_arms(ARMS, blocks, role((0.7, 0.0, 0.3)), "vec_id", "label", [0, 1, 2]))


def m8_ridge_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arms and seeds with a linear head that is chosen on validation rows."""
    blocks, role = _arm_blocks(spark, sf_dir)
    return _rounded(A.ridge_arms(ARMS, blocks, role((0.6, 0.15, 0.25)), "vec_id", "label", [0, 1, 2]))


def m9_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All axes: the customers' names are the assays."""
    assays = _t(spark, sf_dir, "supplier").select("s_name")
    return R.grid(spark, {"rung": ["frozen", "ridge"], "assay": assays, "scheme": ["random", "modulo"], "readout": list(E.READOUTS), "n": [32, 128, 512], "seed": [0, 1], "checkpoint": ["small", "large"]})


def m9_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readouts of two checkpoints, with two schemes, sizes and seeds."""
    e = _embeddings(spark, sf_dir)
    fold = F.pmod("vec_id", F.lit(5)).cast("int")
    features = F.array(
        *[
            F.struct(F.lit(c).alias("checkpoint"), F.lit(r).alias("readout"), (F.slice("vec", 1, w) if r == "mean" else F.transform(F.slice("vec", 1, w), lambda x: x * x)).alias("vec"))
            for c, w in (("small", 8), ("large", 24))
            for r in ("mean", "at_position")
        ]
    )
    v = e.select(F.lit("a").alias("assay"), "vec_id", F.col("label").cast("double").alias("y"), fold.alias("fold_modulo"), F.pmod(F.floor(F.col("vec_id") / 7), F.lit(5)).cast("int").alias("fold_contiguous"), F.inline(features))
    return R.evaluate(v, ["assay", "checkpoint", "readout"], "vec_id", ["fold_modulo", "fold_contiguous"], [16, 48], [0, 1])


def s9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, config = _folder(spark, "shards"), ["arm", "seed"]
    by_seed = _runs(spark, sf_dir).groupBy("arm", "seed").agg(F.round(F.avg("score"), 9).alias("score"))
    expected = by_seed.select("arm", "seed").withColumn("ordinal", F.hash("arm", "seed").cast("long"))
    sinks.write_shards(by_seed, path, config)
    sinks.write_shards(by_seed.where("seed = 1"), path, config)  # a rerun replaces its own shards only
    return sinks.aggregate_shards(spark, path, expected, config).select("arm", "seed", "score")


def s9_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in two phases: all of them, then those of one seed again; a staged run that is not committed changes nothing."""
    path, config = _folder(spark, "published"), ["arm", "seed"]
    by_seed = _runs(spark, sf_dir).groupBy("arm", "seed").agg(F.round(F.avg("score"), 9).alias("score"))
    expected = by_seed.select("arm", "seed").withColumn("ordinal", F.hash("arm", "seed").cast("long"))
    sinks.publish_shards(by_seed.withColumn("score", F.when(F.col("seed") == 1, -1.0).otherwise(F.col("score"))), path, config)
    sinks.publish_shards(by_seed.where("seed = 1"), path, config)
    return sinks.read_published(spark, path, expected, config).select("arm", "seed", "score")


def z1_singles_to_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import substitutions
    from .cohorts import _variants

    v = _variants(spark, sf_dir).withColumn("subs", substitutions(F.col("mutant"), True)).where("subs is not null")
    return Z.singles_to_multiples(v).groupBy("role").agg(F.count("*").alias("n"))


def z2_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as variants: even keys are single ones, odd keys double ones of the key before and of half the key, which may be no single one."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"))
    name = lambda c: F.concat(F.lit("v"), c.cast("string"))
    k = F.col("o_orderkey")
    variant = F.when(F.pmod(k, F.lit(2)) == 0, name(k)).otherwise(F.concat(name(k - 1), F.lit(":"), name(F.floor(k / 2))))
    out = Z.additivity_residuals(o.select(F.lit("a").alias("assay"), variant.alias("variant"), "score"), "assay")
    return out.select("variant", F.round("residual", 2).alias("residual"))


_RUNS = """WITH runs AS (SELECT l_returnflag AS arm, l_linenumber AS seed, (l_suppkey % 12)::INT AS n, l_linestatus AS assay, sum(l_quantity) / count(*) AS score FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linenumber > 1) GROUP BY ALL),
bys AS (SELECT arm, seed, avg(score) AS score FROM runs GROUP BY ALL),
curve AS (SELECT r.assay, r.arm, r.n, avg(r.score) AS mean, coalesce(stddev_samp(r.score), 0) AS sd, count(*) AS runs, any_value(f.floor) AS floor FROM runs r LEFT JOIN (SELECT assay, avg(score) AS floor FROM runs WHERE arm = 'R' GROUP BY assay) f USING (assay) WHERE r.arm <> 'R' GROUP BY ALL),
pairs AS (SELECT a.assay, a.n, a.seed, round(a.score - b.score, 6) AS delta FROM runs a JOIN runs b ON a.assay = b.assay AND a.n = b.n AND a.seed = b.seed WHERE a.arm = 'A' AND b.arm = 'N' AND a.seed < 7)
"""
_SAID = """WITH p AS (SELECT o_orderkey, o_orderstatus AS t, CASE WHEN o_orderkey % 7 < 4 THEN o_orderstatus WHEN o_orderkey % 7 = 4 THEN 'F' WHEN o_orderkey % 7 = 5 THEN 'O' ELSE 'X' END AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS arm FROM orders),
l AS (SELECT arm, t AS label FROM p UNION SELECT arm, s FROM p),
c AS (SELECT {arm} label, count(*) FILTER (t = label AND s = label) AS tp, count(*) FILTER (t <> label AND s = label) AS fp, count(*) FILTER (t = label AND s <> label) AS fn, count(*) FILTER (t = label) AS support FROM (SELECT DISTINCT {arm} label FROM l) x, p WHERE {on} GROUP BY ALL),
f AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
"""
_ONE = _SAID.replace("{arm}", "").replace("{on}", "true")
_TWO = _SAID.replace("count(*) FILTER (t = label AND s = label)", "count(*) FILTER (t = label AND s = label)").replace("SELECT {arm} label", "SELECT x.arm, label").replace("DISTINCT {arm} label", "DISTINCT arm, label").replace("{on}", "x.arm = p.arm")
_RES = "WITH r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS position, embedding AS vec FROM embeddings)\n"
_PROFILE = """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT DISTINCT event_type FROM events), u AS (SELECT user_id, count(*) AS all_ FROM events GROUP BY 1),
p AS (SELECT u.user_id AS position, t.event_type AS token, coalesce(c.n, 0) AS n, ln((coalesce(c.n, 0) + 1.0) / (all_ + (SELECT count(*) FROM t))) AS logp FROM u CROSS JOIN t LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.event_type)
"""
_RANKED = "SELECT {g}, count(*) AS n, round(corr(rx, ry), 9) AS spearman FROM (SELECT {g}, avg(kx) OVER (PARTITION BY {g}, x) AS rx, avg(ky) OVER (PARTITION BY {g}, y) AS ry FROM (SELECT {g}, x, y, row_number() OVER (PARTITION BY {g} ORDER BY x) AS kx, row_number() OVER (PARTITION BY {g} ORDER BY y) AS ky FROM ({rows}))) GROUP BY {g}"
_POSITION = """WITH o AS (SELECT o_orderkey, o_orderstatus, o_custkey, round(o_totalprice, 2) AS score, o_orderkey % 4 = 0 AS test FROM orders),
m AS (SELECT o_orderstatus, o_custkey, avg(score) AS predicted FROM o WHERE NOT test GROUP BY ALL), q AS (SELECT o.*, m.predicted FROM o LEFT JOIN m USING (o_orderstatus, o_custkey) WHERE test)
"""

_ALL_ARMS = """WITH f AS (SELECT vec_id, label, embedding AS v FROM embeddings), seeds(seed) AS (VALUES (0), (1), (2)),
  p AS (SELECT seed, vec_id, row_number() OVER (PARTITION BY seed ORDER BY vec_id) AS r FROM f, seeds), q AS (SELECT seed, vec_id AS other, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || vec_id), vec_id) AS r FROM f, seeds),
  b AS (SELECT p.seed, p.vec_id, a.v[1:24] AS s, a.v[25:40] AS t, a.v[41:48] AS d, a.v[49:56] AS ab, a.v[9 + 8 * p.seed:16 + 8 * p.seed] AS dr, o.v[25:40] AS ot, o.v[41:48] AS od
    FROM p JOIN q USING (seed, r) JOIN f a ON a.vec_id = p.vec_id JOIN f o ON o.vec_id = q.other),
  x AS (SELECT seed, vec_id, unnest(['sequence', 'text', 'fields', 'sequence+text', 'sequence+fields', 'text+fields', 'all', 'other text', 'other fields', 'ablated', 'random', 'ablated alone']) AS arm,
    unnest([s, t, d, list_concat(s, t), list_concat(s, d), list_concat(t, d), list_concat(list_concat(s, t), d), list_concat(s, ot), list_concat(s, od), list_concat(s, ab), list_concat(s, dr), ab]) AS v FROM b),
  e AS (SELECT arm, seed, x.vec_id, f.label, unnest(x.v)::DOUBLE AS x, unnest(range(len(x.v))) AS i, ('0x' || substr(md5(seed || ':' || x.vec_id), 1, 13))::BIGINT / 4503599627370496.0 >= 0.7 AS test FROM x JOIN f USING (vec_id)),
  c AS (SELECT arm, seed, label AS l, i, avg(x) AS c FROM e WHERE NOT test GROUP BY ALL), d AS (SELECT arm, seed, vec_id, label, l, sum((x - c) * (x - c)) AS d FROM e JOIN c USING (arm, seed, i) WHERE test GROUP BY ALL),
  s AS (SELECT arm, seed, vec_id, any_value(label) AS t, arg_min(l, d) AS p FROM d GROUP BY ALL), u AS (SELECT arm, seed, t AS l FROM s UNION SELECT arm, seed, p FROM s),
  k AS (SELECT u.arm, u.seed, u.l, count(*) FILTER (t = l AND p = l) AS tp, count(*) FILTER (t <> l AND p = l) AS fp, count(*) FILTER (t = l AND p <> l) AS fn, count(*) FILTER (t = l) AS support FROM u JOIN s ON s.arm = u.arm AND s.seed = u.seed GROUP BY ALL)
  SELECT arm, seed, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 9) AS accuracy, round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 9) AS precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 9) AS recall,
    round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS f1, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)) FILTER (support > 0), 9) AS balanced_accuracy FROM k GROUP BY ALL"""

QUERIES = {
    f.__name__: f
    for f in (
        w4_length_batches, a5_length_profile, a6_padding_cost, e1_text_features, e2_encoded, e3_mean_readout, e4_at_position, e5_difference, e5_colocated, e6_cache_misses, e6_store, e6_ledger, e7_miss_reasons, e8_fingerprint, e8_ordered_fingerprint, e9_finite_gate, f9_assembled,
        m3_site_profile, m2_log_softmax, m1_masked_marginals, m4_position_means, k7_mse, m10_zero_shot, k1_spearman_by, k1_spearman, m7_centroid_predictions, k2_confusion, k3_per_class, k4_macro, k4_micro,
        a11_seed_spread, a12_seed_matrix, a13_median, a14_at_edge, a15_curve, a16_readouts, w5_best, c1_decomposition, c2_class_gains, c3_paired, c4_signed_rank, c4_signed_rank_test, c5_bootstrap, c6_signs, c7_crossover,
        m5_ridge_grid, m5_ridge, m6_head, m8_arms, m8_all_arms, m8_ridge_arms, m9_grid, m9_evaluate, s9_shards, s9_published, z1_singles_to_multiples, z2_additivity,
    )
}
SQL = {
    "w4_length_batches": "SELECT doc_id, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 16 AS batch FROM documents",
    "a5_length_profile": "SELECT len(x) AS n, list_sum(x) / len(x) AS mean, x[len(x) // 2 + 1] AS median, x[floor(0.9::DOUBLE * (len(x) - 1))::BIGINT + 1] AS p90, list_max(x) AS max, list_sum(x)::BIGINT AS total FROM (SELECT list_sort(list(n_chars)) AS x FROM documents)",
    "a6_padding_cost": """WITH r AS (SELECT n_chars, 'given' AS "order", row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents UNION ALL SELECT n_chars, 'bucketed', row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 FROM documents),
      b AS (SELECT "order", batch, k // batch AS g, max(n_chars) AS m, count(*) AS c, sum(n_chars) AS useful FROM r, (VALUES (8), (16)) a(batch) GROUP BY ALL),
      s AS (SELECT "order", batch, sum(m * c) AS slots, sum(m * m * c) AS squares, sum(useful) AS useful FROM b GROUP BY ALL)
      SELECT s.batch, s."order", s.slots::BIGINT AS slots, s.squares::BIGINT AS square_slots, 1 - s.useful / s.slots AS waste, g.slots / s.slots AS reduction FROM s JOIN s g ON g.batch = s.batch AND g."order" = 'given'""",
    "e2_encoded": "SELECT doc_id, CASE WHEN trim(t) = '' THEN 0 ELSE length(t) END::DOUBLE AS v0, CASE WHEN trim(t) = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) END::DOUBLE AS v1, CASE WHEN trim(t) = '' THEN 0 ELSE coalesce(list_sum(list_transform(string_split(t, ''), lambda c: unicode(c))), 0) % 1000003 END::DOUBLE AS v2 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "e3_mean_readout": _RES + "SELECT label, i::INT AS i, round(avg(x::DOUBLE)::FLOAT::DOUBLE, 4) + 0.0::DOUBLE AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(64)) AS i FROM r) GROUP BY label, i",
    "e4_at_position": _RES + "SELECT label, vec[1]::DOUBLE AS first, vec[64]::DOUBLE AS last FROM r WHERE position = label % 7",
    "e5_difference": _RES + "SELECT r.label, round((r.vec[1] - w.vec[1])::DOUBLE, 5) + 0.0::DOUBLE AS first FROM r JOIN r w ON w.label = 0 AND w.position = r.position WHERE r.position = r.label % 7",
    "e6_cache_misses": f"SELECT DISTINCT sha256('{E.spec_text(SPEC)}' || chr(0) || text) AS item_key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)",
    "e6_store": "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, CASE WHEN trim(t) = '' THEN 0 ELSE length(t) END::DOUBLE AS v0, CASE WHEN trim(t) = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) END::DOUBLE AS v1, CASE WHEN trim(t) = '' THEN 0 ELSE 1 END::DOUBLE AS v2, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN trim(t) = '' THEN 0 ELSE 2 END END::DOUBLE AS other FROM d",
    "e6_ledger": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT count(DISTINCT t) FILTER (doc_id % 3 = 0) AS a, count(DISTINCT t) AS b, count(DISTINCT t) FILTER (doc_id % 2 = 0) AS c FROM d)
      SELECT unnest([1, 2, 3, 4])::INT AS version, unnest(['append', 'append', 'append', 'compact']) AS kind, unnest([a, b - a, c, b + c])::BIGINT AS rows, unnest([1, 2, 3, 1])::INT AS parts, unnest([1, 1, 2, 0])::INT AS layer FROM n""",
    "e8_ordered_fingerprint": """WITH h AS (SELECT md5(doc_id || chr(31) || coalesce(lang, chr(0)) || chr(31) || n_chars) AS h, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r FROM documents),
      l AS (SELECT r // 1024 AS k, sha256(string_agg(h, '' ORDER BY r)) AS h, count(*) AS n FROM h GROUP BY r // 1024) SELECT sum(n)::BIGINT AS n, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS fingerprint FROM l""",
    "e7_miss_reasons": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'predates specs' WHEN doc_id % 3 > 0 THEN 'changed' WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'inputs changed' END AS reason, CASE WHEN doc_id % 7 = 0 THEN 'encoder,pooling,width' WHEN doc_id % 3 > 0 THEN 'width' ELSE '' END AS changed, CASE WHEN doc_id % 7 > 0 AND doc_id % 5 = 0 THEN 'layer' ELSE '' END AS removed, count(*) AS n FROM documents GROUP BY ALL",
    "e8_fingerprint": """WITH h AS (SELECT md5(doc_id || chr(31) || coalesce(lang, chr(0)) || chr(31) || n_chars) AS h FROM documents),
      b AS (SELECT ('0x' || substr(h, 1, 4))::INT % 256 AS b, count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT)::BIGINT AS a0, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS a1, sum(('0x' || substr(h, 17, 8))::BIGINT)::BIGINT AS a2, sum(('0x' || substr(h, 25, 8))::BIGINT)::BIGINT AS a3 FROM h GROUP BY 1)
      SELECT sum(n)::BIGINT AS n, sha256(array_to_string(list_sort(list(lpad(b::VARCHAR, 5, '0') || ':' || n || ':' || a0 || ':' || a1 || ':' || a2 || ':' || a3)), ',')) AS fingerprint FROM b""",
    "e9_finite_gate": "WITH v AS (SELECT CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda x: 'nan'::FLOAT) ELSE embedding END AS v FROM embeddings) SELECT 'finite' AS rule, count(*) FILTER (len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS n_bad FROM v",
    "f9_assembled": "WITH w AS (SELECT vec_id, list_concat(embedding[1:4], embedding) AS w FROM embeddings) SELECT vec_id, len(w)::INT AS width, w[5]::DOUBLE AS fifth FROM w",
    "m3_site_profile": _PROFILE + "SELECT position, token, n, round(logp, 9) AS logp FROM p",
    "m2_log_softmax": "WITH l AS (SELECT user_id, event_type, sum(round(value * 100)::BIGINT) / 10000 AS x FROM events GROUP BY ALL), m AS (SELECT *, max(x) OVER (PARTITION BY user_id) AS m FROM l) SELECT user_id, event_type, round(x - m - ln(sum(exp(x - m)) OVER (PARTITION BY user_id)), 9) AS logp FROM m",
    "m1_masked_marginals": _PROFILE + "SELECT event_id, round(v.logp - w.logp + c.logp - e.logp, 9) AS score FROM events x JOIN p v ON v.position = user_id AND v.token = 'view' JOIN p w ON w.position = user_id AND w.token = event_type JOIN p c ON c.position = user_id AND c.token = 'click' JOIN p e ON e.position = user_id AND e.token = 'error'",
    "m4_position_means": _POSITION + "SELECT o_orderkey, round(predicted, 4) AS predicted FROM q",
    "k7_mse": _POSITION + "SELECT o_orderstatus, round(avg((score - predicted) ** 2) / 1e6, 3) AS mse FROM q GROUP BY 1",
    "m10_zero_shot": _RANKED.format(g="o_orderstatus", rows="SELECT o_orderstatus, o_custkey % 13 AS x, round(o_totalprice, 2) AS y FROM orders WHERE o_orderkey % 4 = 0"),
    "k1_spearman_by": _RANKED.format(g="l_returnflag", rows="SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem"),
    "k1_spearman": "SELECT spearman, n FROM (" + _RANKED.format(g="z", rows="SELECT 1 AS z, l_quantity AS x, l_extendedprice AS y FROM lineitem") + ")",
    "m7_centroid_predictions": """WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i, vec_id % 5 = 0 AS test FROM embeddings), c AS (SELECT label AS l, i, avg(x) AS c FROM f WHERE NOT test GROUP BY ALL),
      d AS (SELECT vec_id, label, l, sum((x - c) * (x - c)) AS d FROM f JOIN c USING (i) WHERE test GROUP BY ALL) SELECT vec_id, any_value(label) AS label, arg_min(l, d) AS predicted FROM d GROUP BY vec_id""",
    "k2_confusion": _ONE + "SELECT label, tp, fp, fn, support FROM c",
    "k3_per_class": _ONE + "SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f",
    "k4_macro": _ONE + "SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 9) AS accuracy, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy FROM f",
    "k4_micro": _ONE + "SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 9) AS accuracy, round(sum(tp) / (sum(tp) + sum(fp)), 9) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 9) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS f1, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy FROM f",
    "a11_seed_spread": _RUNS + "SELECT arm, count(*) AS runs, round(avg(score), 9) AS score_mean, round(coalesce(stddev_samp(score), 0), 9) AS score_sd FROM bys GROUP BY arm",
    "a12_seed_matrix": _RUNS + 'SELECT arm, max(round(score, 9)) FILTER (seed = 1) AS "1", max(round(score, 9)) FILTER (seed = 2) AS "2", max(round(score, 9)) FILTER (seed = 3) AS "3" FROM bys GROUP BY arm',
    "a13_median": _RUNS + "SELECT arm, round(median(score), 9) AS median FROM runs GROUP BY arm",
    "a14_at_edge": _RUNS + "SELECT count(*) FILTER (n IN (0, 11)) AS at_edge, count(*) AS n FROM runs",
    "a15_curve": _RUNS + "SELECT assay, arm, n, round(mean, 9) AS mean, round(sd, 9) AS sd, runs, round(floor, 9) AS floor FROM curve",
    "a16_readouts": _RUNS + """SELECT seed, round(avg(score) FILTER (arm = 'A'), 9) AS "A", round(avg(score) FILTER (arm = 'N'), 9) AS "N", round(avg(score) FILTER (arm = 'R'), 9) AS "R" FROM runs GROUP BY seed""",
    "w5_best": _RUNS + "SELECT arm, seed, loss FROM (SELECT arm, seed, min(round(score, 1)) AS loss, row_number() OVER (PARTITION BY arm ORDER BY min(round(score, 1)), seed) AS k FROM runs GROUP BY arm, seed) WHERE k = 1",
    "c1_decomposition": _RUNS + ", s AS (SELECT arm || assay AS arm, avg(score) AS score FROM runs GROUP BY 1), w AS (SELECT max(score) FILTER (arm = 'AF') AS b, max(score) FILTER (arm = 'NF') AS a, max(score) FILTER (arm = 'NO') AS c, max(score) FILTER (arm = 'RF') AS g FROM s) SELECT round(g - b, 9) AS gain, round((g - c) / (g - b), 9) AS lost_by_volume, round((c - a) / (g - b), 9) AS lost_by_vocabulary, round((a - b) / (g - b), 9) AS surviving FROM w",
    "c2_class_gains": _TWO + "SELECT a.label, round(a.f1, 9) AS baseline, round(b.f1, 9) AS other, round(b.f1 - a.f1, 9) AS gain FROM f a JOIN f b USING (label) WHERE a.arm = 'a' AND b.arm = 'b'",
    "c3_paired": _RUNS + "SELECT seed, count(*) AS n, round(avg(delta), 9) AS mean_delta, round(avg((delta > 0)::INT), 9) AS win_share FROM pairs GROUP BY seed",
    "c4_signed_rank": _RUNS + """, k AS (SELECT assay, delta, abs(delta) AS a, row_number() OVER (PARTITION BY assay ORDER BY abs(delta)) AS k FROM pairs WHERE delta <> 0), r AS (SELECT *, avg(k) OVER (PARTITION BY assay, a) AS r, count(*) OVER (PARTITION BY assay, a) AS t FROM k),
      s AS (SELECT assay, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w, sum(t * t - 1) AS ties FROM r GROUP BY assay)
      SELECT assay, n, round(w, 9) AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48), 9) AS z FROM s""",
    "c4_signed_rank_test": _RUNS + """, q AS (SELECT assay, CASE WHEN n < 9 THEN seed ELSE 0 END AS seed, delta FROM pairs WHERE delta <> 0), k AS (SELECT *, abs(delta) AS a, row_number() OVER (PARTITION BY assay, seed ORDER BY abs(delta)) AS k FROM q),
      r AS (SELECT *, avg(k) OVER (PARTITION BY assay, seed, a) AS r, count(*) OVER (PARTITION BY assay, seed, a) AS t FROM k),
      s AS (SELECT assay, seed, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w, sum(t * t - 1) AS ties, max(t) = 1 AND count(*) <= 25 AS exact FROM r GROUP BY ALL), z AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) AS z FROM s),
      signs AS (SELECT x.assay, x.seed, m.m, list_sum(list_transform(range(1, x.n + 1), lambda i: CASE WHEN (m.m >> (i - 1)::INT) & 1 = 1 THEN i ELSE 0 END)) AS sum FROM s x, range(4194304) m(m) WHERE x.exact AND m.m < (1::BIGINT << x.n::INT)),
      e AS (SELECT s.assay, s.seed, least(1, 2 * least(count(*) FILTER (g.sum <= s.w), count(*) FILTER (g.sum >= s.w)) / count(*)) AS p FROM signs g JOIN s ON s.assay = g.assay AND s.seed = g.seed GROUP BY ALL),
      f AS (SELECT assay, seed, abs(z) / sqrt(2) AS x FROM z), i AS (SELECT unnest(range(1, 81)) AS i),
      o AS (SELECT f.assay, f.seed, any_value(CASE WHEN x < 3 THEN y ELSE NULL END) AS p FROM f LEFT JOIN (SELECT assay, seed, 1 - 2 / sqrt(pi()) * exp(-x * x) * (x + sum(t)) AS y FROM (SELECT assay, seed, x, i, x * exp(sum(ln(2 * x * x / (2 * i + 1))) OVER (PARTITION BY assay, seed ORDER BY i)) AS t FROM f, i) GROUP BY assay, seed, x) USING (assay, seed) GROUP BY ALL)
      SELECT z.assay, z.seed, z.n, round(z.w, 9) AS w_plus, round(z.z, 9) AS z, round(CASE WHEN z.exact THEN e.p ELSE o.p END, 9) AS p, z.exact FROM z LEFT JOIN e USING (assay, seed) LEFT JOIN o USING (assay, seed)""",
    "c6_signs": _RUNS + "SELECT seed, round(avg(delta), 9) AS mean_delta, bool_and(delta < 0) AS all_negative FROM pairs GROUP BY seed",
    "c7_crossover": _RUNS + "SELECT assay, arm, min(n) FILTER (mean > floor) AS crossover FROM curve GROUP BY ALL",
    "m8_all_arms": _ALL_ARMS,
    "m9_grid": """WITH a AS (SELECT s_name AS assay, row_number() OVER (ORDER BY s_name) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT s_name FROM supplier))
      SELECT u.rung, a.assay, s.scheme, r.readout, n.n::INT AS n, d.seed::INT AS seed, c.checkpoint, ((((((u.i * a.n + a.i) * 2 + s.i) * 3 + r.i) * 3 + n.i) * 2 + d.seed) * 2 + c.i)::BIGINT AS ordinal
      FROM (VALUES ('frozen', 0), ('ridge', 1)) u(rung, i), a, (VALUES ('random', 0), ('modulo', 1)) s(scheme, i), (VALUES ('mean', 0), ('at_position', 1), ('difference_at_position', 2)) r(readout, i),
      (VALUES (32, 0), (128, 1), (512, 2)) n(n, i), (VALUES (0), (1)) d(seed), (VALUES ('small', 0), ('large', 1)) c(checkpoint, i)""",
    "c5_bootstrap": _RUNS + """, s AS (SELECT n, sum(delta) AS s, count(*) AS c, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS k FROM pairs GROUP BY n),
      d AS (SELECT r.r, x.i AS place, x.k FROM s x, range(200) r(r)), m AS (SELECT d.r, sum(s.s) / sum(s.c) AS m FROM d JOIN s ON s.i = ('0x' || substr(md5('1:' || d.r || ':' || d.place), 1, 8))::BIGINT % d.k GROUP BY d.r)
      SELECT (SELECT round(sum(s) / sum(c), 9) FROM s) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""",
    "m8_arms": """WITH f AS (SELECT vec_id, label, embedding AS v FROM embeddings), seeds(seed) AS (VALUES (0), (1)),
      p AS (SELECT seed, vec_id, row_number() OVER (PARTITION BY seed ORDER BY vec_id) AS r FROM f, seeds), q AS (SELECT seed, vec_id AS other, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || vec_id), vec_id) AS r FROM f, seeds),
      x AS (SELECT 'whole' AS arm, seed, vec_id, v FROM f, seeds UNION ALL SELECT 'half', seed, vec_id, v[1:32] FROM f, seeds UNION ALL SELECT 'control', p.seed, p.vec_id, list_concat(a.v[1:32], b.v) FROM p JOIN q USING (seed, r) JOIN f a ON a.vec_id = p.vec_id JOIN f b ON b.vec_id = q.other
        UNION ALL SELECT 'redrawn', seed, vec_id, v[1 + 8 * seed:8 + 8 * seed] FROM f, seeds),
      e AS (SELECT arm, seed, x.vec_id, f.label, unnest(x.v)::DOUBLE AS x, unnest(range(len(x.v))) AS i, ('0x' || substr(md5(seed || ':' || x.vec_id), 1, 13))::BIGINT / 4503599627370496.0 >= 0.7 AS test FROM x JOIN f USING (vec_id)),
      c AS (SELECT arm, seed, label AS l, i, avg(x) AS c FROM e WHERE NOT test GROUP BY ALL), d AS (SELECT arm, seed, vec_id, label, l, sum((x - c) * (x - c)) AS d FROM e JOIN c USING (arm, seed, i) WHERE test GROUP BY ALL),
      s AS (SELECT arm, seed, vec_id, any_value(label) AS t, arg_min(l, d) AS p FROM d GROUP BY ALL), u AS (SELECT arm, seed, t AS l FROM s UNION SELECT arm, seed, p FROM s),
      k AS (SELECT u.arm, u.seed, u.l, count(*) FILTER (t = l AND p = l) AS tp, count(*) FILTER (t <> l AND p = l) AS fp, count(*) FILTER (t = l AND p <> l) AS fn, count(*) FILTER (t = l) AS support FROM u JOIN s ON s.arm = u.arm AND s.seed = u.seed GROUP BY ALL)
      SELECT arm, seed, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 9) AS accuracy, round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 9) AS precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 9) AS recall,
        round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS f1, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)) FILTER (support > 0), 9) AS balanced_accuracy FROM k GROUP BY ALL""",
    "e1_text_features": "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, 64 AS width, CASE WHEN len(w) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, len(w) = 0 AS blank FROM w",
    "s9_shards": _RUNS + "SELECT arm, seed, round(score, 9) AS score FROM bys",
    "s9_published": _RUNS + "SELECT arm, seed, round(score, 9) AS score FROM bys",
    "z1_singles_to_multiples": "SELECT CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM events WHERE event_id % 89 <> 0 GROUP BY 1",
    "z2_additivity": """WITH d AS (SELECT 'v' || (o_orderkey - 1) || ':v' || (o_orderkey // 2) AS variant, o_totalprice AS score, o_orderkey - 1 AS a, o_orderkey // 2 AS b FROM orders WHERE o_orderkey % 2 = 1),
      s AS (SELECT o_orderkey AS k, o_totalprice AS score FROM orders WHERE o_orderkey % 2 = 0) SELECT d.variant, round(d.score - (x.score + y.score), 2) AS residual FROM d LEFT JOIN s x ON x.k = a LEFT JOIN s y ON y.k = b""",
}
SQL["e5_colocated"] = SQL["e5_difference"]
