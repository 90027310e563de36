"""Simple models over grids of configurations: ridge with a chosen penalty, heads on frozen features, arms."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import global_rank
from ..functions.shared import cut
from .features import assembled
from .gates import GateError
from .metrics import classification, spearman_by
from .normal import each_matrix, ridge_solutions, summed_products, with_ones
from .splits import shuffled_pairs

PENALTIES = tuple(10.0**k for k in range(-2, 9))


def best_by_validation(candidates: DataFrame, by: list[str], loss: str, ordinal: str) -> DataFrame:
    """The candidate with the least loss of each group; the first of equals wins."""
    return candidates.groupBy(*by).agg(F.min_by(F.struct(*candidates.columns), F.struct(loss, ordinal)).alias("_c")).select("_c.*")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def ridge_weights(rows: DataFrame, by: list[str], penalties: tuple[float, ...] = PENALTIES) -> DataFrame:
    """by, n_train, fits: array<struct<k, penalty, intercept, weights>> from the training rows (by, vec, y) of each configuration.

    Configurations of any number and width are fitted together from blocks of summed products; see ``normal``.
    """

    def solved(m: np.ndarray) -> list[list]:
        fits = [{"k": k, "penalty": p, "intercept": float(i[0]), "weights": w[:, 0].tolist()} for k, (p, (i, w)) in enumerate(zip(penalties, ridge_solutions(m, np.arange(1, len(m) - 1), np.array([len(m) - 1]), penalties), strict=True))]
        return [[int(round(m[0, 0])), fits]]

    sums = summed_products(rows.select(*by, with_ones("vec", "y").alias("_v")), by, "_v")
    return each_matrix(sums, by, solved, "n_train long, fits array<struct<k:int,penalty:double,intercept:double,weights:array<double>>>")


#: Bytes of weights that are broadcast to the rows at most, and copies of them that meet salted rows beyond that.
WEIGHTS, COPIES = 32 << 20, 64


def _met(rows: DataFrame, weights: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``weights`` (a written table, its bytes told by ``size``): broadcast where they are few, else each configuration's rows are dealt to COPIES tasks."""
    if (weights.agg(F.sum(F.expr(size))).first()[0] or 0) <= WEIGHTS:
        return rows.join(F.broadcast(weights), on)
    copies = weights.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn("_copy", F.pmod(F.xxhash64("vec", "y"), F.lit(COPIES)).cast("int")).join(copies, [*on, "_copy"]).drop("_copy")


def ridge_grid(rows: DataFrame, by: list[str], penalties: tuple[float, ...] = PENALTIES, held: DataFrame | None = None) -> DataFrame:
    """by, penalty, val_mse, spearman, n_train, n_test for each configuration of rows (by, role, vec, y).

    ``held`` gives validation and test rows (role, vec, y and some of ``by``) that serve all configurations with these
    values, so that they need no copy for each. The penalty with the least validation error wins, the first of equals.
    Rows are scored where they are, with the weights of their configurations. A constant side gives a null correlation.
    """
    held = rows if held is None else held
    on = [c for c in by if c in held.columns]
    fits = cut(ridge_weights(rows.where("role = 'train'"), by, penalties), "fits")
    predicted = (_dot("vec", "_f.weights") + F.col("_f.intercept")).alias("said")

    def scored(role: str, weights: DataFrame, size: str) -> DataFrame:
        own = held.where(F.col("role") == role).select(*on, F.col("vec").cast("array<double>").alias("vec"), F.col("y").cast("double").alias("y"))
        return _met(own, weights, on, size)

    tried = scored("val", fits.drop("n_train"), "8L * size(fits) * size(fits[0].weights)").select(*by, "vec", "y", F.explode("fits").alias("_f"))
    losses = tried.select(*by, F.col("_f.k").alias("k"), F.pow(predicted - F.col("y"), 2).alias("_e")).groupBy(*by, "k").agg(F.avg("_e").alias("val_mse"))
    best = cut(best_by_validation(losses, by, "val_mse", "k"), "best")
    chosen = cut(fits.join(best, by).select(*by, "n_train", "val_mse", F.get("fits", F.col("k")).alias("_f")), "chosen")
    test = cut(scored("test", chosen.select(*by, "_f"), "8L * size(_f.weights)").select(*by, "y", predicted), "scored")
    out = chosen.select(*by, F.col("_f.penalty").alias("penalty"), "val_mse", "n_train").join(spearman_by(test, by, "said", "y", "n_test"), by, "left")
    return out.select(*by, "penalty", "val_mse", "spearman", "n_train", F.coalesce("n_test", F.lit(0)).alias("n_test"))


def ridge(train: DataFrame, features: str, y: str, penalty: float):
    """One large ridge fit on standardised features: ``penalty`` is that of the sum of squares, as in a closed form."""
    n, sd = train.agg(F.count("*"), F.stddev_pop(y)).first()
    if not n or not sd:
        raise GateError("no rows, or a constant target")
    vectors = train.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    return LinearRegression(featuresCol="_x", labelCol=y, solver="normal", standardization=False, regParam=penalty * sd / n).fit(vectors)


def head(train: DataFrame, val: DataFrame, features: str, y: str, classes: int | None, seed: int, penalties: tuple[float, ...] = (1e-4, 1e-2), budgets: tuple[int, ...] = (20, 60), hidden: int | None = None):
    """A head on frozen features, the best on validation over penalties (or, with ``hidden`` units, budgets): (model, loss, settings).

    Classification minimises the validation error, regression (``classes`` None) the mean squared error; the first of
    equal candidates wins.
    """
    as_vector = lambda df: df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>"))).withColumn("_y", F.col(y).cast("double"))
    train, val = as_vector(train).cache(), as_vector(val).cache()
    width = train.select(F.size(features)).first()[0]
    made: list[tuple[Callable, tuple]] = []
    if classes is None:
        made = [(lambda p=p: LinearRegression(featuresCol="_x", labelCol="_y", regParam=p, maxIter=100), (p,)) for p in penalties]
    elif hidden:
        made = [(lambda b=b: MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", layers=[width, hidden, classes], maxIter=b, seed=seed), (b,)) for b in budgets]
    else:
        made = [(lambda p=p: LogisticRegression(featuresCol="_x", labelCol="_y", regParam=p, maxIter=100), (p,)) for p in penalties]
    best = None
    for build, settings in made:
        model = build().fit(train)
        wrong = F.pow(F.col("prediction") - F.col("_y"), 2) if classes is None else (F.col("prediction") != F.col("_y")).cast("double")
        loss = model.transform(val).agg(F.avg(wrong)).first()[0]
        if best is None or loss < best[1]:
            best = (model, loss, settings)
    train.unpersist()
    val.unpersist()
    return best


def predictions(model, df: DataFrame, features: str) -> DataFrame:
    return model.transform(df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))).drop("_x")


#: Numbers of class means that one row broadcasts at most.
MEANS = 1 << 22


def _squared(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def class_means(df: DataFrame, by: list[str], vectors: list[str]) -> DataFrame:
    """by, and the mean of each of the vectors, summed map-side."""
    wide = lambda c: array_to_vector(F.col(c).cast("array<double>"))
    return df.groupBy(*by).agg(*[vector_to_array(Summarizer.mean(wide(c))).alias(c) for c in vectors])


def nearest_centroid(df: DataFrame, key: str, label: str, features: str, role: str = "role") -> DataFrame:
    """key, label, predicted for rows that are not training: the class whose mean training vector is nearest; ties to the smaller label.

    All means travel in one row of at most MEANS numbers, and rows are judged where they are; more classes come in
    several such rows, whose nearest ones are compared by key.
    """
    means = cut(class_means(df.where(F.col(role) == "train").select(F.col(label).alias("_l"), F.col(features).alias("_c")), ["_l"], ["_c"]), "means")
    numbers = means.agg(F.sum(F.size("_c").cast("long"))).first()[0] or 0
    parts = -(-numbers // MEANS)
    dealt = means.withColumn("_part", F.pmod(F.xxhash64("_l"), F.lit(max(1, 2 * parts if parts > 1 else 1))))
    packed = dealt.groupBy("_part").agg(F.collect_list(F.struct("_l", "_c")).alias("_all")).drop("_part")
    near = F.array_min(F.transform("_all", lambda s: F.struct(_squared(features, s["_c"]).alias("d"), s["_l"].alias("l"))))
    judged = df.where(F.col(role) != "train").join(F.broadcast(packed) if parts <= 1 else packed).select(key, label, near.alias("_n"))
    if parts > 1:
        judged = judged.groupBy(key).agg(F.first(label).alias(label), F.min("_n").alias("_n"))
    return judged.select(key, label, F.col("_n.l").alias("predicted"))


def checked_arms(arms: list[dict], blocks: dict) -> list[dict]:
    """Arms (name, blocks, shuffle, redrawn): unique names, known blocks, none both shuffled and redrawn.

    ``shuffle`` and ``redrawn`` list blocks of the arm; a redrawn one must be given as a function of the seed.
    """
    names = [a["name"] for a in arms]
    if len(set(names)) < len(names):
        raise GateError("two arms share a name")
    for a in arms:
        shuffle, redrawn = a.get("shuffle") or [], a.get("redrawn") or []
        if lack := {*a["blocks"], *shuffle, *redrawn} - set(blocks):
            raise GateError(f"arm {a['name']} has no block {sorted(lack)}")
        if shuffle and redrawn:
            raise GateError(f"arm {a['name']} is both shuffled and redrawn")
        if stray := {*shuffle, *redrawn} - set(a["blocks"]):
            raise GateError(f"arm {a['name']} does not use {sorted(stray)}")
        if fixed := [b for b in redrawn if not callable(blocks[b])]:
            raise GateError(f"blocks {fixed} are not drawn by seed")
    return arms


def arm_features(arm: dict, blocks: dict, key: str, seed: int) -> DataFrame:
    """key, vec of an arm under a seed: its blocks side by side, shuffled ones dealt to other keys, redrawn ones of that seed.

    A shuffled block is permuted over the whole table, not within a split; without the flag a block that is a function
    is drawn for seed 0, whatever the seed of the fit.
    """
    made = {}
    for name in arm["blocks"]:
        block = blocks[name]
        block = block(seed if name in (arm.get("redrawn") or []) else 0) if callable(block) else block
        made[name] = shuffled_pairs(block, key, "vec", seed).select(key, "vec") if name in (arm.get("shuffle") or []) else block
    return assembled(made, arm["blocks"], key)


def centroid_fit(rows: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    return nearest_centroid(rows, key, label, "vec")


def head_fit(rows: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """key, label, predicted on test rows by the head that is best on validation rows."""
    train, val = rows.where("role = 'train'"), rows.where("role = 'val'")
    classes = train.agg(F.count_distinct(label)).first()[0]
    codes = train.select(label).distinct()
    coded = global_rank(codes, [label], "_y").withColumnRenamed(label, "_label")
    with_code = lambda df: df.join(coded, F.col(label) == F.col("_label")).drop("_label")
    model, _, _ = head(with_code(train), with_code(val), "vec", "_y", classes, seed)
    said = predictions(model, rows.where("role = 'test'"), "vec").select(key, label, F.col("prediction").cast("long").alias("_y"))
    return said.join(coded, "_y", "left").select(key, label, F.col("_label").alias("predicted"))


def run_arms(arms: list[dict], blocks: dict, split: Callable[[int], DataFrame], key: str, label: str, seeds: list[int], fit: Callable = centroid_fit) -> DataFrame:
    """arm, seed and metrics of the same fit for every arm on the same splits: only the blocks differ.

    ``blocks`` are tables (key, vec) or functions of a seed that give one; ``fit(rows, key, label, seed)`` gives key, label and
    predicted of rows (key, label, role, vec) that are not training.
    """
    out = None
    for a in checked_arms(arms, blocks):
        for seed in seeds:
            rows = split(seed).join(arm_features(a, blocks, key, seed), key)
            got = classification(fit(rows, key, label, seed), label, "predicted").withColumn("arm", F.lit(a["name"])).withColumn("seed", F.lit(seed))
            out = got if out is None else out.unionByName(got)
    return out
