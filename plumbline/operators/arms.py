"""All arms and seeds from one wide table: feature blocks side by side, statistics of all of them in one pass, arms from their parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from .fits import MEANS, PENALTIES, checked_arms, class_means
from .gates import GateError
from .metrics import classification
from .normal import each_matrix, ridge_solutions, summed_products
from .splits import shuffled_pairs

PLAIN, SHUFFLED, REDRAWN = "plain", "shuffled", "redrawn"
#: Bytes of weights that travel to the tasks at most.
WEIGHTS = 256 << 20


def _used(arm: dict) -> list[tuple[str, str]]:
    """The blocks of an arm in their order, each with what is done to it."""
    done = lambda name: SHUFFLED if name in (arm.get("shuffle") or []) else REDRAWN if name in (arm.get("redrawn") or []) else PLAIN
    return [(name, done(name)) for name in arm["blocks"]]


def wide_table(arms: list[dict], blocks: dict, split: Callable[[int], DataFrame], key: str, label: str, seeds: list[int]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The written table key, label, seed, role, v0, v1, ... of every block in every form that an arm uses, and these forms.

    Each block is read once; all tables are joined on the key, so that each is shuffled once whatever the number of arms.
    A key without one of the blocks is an error.
    """
    forms = list(dict.fromkeys(f for a in checked_arms(arms, blocks) for f in _used(a)))
    made: dict[tuple[str, str, int | None], DataFrame] = {}
    for name, done in forms:
        for seed in [None] if done == PLAIN else seeds:
            block = blocks[name]
            block = block(seed if done == REDRAWN else 0) if callable(block) else block
            made[name, done, seed] = (shuffled_pairs(block, key, "vec", seed) if done == SHUFFLED else block).select(key, "vec")
    column = {which: f"_b{k}" for k, which in enumerate(made)}
    sides = [df.withColumnRenamed("vec", column[which]) for which, df in made.items()]
    roles = [split(s).select(key, F.col(label).alias(f"_l{k}"), F.col("role").alias(f"_r{k}")) for k, s in enumerate(seeds)]
    whole = reduce(lambda a, b: a.join(b, key, "left"), [*roles, *sides])
    lack = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in column.values()])
    of_seed = lambda k, s: F.struct(F.col(f"_l{k}").alias(label), F.lit(s).alias("seed"), F.col(f"_r{k}").alias("role"), *[F.col(column[n, d, None if d == PLAIN else s]).cast("array<double>").alias(f"v{i}") for i, (n, d) in enumerate(forms)])
    each = F.array(*[of_seed(k, s) for k, s in enumerate(seeds)])
    checked = F.when(lack, F.raise_error(F.lit("a key lacks a block"))).otherwise(each)
    return cut(whole.select(key, F.inline(checked)), "arms"), forms


def _metrics(judged: DataFrame, label: str) -> DataFrame:
    return classification(judged, label, "predicted", by=["arm", "seed"])


def centroid_arms(arms: list[dict], blocks: dict, split: Callable[[int], DataFrame], key: str, label: str, seeds: list[int]) -> DataFrame:
    """arm, seed and metrics of the nearest class mean for every arm and seed, in a fixed number of jobs.

    The squared distance to a class is the sum of those in the blocks. So each block in each form is compared with the
    class means once, and arms add up what their blocks gave; ties go to the smaller label. Means of more than MEANS
    numbers a seed are an error.
    """
    rows, forms = wide_table(arms, blocks, split, key, label, seeds)
    names = [f"v{i}" for i in range(len(forms))]
    means = cut(class_means(rows.where("role = 'train'"), ["seed", label], names), "means")
    numbers = F.expr(" + ".join(f"cast(size({c}) as long)" for c in names))
    if (most := means.groupBy("seed").agg(F.sum(numbers).alias("n")).agg(F.max("n")).first()[0] or 0) > MEANS:
        raise GateError(f"{most} numbers of class means are more than {MEANS}")
    packed = means.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), *names))).alias("_all"))
    near = lambda c: F.transform("_all", lambda s: F.aggregate(F.zip_with(c, s[c], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, d: t + d)).alias(f"d{c[1:]}")
    # a generator keeps the distances from being worked out again for every arm
    far = F.explode(F.array(F.struct(F.transform("_all", lambda s: s["l"]).alias("l"), *[near(c) for c in names]))).alias("_d")
    judged = rows.where("role <> 'train'").join(F.broadcast(packed), "seed").select("seed", label, far)

    def said(arm: dict) -> Column:
        parts = [F.col(f"_d.d{forms.index(f)}") for f in _used(arm)]
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
        return F.struct(F.lit(arm["name"]).alias("arm"), F.array_min(F.zip_with(total, "_d.l", lambda d, at: F.struct(d.alias("d"), at.alias("l"))))["l"].alias("predicted"))

    return _metrics(judged.select("seed", label, F.inline(F.array(*[said(a) for a in arms]))), label)


def ridge_arms(arms: list[dict], blocks: dict, split: Callable[[int], DataFrame], key: str, label: str, seeds: list[int], penalties: tuple[float, ...] = PENALTIES) -> DataFrame:
    """arm, seed, penalty and metrics of a linear head for every arm and seed, chosen on validation rows, from one matrix a seed.

    The head is a ridge regression on the classes, one column each; the class with the highest value is predicted, the
    first of equals in the order of labels. Summed products are taken once over all blocks side by side; an arm's normal
    equations are the part of its blocks. The penalty with the fewest validation errors wins, the first of equals.
    Classes are those of the training rows.
    """
    rows, forms = wide_table(arms, blocks, split, key, label, seeds)
    names = [f"v{i}" for i in range(len(forms))]
    labels = [r[0] for r in rows.where("role = 'train'").select(label).distinct().orderBy(label).limit(MEANS + 1).collect()]
    if len(labels) > MEANS:
        raise GateError(f"more than {MEANS} classes")
    widths = list(rows.select(*[F.size(c) for c in names]).first() or [0] * len(names))
    starts = np.cumsum([1, *widths])
    targets = np.arange(starts[-1], starts[-1] + len(labels))
    columns = {a["name"]: np.concatenate([np.arange(starts[i], starts[i + 1]) for i in (forms.index(f) for f in _used(a))]) for a in arms}
    if (size := 8 * len(seeds) * len(penalties) * len(labels) * sum(map(len, columns.values()))) > WEIGHTS:
        raise GateError(f"weights of {size} bytes are more than {WEIGHTS}")
    one_hot = F.transform(F.array(*[F.lit(v) for v in labels]), lambda v: (v == F.col(label)).cast("double"))
    values = F.concat(F.array(F.lit(1.0)), *names, one_hot)

    def solved(m: np.ndarray) -> list[list]:
        out = []
        for name, own in columns.items():
            for k, (first, w) in enumerate(ridge_solutions(m, own, targets, penalties)):
                out.append([name, k, np.vstack([first, w]).tobytes()])
        return out

    sums = summed_products(rows.where("role = 'train'").select("seed", values.alias("_v")), ["seed"], "_v")
    fits = cut(each_matrix(sums, ["seed"], solved, "arm string, k int, weights binary"), "heads")

    def judge(part: DataFrame, heads: dict[int, list[tuple[str, int, np.ndarray]]], schema: str) -> DataFrame:
        """Counts of (arm, seed, k, truth, prediction) in the tasks' batches."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for seed, g in frame.groupby("seed"):
                    x = np.stack(g["_v"].to_numpy())
                    for arm, k, w in heads.get(int(seed), []):
                        said = (x[:, columns[arm]] @ w[1:] + w[0]).argmax(1)
                        counts = pd.DataFrame({"t": g["_t"].to_numpy(), "p": said}).value_counts(dropna=False).reset_index(name="n")
                        yield pd.DataFrame({"arm": arm, "seed": int(seed), "k": k, "_t": counts["t"], "_p": counts["p"], "n": counts["n"]})

        place = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1  # -1: a class without training rows
        dealt = part.select("seed", F.coalesce(place, F.lit(-1)).cast("long").alias("_t"), F.concat(F.array(F.lit(1.0)), *names).alias("_v"))
        return dealt.mapInPandas(run, schema).groupBy("arm", "seed", "k", "_t", "_p").agg(F.sum("n").alias("n"))

    schema = "arm string, seed int, k int, _t long, _p long, n long"
    height = {name: len(own) + 1 for name, own in columns.items()}
    heads: dict[int, list[tuple[str, int, np.ndarray]]] = {}
    for r in fits.orderBy("seed", "arm", "k").toLocalIterator():  # WEIGHTS at most
        heads.setdefault(r.seed, []).append((r.arm, r.k, np.frombuffer(r.weights).reshape(height[r.arm], len(labels))))
    wrong = judge(rows.where("role = 'val'"), heads, schema).groupBy("arm", "seed", "k").agg((F.sum(F.when(F.col("_t") != F.col("_p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("loss"))
    best = {(r.arm, r.seed): r.k for r in wrong.groupBy("arm", "seed").agg(F.min_by("k", F.struct("loss", "k")).alias("k")).collect()}
    chosen = {s: [(a, k, w) for a, k, w in own if best.get((a, s), 0) == k] for s, own in heads.items()}
    counts = cut(judge(rows.where("role = 'test'"), chosen, schema), "judged")
    # -1 on either side is a class of its own name: the truth's labels that were not trained on count as missed
    metrics = classification(counts, "_t", "_p", by=["arm", "seed"], weight="n")
    penalty = F.element_at(F.array(*[F.lit(p) for p in penalties]), F.col("k") + 1)
    settled = counts.select("arm", "seed", "k").distinct().select("arm", "seed", penalty.alias("penalty"))
    return settled.join(metrics, ["arm", "seed"])
