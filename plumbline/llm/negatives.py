"""Hard negatives for embeddings by anchor-clustered shared lists (operator 12).

Anchors are clustered by angle: centroids are fitted on at most ``SAMPLE`` of them and every anchor goes to the nearest
one. A block of rows is put in order once for each cluster, by a bound that holds for all its members: a row whose angle
to the centroid is ``t`` has a score of at most its length times the cosine of ``t - spread``, for any anchor of length
one within ``spread`` of the centroid. The members walk this shared list together, a chunk at a time; a member stops when
its length times the bound of what is left can neither reach the last of its results so far nor the least score that it
may return. Scores are exact integers; bounds are floats with an allowance for rounding, so that stopping is certain.

Every row is in the lists. Tasks read their rows block by block and keep only the best results so far; anchors travel to
them in blocks of at most ``ANCHORS``, each of which is met with all rows: a stated set of queries against all rows. The
results of the tasks, bounded by anchors times results, are merged by ranking windows. A first walk finds the positives,
a second one, which knows their scores, the negatives between two shares of each.

Rows with a null vec_id or label, or a vector that is null, empty or has a null or non-finite component, take no part.
Only vectors of equal length meet. A row is an anchor's own if it has its vec_id; if several rows have the vec_id of an
anchor, the one with the smallest label and vector is the anchor. Other rows count one by one, repeated or not. Ties go
to the smaller vec_id. A positive with a negative score has no negatives; one with score 0 only those with score 0.
Components so large that a score would leave the range of exact doubles are worked out in whole numbers of any length and
scores beyond 64 bits are cut to its ends. An empty table gives no rows. Other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import global_rank
from .common import cut, small_batches, table

#: Anchors that one walk over the rows takes along, anchors that the centroids are fitted on, rows of a list that are scored at once.
ANCHORS, SAMPLE, CHUNK = 4096, 8192, 512
#: About so many anchors share a list.
MEMBERS = 16
POSITIVES, NEGATIVES = 5, 10
#: Hundredths of the positive's score between which a hard negative's score lies.
LEAST, MOST = 30, 90
_LONG = (1 << 63) - 1


class Anchors(NamedTuple):
    """Anchors of one vector length, in the order of their clusters."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    cluster: np.ndarray
    centres: np.ndarray
    spread: np.ndarray
    floors: list[list[int]]  #: for each anchor the scores of its positives; empty in the first walk


def usable(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label and the whole-number vector of the rows that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    own = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    own = own.where((F.size("embedding") > 0) & finite)
    named = (F.col("label") if label is None else label).cast("int")
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), named.alias("label"), whole.alias("vector"))


def _matrix(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors: where they stand and their matrix, of exact doubles or of Python's whole numbers."""
    flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
    lengths = np.diff(offsets)
    out = []
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        own = flat[(offsets[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)
        out.append((at, own))
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two whole-number matrices."""
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] if a.size and b.size else 0.0
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(float)
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def centroids(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions by rounds of spherical k-means from evenly spaced rows."""
    unit, _ = _unit(vectors)
    centres = unit[np.linspace(0, len(unit) - 1, k).round().astype(int)]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        made, norm = _unit(sums)
        centres = np.where(norm[:, None] > 1e-9, made, centres)
    return centres


def _grouped(rows: pa.Table, floors: dict[int, list[int]] | None) -> list[Anchors]:
    """The anchors of a block by vector length, clustered."""
    out = []
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    if not len(ids):
        return out
    for at, own in _matrix(rows["vector"].combine_chunks()):
        few = own[:: max(1, -(-len(own) // SAMPLE))]
        centres = centroids(few, max(1, min(len(few), -(-len(own) // MEMBERS))))
        unit, norm = _unit(own)
        cos = unit @ centres.T
        nearest = cos.argmax(1)
        angle = np.where(norm > 0, np.arccos(np.clip(cos[np.arange(len(own)), nearest], -1, 1)), 0.0)
        spread = np.zeros(len(centres))
        np.maximum.at(spread, nearest, angle)
        order = np.argsort(nearest, kind="stable")
        told = [floors.get(int(i), []) if floors is not None else [] for i in ids[at][order]]
        out.append(Anchors(ids[at][order], labels[at][order], own[order], nearest[order], centres, spread, told))
    return out


class _Best:
    """The first ``k`` results: highest score first, ties by smaller id."""

    __slots__ = ("ids", "k", "least", "scores")

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least, self.scores, self.ids = k, least, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def _lists(anchors: Anchors, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each cluster: its members, the rows by falling bound, and the bounds for an anchor of length one."""
    unit, norm = _unit(vectors)
    cos = np.clip(unit @ anchors.centres.T, -1, 1)
    for c in range(len(anchors.centres)):
        members = np.flatnonzero(anchors.cluster == c)
        if len(members):
            angle = np.maximum(np.arccos(cos[:, c]) - anchors.spread[c] - 1e-6, 0)
            bound = norm * np.cos(angle) + 1e-6 * norm
            order = np.argsort(-bound, kind="stable")
            yield members, order, bound[order]


def _walk(anchors: Anchors, best: list, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, meet) -> None:
    """Let every anchor walk its cluster's list of these rows; ``meet`` takes an anchor and what it is to compare, and gives the score it still looks for."""
    _, length = _unit(anchors.vectors)
    for members, order, bound in _lists(anchors, vectors):
        needs = np.array([min((b.least for b in best[m]), default=_LONG) for m in members], float)
        for at in range(0, len(order), CHUNK):
            # an allowance for the rounding of long sums
            open_ = length[members] * bound[at] * (1 + 1e-9) + 1e-3 >= needs
            members, needs = members[open_], needs[open_]
            if not len(members):
                break
            rows = order[at : at + CHUNK]
            scores = _exact(anchors.vectors[members], vectors[rows])
            for k, m in enumerate(members):
                meet(m, scores[k], ids[rows], labels[rows])
                needs[k] = min((b.least for b in best[m]), default=_LONG)


def _positives(anchors: Anchors, best: list[list[_Best]]):
    def meet(m: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        own = best[m][0]
        keep = (labels == anchors.labels[m]) & (ids != anchors.ids[m]) & (scores >= own.least)
        if keep.any():
            own.add(scores[keep], ids[keep])

    return meet


def _negatives(anchors: Anchors, best: list[list[_Best]]):
    limits = [[(-(-LEAST * s // 100), MOST * s // 100) for s in own] for own in anchors.floors]

    def meet(m: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        others = labels != anchors.labels[m]
        scores, ids = scores[others], ids[others]
        for own, (_, most) in zip(best[m], limits[m], strict=True):
            keep = (scores <= most) & (scores >= own.least)
            if keep.any():
                own.add(scores[keep], ids[keep])

    return meet


def _walked(rows: DataFrame, groups: list[Anchors], first: bool) -> DataFrame:
    """anchor_id, place (of the positive), id, score: the best results of every task."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = []
        for g in groups:
            if first:
                best = [[_Best(POSITIVES, -_LONG - 1)] for _ in g.ids]
                state.append((g, best, _positives(g, best)))
            else:
                best = [[_Best(NEGATIVES, -(-LEAST * s // 100)) for s in own] for own in g.floors]
                state.append((g, best, _negatives(g, best)))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, vectors in _matrix(batch.column(2)):
                for g, best, meet in state:
                    if g.vectors.shape[1] == vectors.shape[1]:
                        _walk(g, best, ids[at], labels[at], vectors, meet)
        for g, best, _ in state:
            found = [(m, place, b) for m, own in enumerate(best) for place, b in enumerate(own) if len(b.ids)]
            if found:
                times = [len(b.ids) for _, _, b in found]
                columns = [np.repeat(g.ids[[m for m, _, _ in found]], times), np.repeat([p for _, p, _ in found], times).astype(np.int32)]
                columns += [np.concatenate([getattr(b, c) for _, _, b in found]) for c in ("ids", "scores")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "place", "id", "score"])

    return rows.mapInArrow(run, "anchor_id long, place int, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``anchors`` among ``rows``, both of :func:`usable` rows.

    The first ``POSITIVES`` other rows of an anchor's label are its positives; for each, the first ``NEGATIVES`` rows of
    other labels whose scores lie between LEAST and MOST hundredths of the positive's are its hard negatives.
    """
    spark = rows.sparkSession
    one = cut(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select("vec_id", "a.label", "a.vector"), "anchors")
    n = one.count()
    blocks = max(1, -(-n // ANCHORS))
    dealt = one.withColumn("block", F.lit(0)) if blocks == 1 else global_rank(one, ["vec_id"]).withColumn("block", F.expr(f"int(rank div {ANCHORS})"))
    parts = []
    for block in range(blocks if n else 0):
        own = dealt.where(F.col("block") == block).select("vec_id", "label", "vector").orderBy("vec_id").toArrow()  # ANCHORS at most
        positives = _top(_walked(rows, _grouped(own, None), first=True), POSITIVES)
        known = cut(positives.select("anchor_id", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        floors: dict[int, list[int]] = {}
        for a, s in zip(*(known.orderBy("anchor_id", "rank").toArrow()[c].to_pylist() for c in ("anchor_id", "positive_score")), strict=True):
            floors.setdefault(a, []).append(s)  # POSITIVES an anchor at most
        negatives = _top(_walked(rows, _grouped(own, floors), first=False), NEGATIVES)
        named = known.select("anchor_id", (F.col("rank") - 1).alias("place"), "positive_id", "positive_score")
        parts.append(negatives.join(named, ["anchor_id", "place"]))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(table(spark, sf_dir, "embeddings"), label)
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


OP12_SQL = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as vec
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.vec, b.vec)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positive as (
  select anchor_id, id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES}),
met as (
  select anchor_id, positive_id, id as negative_id, positive_score, score as negative_score,
    row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank
  from positive join pairs using (anchor_id)
  where not same and {LEAST} * positive_score <= 100 * score and 100 * score <= {MOST} * positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from met where rank <= {NEGATIVES}
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
SQL = {"op12_hard_negatives": OP12_SQL}
