import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import quality as Q
from plumbline.llm.common import utf8
from plumbline.llm.quality import KEEP, keep_good, pooled, score_documents

SF = "/root/testdata/sf0.1"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.floats(0, 1)), min_size=1, max_size=12))
def test_pooled_by_brute_force(cells):
    """The isotonic regression at a bin is the greatest of the least means over the runs that hold it."""
    total = np.array([n for n, _ in cells], float)
    positive = np.array([round(n * p) for n, p in cells], float)
    steps = pooled(total, positive)
    assert (np.diff(steps) >= 0).all() and ((steps > 0) & (steps < 1)).all()
    filled = np.flatnonzero(total)
    for i in filled:
        mean = lambda a, b: (positive[a : b + 1].sum() + 0.5 * (k := ((filled >= a) & (filled <= b)).sum() / len(filled))) / (total[a : b + 1].sum() + k)
        assert abs(steps[i] - max(min(mean(a, b) for b in filled if b >= i) for a in filled if a <= i)) < 1e-9


def test_scores_by_brute_force(spark):
    """The model from plain normal equations over all rows at once, and each training row scored by the other folds."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["Word", "other", "x|y", "!!"], rng.integers(1, 60))), int(rng.integers(0, 2))) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    stats = Q.statistics_of(*utf8(pa.array([t for _, t, _ in rows])))
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in rows])
    y = np.array([y for *_, y in rows], float)
    mean, sd = stats[train].mean(0), stats[train].std(0)
    sd[sd < 1e-6] = 1
    z, fold = Q.fourier(stats, mean, sd), Q._fold(stats)

    def weights(at):
        return np.linalg.solve(z[at].T @ z[at] + Q.RIDGE * np.eye(z.shape[1]), z[at].T @ y[at])

    unseen = np.zeros(len(rows))
    for k in range(Q.FOLDS):
        unseen[fold == k] = z[fold == k] @ weights(train & (fold != k))
    at = np.clip(np.floor(unseen[train] * Q.BINS), 0, Q.BINS - 1).astype(int)
    steps = pooled(np.bincount(at, minlength=Q.BINS).astype(float), np.bincount(at, y[train], Q.BINS))
    raw = z @ weights(train)
    want = steps[np.clip(np.floor(raw * Q.BINS), 0, Q.BINS - 1).astype(int)] + 1e-6 * np.clip(raw, 0, 1)
    got = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    near = np.array([abs(got[i].score - w) < 1e-6 for (i, *_), w in zip(rows, want, strict=True)])
    assert near.mean() > 0.98  # sums in another order may move a row over the edge of a bin
    assert all(got[i].held_out != t for (i, *_), t in zip(rows, train, strict=True))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = score_documents(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert np.mean([r.predicted for r in good]) > 0.99
    assert np.mean([1 - r.predicted for r in bad]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= KEEP) for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a " * 50_000, 3), (4, "Plain words here.", 4), (5, "Plain words here.", 4), (None, "x", 1)], "doc_id long, text string, stats int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_documents(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, None), (4, 1), (3, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in score_documents(docs, labels).collect()}
    assert out[1] == out[2] and out[4] == out[5] and len(out) == 6
    assert score_documents(docs.limit(0), labels).count() == 0
    assert score_documents(docs, labels).where(F.col("held_out").isNull()).count() <= 1


def test_keep_good_edges(spark):
    """Nothing but rejected texts goes: null ids, repeated rows, one id with two texts, and columns named like the operator's own."""
    kind = "doc_id long, text string, score int, stats string, y int"
    good, bad = "Plain words that make a sentence here. ", "### $$$ %%% &&& *** "
    rows = [(i, good * (1 + i % 5), 1, "s", 0) for i in range(40)] + [(100 + i, bad * (1 + i % 5), 1, "s", 0) for i in range(40)]
    rows += [(None, good * 3, 2, "s", 0), (None, bad * 3, 2, "s", 0), (None, None, 2, "s", 0), (1, good * 2, 1, "s", 0), (1, good * 2, 1, "s", 0), (101, good * 2, 9, "s", 0), (500, "", 1, "s", 0)]
    docs = spark.createDataFrame(rows, kind).repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40) if i != 1], "doc_id long, quality int")
    kept = keep_good(docs, labels)
    assert kept.schema == docs.schema
    out = [tuple(r) for r in kept.collect()]
    assert sorted(map(repr, out)) == sorted(repr(r) for r in rows if (r[1] or "").startswith("Plain") or (not r[1] and r in out))
    assert keep_good(docs, labels.limit(0)).count() == len(rows) and keep_good(docs.limit(0), labels).count() == 0
