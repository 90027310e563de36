"""Quality classifier (operator 3): random Fourier features of document statistics, ridge, isotonic calibration.

Document statistics are standardised over the training rows; ``cos(Wx + b)`` with Gaussian W approximates a Gaussian
kernel; every partition sums its part of the normal equations, Spark adds the parts, and the driver solves systems
of fixed size. The sums are kept for each of ``FOLDS`` parts of the rows, told by a hash of their statistics, so that each
training row is also scored by weights that have not seen it. Those scores are counted in a fixed number of bins and
pooled to a monotone step function (isotonic regression of shares that are drawn a little towards one half), which
gives the final score.

Null texts count as empty and are scored as such. Rows with a null doc_id are scored; they are not held out (null) and
have no label. Null labels are left out; a document labelled twice counts twice; a repeated row is scored each time.
Without any training row every score is 0.5. Equal texts get equal scores. An empty table gives no rows. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, mix, table, texts_of, utf8, word_hashes

FEATURES = 256
GAMMA = 0.06
RIDGE = 1e-1
SEED = 20
BINS = 1024
FOLDS = 5
KEEP = 0.3

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "space", "newline", "lower", "upper", "digit", "high",
    "sentence_marks", "pipes_slashes", "other_marks", "exclaims", "distinct_words", "repeated_next", "top_gap", "line_words", "mark_kinds",
)
_KINDS = 10


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 7, np.int64)
    kind[128:] = 6
    kind[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
    kind[0x0A] = 1
    kind[ord("a") : ord("z") + 1] = 2
    kind[ord("A") : ord("Z") + 1] = 3
    kind[ord("0") : ord("9") + 1] = 4
    kind[list(b".,;:'\"()-?")] = 5
    kind[list(b"|/\\_=<>{}[]~")] = 8
    kind[ord("!")] = 9
    return kind


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a batch, from whole texts."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), sizes)
    kinds = np.bincount(row_of * _KINDS + _byte_kinds()[data], minlength=rows * _KINDS).reshape(rows, _KINDS).astype(float)
    words, starts, ends, at = word_hashes(data, offsets)
    n = np.bincount(at, minlength=rows).astype(float)
    per_byte, per_word = np.maximum(sizes, 1.0)[:, None], np.maximum(n, 1.0)
    share = kinds / per_byte
    order = np.lexsort((words, at))
    same = np.zeros(len(words), bool)
    same[1:] = (words[order][1:] == words[order][:-1]) & (at[order][1:] == at[order][:-1])
    distinct = n - np.bincount(at[order][same], minlength=rows)
    run_ends = np.flatnonzero(~np.append(same[1:], False)) if len(words) else np.zeros(0, np.int64)
    run_starts = np.flatnonzero(~same) if len(words) else run_ends
    top = np.zeros(rows)
    np.maximum.at(top, at[order][run_starts], (run_ends - run_starts + 1).astype(float))
    following = (words[1:] == words[:-1]) & (at[1:] == at[:-1])
    repeated = np.bincount(at[1:][following], minlength=rows)
    marked = np.isin(data, np.frombuffer(b"*$#&%@^+", np.uint8))
    other = np.bincount(row_of[marked], minlength=rows)
    return np.column_stack(
        [
            np.log1p(sizes), np.log1p(n), np.log1p(np.bincount(at, weights=(ends - starts), minlength=rows) / per_word),
            share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 6], share[:, 5],
            np.sqrt(share[:, 8]), np.sqrt(share[:, 7]), np.sqrt(share[:, 9]), distinct / per_word, repeated / per_word, top / per_word,
            np.log1p(n / (1 + kinds[:, 1])), np.sqrt(other / per_byte[:, 0]),
        ]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats array<double>."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = statistics_of(*utf8(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(stats), pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return map_batches(texts_of(docs), run, "doc_id long, stats array<double>")


def fourier(stats: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (stats.shape[1], FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((stats - mean) / sd, -8, 8)
    return np.column_stack([np.cos(x @ w + b) * np.sqrt(2 / FEATURES), np.ones(len(x))])


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").flatten(), float).reshape(batch.num_rows, -1)


def pooled(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Isotonic regression of the positive share over ordered bins (pool adjacent violators); empty bins take the step below.

    One further row, half positive, is spread over the bins with rows, so that no share is 0 or 1.
    """
    filled = np.flatnonzero(total)
    more = 1 / max(1, len(filled))
    blocks: list[list[float]] = []  # rows, positives, first bin
    for k in filled.tolist():
        blocks.append([total[k] + more, positive[k] + more / 2, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, p, _ = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + p, blocks[-1][2]]
    out = np.full(len(total), 0.5)
    for k, (n, p, first) in enumerate(blocks):
        out[first if k else 0 :] = p / n
    return out


def _fold(stats: np.ndarray) -> np.ndarray:
    """The fold of each row by a hash of its statistics: equal texts are in one fold."""
    h = np.zeros(len(stats), np.uint64)
    for column in np.ascontiguousarray(stats, np.float64).view(np.uint64).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return (h % np.uint64(FOLDS)).astype(np.int64)


def fit(training: DataFrame) -> dict | None:
    """The model from rows (stats, y): means, weights and the calibration steps, all of fixed size."""
    width = len(STATISTICS)
    sums = training.select(*[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(width) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("n")).first()
    if not sums["n"]:
        return None
    mean = np.array([sums[f"m{i}"] for i in range(width)])
    sd = np.array([sums[f"s{i}"] for i in range(width)])
    sd[sd < 1e-6] = 1.0
    d = FEATURES + 1

    def parts(batches):
        a = np.zeros((FOLDS, d, d + 1))
        for batch in batches:
            stats, y = _stats(batch), np.array(batch.column("y"), float)
            z, fold = fourier(stats, mean, sd), _fold(stats)
            for k in range(FOLDS):
                own = z[fold == k]
                a[k] += own.T @ np.column_stack([own, y[fold == k]])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(FOLDS), d)), pa.array(np.tile(np.arange(d), FOLDS)), pa.array(list(a.reshape(FOLDS * d, d + 1)), pa.list_(pa.float64()))], names=["fold", "i", "row"])

    cells = training.mapInArrow(parts, "fold long, i long, row array<double>").select("fold", "i", F.posexplode("row").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    a = np.zeros((FOLDS, d, d + 1))
    found = cells.toArrow()  # FOLDS * d * (d + 1) cells, whatever the input
    a[found["fold"].to_numpy(), found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    solved = lambda m: np.linalg.solve(m[:, :d] + RIDGE * np.eye(d), m[:, d])
    model = {"mean": mean, "sd": sd, "weights": solved(a.sum(0))}
    # weights of fold k come from the other folds
    unseen = score(training, model | {"by_fold": np.stack([solved(a.sum(0) - a[k]) for k in range(FOLDS)])}, "y")
    bins = unseen.groupBy(F.expr(f"int(least({BINS - 1}, greatest(0, floor(raw * {BINS}))))").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    total, positive = np.zeros(BINS), np.zeros(BINS)
    for r in bins.collect():  # BINS rows at most
        total[r.bin], positive[r.bin] = r.n, r.p
    return model | {"steps": pooled(total, positive)}


def scores_of(stats: np.ndarray, model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Raw (ridge) and calibrated scores, within 0 to 1, of rows of statistics."""
    if model is None:
        return np.full(len(stats), 0.5), np.full(len(stats), 0.5)
    z = fourier(stats, model["mean"], model["sd"])
    raw = z @ model["weights"] if "by_fold" not in model else (z * model["by_fold"][_fold(stats)]).sum(1)
    if "steps" not in model:
        return raw, raw
    at = np.clip(np.floor(raw * BINS), 0, BINS - 1).astype(int)
    # within a step the raw score still orders, without leaving the step's place
    return raw, np.clip(model["steps"][at] + 1e-6 * np.clip(raw, 0, 1), 0, 1)


def score(stats: DataFrame, model: dict | None, *keep: str) -> DataFrame:
    """The columns ``keep`` with raw double (ridge) and score double (calibrated, within 0 to 1)."""
    kinds = dict(stats.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, score_ = scores_of(_stats(batch), model)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(raw), pa.array(score_)], names=[*keep, "raw", "score"])

    return map_batches(stats, run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "raw double", "score double"]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _training(stats: DataFrame, labels: DataFrame) -> DataFrame:
    y = labels.where(F.col("quality").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    return cut(stats.join(y, "doc_id").select("doc_id", "stats", "y"), "training")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; labels come from rows that are not held out."""
    stats = cut(document_statistics(docs), "stats")
    scored = score(stats, fit(_training(stats, labels)), "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns.

    Each text is judged where it is, so that nulls, repeated rows and texts that share a doc_id are judged like others.
    """
    model = fit(_training(document_statistics(docs), labels))
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(names.index("text"))
        stats = statistics_of(*utf8(text.fill_null("")))
        return batch.filter(pa.array(scores_of(stats, model)[1] >= KEEP))

    return map_batches(docs, run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
