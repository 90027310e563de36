"""Normal equations of many fits at once: sums of products of wide rows, in blocks of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block, and the bytes of blocks that a task holds before it passes them on.
BLOCK, HELD = 128, 64 << 20


def _keys(df: DataFrame, by: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in by)


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows with equal keys; one that goes on in the next frame comes in parts."""
    for frame in frames:
        if not len(frame):
            continue
        if not keys:
            yield (), frame
            continue
        own = frame[keys]
        before = own.shift()
        new = ~((own == before) | (own.isna() & before.isna())).all(axis=1).to_numpy()
        new[0] = True
        edges = [*np.flatnonzero(new), len(frame)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = frame.iloc[a:b]
            yield tuple(None if pd.isna(v) else v for v in part[keys].iloc[0]), part


def summed_products(rows: DataFrame, by: list[str], values: str, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """by, _width, _i, _j, _sums: of each key the blocks (i <= j) of the sum of v v' over its rows' vectors ``values``.

    A task holds ``held`` bytes of blocks at most, however many keys there are and however wide they are; what it passes
    on is added up by key and block as it streams in, one block at a time, so that neither a key with very many rows nor
    very many tasks fill a worker. Vectors of one key have one width.
    """

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        size = 0

        def passed() -> pd.DataFrame:
            return pd.DataFrame([[*key, w, i, j, m.tobytes()] for (key, w, i, j), m in sums.items()], columns=[*by, "_width", "_i", "_j", "_sums"])

        for frame in frames:
            for key, g in frame.groupby(by, dropna=False, sort=False) if by else [((), frame)]:
                x = np.stack(g[values].to_numpy()).astype(float)
                key, w = tuple(None if pd.isna(k) else k for k in key), x.shape[1]
                for i in range(0, w, block):
                    for j in range(i, w, block):
                        m = x[:, i : i + block].T @ x[:, j : j + block]
                        at = (key, w, i // block, j // block)
                        if at in sums:
                            sums[at] += m
                        else:
                            sums[at] = m
                            size += m.nbytes
                        if size > held:
                            yield passed()
                            sums.clear()
                            size = 0
        if sums:
            yield passed()

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for key, part in _runs(frames, keys):
            if key != at:
                if at is not None:
                    yield pd.DataFrame([[*at, total.tobytes()]], columns=[*keys, "_sums"])
                at, total = key, 0.0
            for m in part["_sums"]:
                total = total + np.frombuffer(m)
        if at is not None:
            yield pd.DataFrame([[*at, total.tobytes()]], columns=[*keys, "_sums"])

    keys = [*by, "_width", "_i", "_j"]
    schema = f"{_keys(rows, by)}_width int, _i int, _j int, _sums binary"
    partial = rows.select(*by, values).mapInPandas(parts, schema)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(added, schema)


def each_matrix(blocks: DataFrame, by: list[str], fn, schema: str, block: int = BLOCK) -> DataFrame:
    """``fn(matrix)`` of the whole matrix of each key, a list of rows behind the key; ``schema`` names them. One matrix is held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, m = None, None
        names = [c.split()[0] for c in schema.split(", ")]
        give = lambda: pd.DataFrame([[*at, *row] for row in fn(m)], columns=[*by, *names])
        for key, part in _runs(frames, by):
            if key != at:
                if m is not None:
                    yield give()
                w = int(part["_width"].iloc[0])
                at, m = key, np.zeros((w, w))
            for i, j, s in zip(part["_i"], part["_j"], part["_sums"], strict=True):
                rows, columns = slice(i * block, min((i + 1) * block, len(m))), slice(j * block, min((j + 1) * block, len(m)))
                cell = np.frombuffer(s).reshape(rows.stop - rows.start, columns.stop - columns.start)
                m[rows, columns] = cell
                m[columns, rows] = cell.T
        if m is not None:
            yield give()

    by_key = blocks.repartition(*by) if by else blocks.coalesce(1)
    return by_key.sortWithinPartitions(*by, "_i", "_j").mapInPandas(run, f"{_keys(blocks, by)}{schema}")


def ridge_solutions(m: np.ndarray, features: np.ndarray, targets: np.ndarray, penalties: tuple[float, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(intercepts, weights) for each penalty, from the summed products of rows (1, features, targets); column 0 is the one.

    Features are standardised with their mean and population deviation (plus 1e-8) and targets centred; weights are given
    back for the features as they are. One decomposition serves all penalties.
    """
    n = m[0, 0]
    mean, said = m[0, features] / n, m[0, targets] / n
    sd = np.sqrt(np.maximum(m[features, features] / n - mean**2, 0)) + 1e-8
    gram = (m[np.ix_(features, features)] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    target = (m[np.ix_(features, targets)] - n * np.outer(mean, said)) / sd[:, None]
    values, vectors = np.linalg.eigh(gram)
    turned = vectors.T @ target
    out = []
    for penalty in penalties:
        w = vectors @ (turned / (np.maximum(values, 0) + penalty)[:, None]) / sd[:, None]
        out.append((said - mean @ w, w))
    return out


def with_ones(features: str, *targets: str) -> Column:
    """1, the features and the targets as one vector of doubles."""
    return F.concat(F.array(F.lit(1.0)), F.col(features).cast("array<double>"), *[F.array(F.col(t).cast("double")) for t in targets])
