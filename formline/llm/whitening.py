"""Whitening components of embeddings by shifted CholeskyQR over distributed Gram passes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import ship

ship(__name__)

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024.0, 100_000
#: Entries of this size and more count as non-finite: their whole numbers and the sums of two would leave 64 bits.
HUGE = 2.0**51
#: Largest distance of a Gram matrix from the identity at which rows count as orthogonal.
ORTHOGONAL = 1e-13


class Whitening(NamedTuple):
    """What ``fit`` learns: ``mean`` is quotient + remainder / n per dimension, both whole numbers."""

    n: int
    quotient: np.ndarray
    remainder: np.ndarray
    factors: list[np.ndarray]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def whole_rows(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of the rows that remain, and their whole-number vectors: one matrix, or a list of vectors without ``dims``."""
    start = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(start[0], start[-1] - start[0]).to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry is a NaN
    start -= start[0]
    bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < HUGE))])
    length = np.diff(start)
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[start[1:]] == bad[start[:-1]])
    if dims is not None:
        good &= length == dims
    at = np.flatnonzero(good)
    whole = np.where(np.abs(values) < HUGE, np.floor(SCALE * np.where(np.abs(values) < HUGE, values, 0.0)), 0.0).astype(np.int64) + OFFSET
    if dims is None:
        return at, [whole[start[i] : start[i + 1]] for i in at]
    return at, whole[start[at][:, None] + np.arange(dims)]


def blocks(batches, entries: int = 1 << 20):
    """Parts of the batches with so many vector entries, or one row."""
    for b in batches:
        length = max(1, len(b.column(0).values) // max(1, b.num_rows))
        for i in range(0, b.num_rows, max(1, entries // length)):
            yield b.slice(i, max(1, entries // length))


def centred(x: np.ndarray, n: int, quotient: np.ndarray, remainder: np.ndarray) -> np.ndarray:
    """x minus the mean, as doubles; the large common part goes before anything is rounded."""
    return (x - quotient).astype(np.float64) - remainder.astype(np.float64) / n


def triangular_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rows q with q r = row, for an upper triangular r, by substitution column by column."""
    q = np.empty_like(rows)
    for j in range(r.shape[1]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _vectors(df: DataFrame, vector: str, *others) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("v"), *others)


def _sums(df: DataFrame, vector: str) -> tuple[int, np.ndarray, int]:
    """(dims, exact sum per dimension, number of rows), of the commonest length of at least one; ties go to the longer."""

    def run(batches):
        held: dict[int, list] = {}
        for b in blocks(batches):
            at, rows = whole_rows(b.column(0))
            sizes = np.array([len(r) for r in rows], np.int64)
            for d in np.unique(sizes[sizes > 0]):
                x = np.stack([r for r, s in zip(rows, sizes, strict=True) if s == d])
                have = held.setdefault(int(d), [0, [0] * int(d)])
                have[0] += len(x)
                high, low = (x >> 26).sum(0), (x & (2**26 - 1)).sum(0)  # neither leaves 64 bits
                have[1] = [s + (int(h) << 26) + int(v) for s, h, v in zip(have[1], high, low, strict=True)]
        rows = [(d, i, n, s) for d, (n, sums) in held.items() for i, s in enumerate(sums)]
        if rows:
            d, i, n, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(i, pa.int32()), pa.array(n, pa.int64()), pa.array([str(v) for v in s])], ["d", "i", "n", "s"])

    parts = _vectors(df, vector).mapInArrow(run, "d int, i int, n long, s string")
    cells = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    best = cells.where("i = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return 0, np.zeros(0, np.int64), 0
    found = cells.where(F.col("d") == best["d"]).orderBy("i").collect()  # a number per dimension
    return best["d"], [int(r["s"]) for r in found], best["n"]


def _gram(df: DataFrame, vector: str, dims: int, project) -> np.ndarray:
    """Sum over all rows of the outer product of ``project(whole vectors)``; a task sends its sum's upper cells once."""

    def run(batches):
        total = None
        for b in blocks(batches):
            at, x = whole_rows(b.column(0), dims)
            if len(at):
                q = project(x)
                total = q.T @ q + (0.0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    cells = _vectors(df, vector).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = 1 + max((r["j"] for r in cells), default=-1)
    out = np.zeros((size, size))
    for r in cells:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _cholesky(gram: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """Upper triangular r with r'r = gram, plus a shift on its diagonal if asked for or where rounding left it indefinite."""
    d = len(gram)
    eps = np.finfo(float).eps / 2
    step = 11 * eps * (d * np.sqrt(n) + d * (d + 1)) * max(np.linalg.norm(gram, 2), np.finfo(float).tiny)
    add = step if shift else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + add * np.eye(d)).T
        except np.linalg.LinAlgError:
            add = max(10 * add, step)


def fit(df: DataFrame, vector: str = "embedding", passes: int = 6) -> Whitening:
    """Mean, triangular factors, eigenvalues and eigenvectors of the covariance, by shifted CholeskyQR.

    One pass sums whole vectors exactly. Each further pass brings centred rows through the triangular solves of all
    factors so far and sums their Gram matrix: the first is shifted, so that it has a Cholesky factor however close to
    singular the rows are, and each next factor makes the rows more nearly orthogonal, until their Gram matrix is the
    identity. The factors' product R, times the root of that last matrix, has the rows' singular values and right
    singular vectors, which a small SVD gives; nothing is squared on the way. The driver holds a number per pair of
    dimensions, whatever the number of rows.
    """
    dims, sums, n = _sums(df, vector)
    if not n:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0), np.zeros((0, 0)), 0.0)
    quotient, remainder = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    factors: list[np.ndarray] = []
    product = np.eye(dims)
    for k in range(passes):
        made = list(factors)

        def project(x, made=made):
            q = centred(x, n, quotient, remainder)
            for r in made:
                q = triangular_solve(q, r)
            return q

        gram = _gram(df, vector, dims, project)
        if k and np.abs(gram - np.eye(dims)).max() < ORTHOGONAL:
            break
        if k == passes - 1 or not gram.any():
            break
        r = _cholesky(gram, n, shift=k == 0)
        factors.append(r)
        product = r @ product
    lengths, turned = np.linalg.eigh(gram)
    root = turned * np.sqrt(np.maximum(lengths, 0.0)) @ turned.T
    _, sizes, axes = np.linalg.svd(root @ product)
    top = np.argmax(np.abs(axes), axis=1)
    axes = axes * np.where(axes[np.arange(dims), top] < 0, -1.0, 1.0)[:, None]  # the largest entry is positive
    values = sizes**2 / n
    values[sizes <= sizes[:1].max(initial=0) * dims * np.finfo(float).eps * 64] = 0.0  # rounding alone
    return Whitening(n, quotient, remainder, factors, values, axes, float(values.sum()))


def whiten(df: DataFrame, learnt: Whitening, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """Per remaining row and component (key, component, n, deviation, whitened, explained), with deviation an exact decimal(38, 0).

    ``deviation`` is the sum over dimensions of (n x - S)^2 and null where it has more than 38 digits; ``whitened``
    is null for components without variance, of which ``explained`` is 0, or null where no dimension varies.
    """
    dims, n = len(learnt.quotient), learnt.n
    kept = min(components, dims)
    axes = np.divide(learnt.axes[:kept].T, np.sqrt(learnt.values[:kept]), out=np.full((dims, kept), np.nan), where=learnt.values[:kept] > 0)
    share = learnt.values[:kept] / learnt.trace if learnt.trace else np.full(kept, np.nan)
    q, r = learnt.quotient, learnt.remainder
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in blocks(batches):
            at, x = whole_rows(b.column(0), dims)
            if not len(at) or not kept:
                continue
            y = centred(x, n, q, r)
            if dims * (n * np.abs(y).max(initial=0.0) + 1) ** 2 < 2.0**62:
                exact = ((n * (x - q) - r) ** 2).sum(1).tolist()
            else:
                exact = ((n * (x.astype(object) - q.astype(object)) - r.astype(object)) ** 2).sum(1).tolist()
            w = (y @ axes).reshape(-1)
            k = np.arange(len(at)).repeat(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1).take(pa.array(at[k])), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(at))), pa.array(np.full(len(k), n, np.int64)),
                    pa.array([str(v) for v in exact]).take(pa.array(k)), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(share, len(at)), mask=np.tile(np.isnan(share), len(at))),
                ],
                ["key", "component", "n", "deviation", "whitened", "explained"],
            )

    made = _vectors(df, vector, F.col(key).alias("key")).mapInArrow(run, f"key {kind}, component int, n long, deviation string, whitened double, explained double")
    return made.select(F.col("key").alias(key), "component", "n", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened", "explained")


def identity_error(df: DataFrame, learnt: Whitening, vector: str = "embedding", components: int = 8) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance; null if there are none."""
    dims = len(learnt.quotient)
    kept = int((learnt.values[: min(components, dims)] > 0).sum())
    if not kept:
        return None
    axes, n, q, r = learnt.axes[:kept].T / np.sqrt(learnt.values[:kept]), learnt.n, learnt.quotient, learnt.remainder
    # the last column of ones sums the rows, so that their mean, zero but for rounding, is taken off
    both = _gram(df, vector, dims, lambda x: np.column_stack([centred(x, n, q, r) @ axes, np.ones(len(x))])) / n
    mean = both[:kept, kept]
    return float(np.abs(both[:kept, :kept] - np.outer(mean, mean) - np.eye(kept)).max())


def whitened(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """Rows projected on the leading components of their covariance and scaled to unit variance.

    Returns, per remaining row and component, ``key``, component (from 1, by falling variance), n, deviation, whitened,
    explained and identity_error. Entries c become x = floor(1024 c) + 100000; of equal variances either order is
    right; an axis points to where its largest entry is positive.

    Rows whose vector is null or has a null, NaN or infinite entry, or one of 2^51 and more, have no result; nor have
    vectors of another length than most have (ties: the longer counts) and empty ones. Null and repeated keys are kept
    row by row. Vectors with fewer dimensions than components give one row per dimension; a component without variance
    gives a null ``whitened``. Without rows the result is empty; other columns are not read.
    """
    learnt = fit(df, vector)
    error = identity_error(df, learnt, vector, components)
    return whiten(df, learnt, vector, key, components).withColumn("identity_error", F.lit(error).cast("double"))
