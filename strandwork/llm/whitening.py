"""Whitening of embeddings by their principal components, with covariances from variances alone (polarisation).

An entry c becomes the whole number x = floor(64 c) + 1000000. For two dimensions a and b the variance of x_a + x_b is
Var(x_a) + Var(x_b) + 2 Cov(x_a, x_b), so exact sums of squared centred values, one for each dimension and one for each
sum of two dimensions, give every covariance as a difference of variances:

1. *Fit list*: each distinct x vector once, written to the shared folder.
2. *Sums*: count and sum of each dimension. The mean is split into a whole number and a rest below one; u is x less the
   whole part, which is centred but for that rest.
3. *Squares*: sums of u_a^2 and (u_a + u_b)^2 as whole numbers, one row for each task and pair, added up as decimals. What
   the rest of the mean adds is known in closed form, so the squares about the true mean are exact, and so are the
   differences; only the finished covariances are rounded to doubles.
4. The matrix is assembled on the driver (dimensions^2 numbers, whatever the number of vectors) for ``eigh``.
5. One pass over the fit list takes the whitened values' covariance, one over all rows projects them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import saved

SCALE, SHIFT = 64, 1_000_000
#: Whole numbers that a double holds exactly, with room for the shift; entries beyond have no exact x.
REACH = float(1 << 52)


def _entries(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def usable(vector: Column) -> Column:
    """A vector that is not null or empty and holds numbers only whose x is exact."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < REACH))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Count, sums, and the greatest distance between two entries of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, np.zeros(dims, object), None, None
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            if len(x):
                n += len(x)
                total = total + sum(x[i : i + 1024].sum(0).astype(object) for i in range(0, len(x), 1024))
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), _decimals(total), pa.array(low), pa.array(high)], names=["d", "n", "s", "low", "high"])

    parts = fit.mapInArrow(run, "d int, n long, s decimal(38,0), low long, high long")
    rows = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    rows.sort(key=lambda r: r["d"])
    return rows[0]["n"], [int(r["s"]) for r in rows], max(r["high"] - r["low"] for r in rows)


def _squares(u: np.ndarray, reach: int) -> list[np.ndarray]:
    """For each dimension the exact sums of its squares and of those of its sums with every later dimension."""
    if len(u) * (2 * reach + 2) ** 2 >= 1 << 63:
        u = u.astype(object)
    out = []
    for a in range(u.shape[1]):
        both = u[:, a:] + u[:, a, None]
        both[:, 0] = u[:, a]
        out.append((both * both).sum(0))
    return out


def covariances(fit: DataFrame, dims: int, n: int, sums: list[int], reach: int) -> np.ndarray:
    """The matrix of ``fit``'s one column, arrays of ``dims`` whole numbers with these sums: divisor n, exact but for the
    last rounding."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]  # sums of u: n times what is left of the mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            u = _matrix(batch.column(0), dims) - whole
            for i in range(0, len(u), 4096):
                found = np.concatenate(_squares(u[i : i + 4096], reach)).astype(object)
                held = found if held is None else held + found
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), _decimals(held)], names=["pair", "q"])

    added = fit.mapInArrow(run, "pair int, q decimal(38,0)").groupBy("pair").agg(F.sum("q").cast("decimal(38,0)").alias("q")).collect()
    q = dict((r["pair"], int(r["q"])) for r in added)
    pairs = [(a, b) for a in range(dims) for b in range(a, dims)]
    # n^2 times the variance of a dimension, or of the sum of two
    about = {p: n * q[i] - (rest[p[0]] if p[0] == p[1] else rest[p[0]] + rest[p[1]]) ** 2 for i, p in enumerate(pairs)}
    out = np.empty((dims, dims))
    for a, b in pairs:
        cross = 2 * about[a, a] if a == b else about[a, b] - about[a, a] - about[b, b]
        out[a, b] = out[b, a] = cross / (2 * n * n)
    return out


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """For each row with a usable vector and each of the first ``components`` components: the id, ``component`` (from 1, by
    falling eigenvalue), ``n`` (vectors of the fit list), ``deviation`` (exact sum over dimensions of (n x - S)^2),
    ``whitened``, ``explained`` (share of the trace) and ``identity_error`` (the largest absolute entry of the whitened
    fit list's covariance less the identity).

    Vectors that are null, empty, or hold null or non-finite entries, or entries over 2^46, take no part. Of vectors of
    several lengths, those of the length that most distinct vectors have do (the longest of these), for the others share
    no covariance with them. Repeated vectors and rows are fitted once and each get their rows; null ids stay null. A
    component without variance (fewer distinct vectors than dimensions, constant dimensions) has null ``whitened`` and
    takes no part in ``identity_error``. Other columns are not read. An empty table gives an empty table.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    good = vectors.where(usable(F.col(f"`{vector_col}`"))).select(F.col(f"`{id_col}`").alias("id"), _entries(F.col(f"`{vector_col}`")).alias("x"))
    fit = saved(good.select("x").distinct())
    sizes = fit.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = sizes[0]["dims"]
    fit, good = fit.where(F.size("x") == dims), good.where(F.size("x") == dims)
    n, sums, reach = _sums(fit, dims)
    v = covariances(fit, dims, n, sums, reach)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(v))
    varied = values > np.finfo(float).eps * dims * max(trace, 1e-300)
    scaled = np.where(varied, axes / np.sqrt(np.where(varied, values, 1)), np.nan)
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - rest / n

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(varied.sum())
        seen, total = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            w = centred(_matrix(batch.column(0), dims)) @ scaled[:, varied]
            seen, total = seen + w.T @ w, total + w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width * (width + 1)), pa.int32()), pa.array(np.append(seen.ravel(), total))], names=["at", "v"])

    error = float("nan")
    if varied.any():
        width = int(varied.sum())
        got = fit.mapInArrow(spread, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        flat = np.array([r["v"] for r in sorted(got, key=lambda r: r["at"])]) / n
        mean = flat[width * width :]
        error = float(np.abs(flat[: width * width].reshape(width, width) - np.outer(mean, mean) - np.eye(width)).max())
    small = n * (reach + 1) < 1 << 31 and dims * (n * (reach + 1)) ** 2 < 1 << 63

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x = _matrix(part.column(1), dims)
                w = (centred(x) @ scaled).ravel()
                off = (x - whole) if small else (x - whole).astype(object)
                off = off * n - (rest if small else rest.astype(object))
                deviation = (off * off).sum(1)
                exact = pa.array(deviation).cast(pa.decimal128(38, 0)) if small else _decimals(deviation)
                rows = pa.array(np.repeat(np.arange(len(x)), len(scaled[0])))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(rows),
                        pa.array(np.tile(np.arange(1, len(values) + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(rows), n, np.int64)),
                        exact.take(rows),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(np.tile(explained, len(x)), mask=np.isnan(np.tile(explained, len(x)))),
                        pa.array(np.full(len(rows), error), mask=np.full(len(rows), np.isnan(error))),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return good.mapInArrow(project, schema)
