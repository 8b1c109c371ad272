"""Embedding whitening: principal components by spectral divide and conquer, unit variances.

The covariance is split without an eigenvalue routine. The polar factor of a symmetric matrix A
shifted by s is +1 on the subspace of the eigenvalues above s and -1 on the other, so it gives
projectors on both. Each half is compressed to its own subspace and split again until blocks have
one eigenvalue. Polar factors come from the QR-based dynamically weighted Halley iteration.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.columns import settle

#: Entries become long x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this are taken as this, so that x is a long.
LARGEST = 2.0**54
EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH; its sign function."""
    size = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.zeros_like(a)
    x, least = a / norm, EPS
    for _ in range(40):
        # Weights that lift the interval [least, 1] of singular values nearest to 1.
        d = np.cbrt(4 * (1 - least**2) / least**4) if least < 1 else 0.0
        root = math.sqrt(1 + d)
        wa = root + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - least**2) / (least**2 * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(size)]))
        new = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        least = min(1.0, least * (wa + wb * least**2) / (1 + wc * least**2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= 4 * EPS * math.sqrt(size) and 1 - least < 10 * EPS:
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places to split the spectrum at: the middle of the diagonal, then points between its ends."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    spread = np.linalg.norm(a - diagonal.mean() * np.eye(len(a)))
    for part in (0.5, 0.25, 0.75, 0.1, 0.9, 0.03, 0.97):
        yield float(diagonal.mean() + (2 * part - 1) * spread)


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces above and below the shift, if it tells them apart."""
    size = len(a)
    unit = polar(a - shift * np.eye(size))
    upper = (unit + np.eye(size)) / 2
    rank = int(round(float(np.trace(upper))))
    if not 0 < rank < size or np.linalg.norm(upper @ upper - upper) > 1e-8:
        return None
    # A subspace iteration of two steps from random vectors gives a basis of the projector's range.
    start = np.random.default_rng(size).standard_normal((size, size))
    basis = np.linalg.qr(np.hstack([upper @ start[:, :rank], (np.eye(size) - upper) @ start[:, rank:]]))[0]
    basis = np.linalg.qr(np.hstack([upper @ basis[:, :rank], (np.eye(size) - upper) @ basis[:, rank:]]))[0]
    return basis[:, :rank], basis[:, rank:]


def components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as
    columns. Blocks that lie below the wanted ones are not split."""
    size = len(a)
    mean = float(np.trace(a)) / max(size, 1)
    scale = np.linalg.norm(a)
    if size == 1 or np.linalg.norm(a - mean * np.eye(size)) <= 4 * EPS * scale:
        values = np.diag(a).copy()
        order = np.argsort(-values, kind="stable")[:most]
        return values[order], np.eye(size)[:, order]
    for shift in _shifts(a):
        halves = _split(a, shift)
        if halves:
            break
    else:  # all eigenvalues equal up to rounding
        values = np.diag(a).copy()
        order = np.argsort(-values, kind="stable")[:most]
        return values[order], np.eye(size)[:, order]
    values, vectors = [], []
    for basis in halves:
        left = most - sum(map(len, values))
        if left > 0:
            inner = basis.T @ a @ basis
            found, own = components((inner + inner.T) / 2, left)
            values.append(found)
            vectors.append(basis @ own)
    return np.concatenate(values), np.hstack(vectors)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _sums(parts: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """A matrix as rows (place, values)."""
    values = pa.array(list(parts), pa.list_(kind))
    return pa.record_batch([pa.array(range(len(parts)), pa.int32()), values], ["place", "values"])


def _added(rows: DataFrame, step, size: int, columns: int, kind: str) -> np.ndarray:
    """The sum of ``step`` over all batches, which gives a matrix of (size, columns) for each. Every
    task sends one matrix; only the sum, whose size is that of the dimensions, comes to the driver."""
    arrow, dtype = (pa.int64(), np.int64) if kind == "long" else (pa.float64(), np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, columns), dtype)
        for batch in batches:
            if batch.num_rows:
                total += step(batch)
        yield _sums(total, arrow)

    sent = rows.mapInArrow(run, f"place int, values array<{kind}>")
    each = sent.select("place", F.posexplode("values").alias("at", "value"))
    added = each.groupBy("place", "at").agg(F.sum("value").alias("value"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"])
    found = added.groupBy("place").agg(row.alias("values")).collect()
    total = np.zeros((size, columns), dtype)
    for r in found:
        total[r.place] = r["values"]
    return total


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all are finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(finite(c.cast("double")), F.lit(False)))


def stepped(vector: Column) -> Column:
    """The vector in whole steps: floor(64 * c) + 1000000, as longs."""
    inside = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: F.floor(inside(c) * SCALE) + F.lit(OFFSET).cast("long"))


def whiten(rows: DataFrame, vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """Rows (row, n, deviation, components): the input row as a struct, and its whitened values.

    Entries become whole steps x. The fit list has every distinct x vector once: n vectors with
    sums S. ``components`` is an array of structs (component, whitened, explained, identity_error), by
    falling eigenvalue e of the fit list's covariance V: ``whitened`` is (x - S/n) projected on the
    unit eigenvector over sqrt(e), ``explained`` e / trace(V), ``identity_error`` the largest absolute
    difference between the covariance of the fit list's whitened vectors and the identity.
    ``deviation`` is the sum over the dimensions of (n*x - S)^2, null where no long holds it.

    The covariance is summed of x less the whole number next to S/n, so products are of small whole
    numbers and their sums are exact as doubles, whatever the partitions; the mean's rest is taken
    off at the end. Matrices of the dimensions' size go through the driver, nothing that grows
    with the rows. The fit list is found by a combining aggregate, so copies of one vector, however
    many, meet as one row from each task.

    Vectors that are null, empty, or hold a null or a number that is not finite are dropped. The
    length that most remaining rows have (of equals, the greater) is the table's; rows of another
    length are dropped too. Entries beyond 2^54 count as 2^54. Directions along which nothing varies have
    no component: one distinct vector, or an empty table, gives rows with no components. Rows that
    repeat an id stay rows of their own; columns of any name ride along in ``row``.
    """
    spark = rows.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    kept = rows.where(usable(F.col(vector_col))).select(whole, stepped(F.col(vector_col)).alias("x"))
    sizes = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 1
    kept = kept.where(F.size("x") == size)
    fit = settle(kept.select("x").distinct(), "fit")
    n = fit.count()

    def halves(batch: pa.RecordBatch) -> np.ndarray:  # no sum of either half leaves a long
        x = _rows(batch.column(0), size)
        return np.vstack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    high, low = _added(fit, halves, 2, size, "long").tolist()
    exact = [(a << 32) + b for a, b in zip(high, low, strict=True)]
    centre = np.array([s // n if n else 0 for s in exact], np.int64)
    rest = np.array([(s - n * int(c)) / n if n else 0.0 for s, c in zip(exact, centre, strict=True)])

    def products(batch: pa.RecordBatch) -> np.ndarray:
        own = (_rows(batch.column(0), size) - centre).astype(np.float64)
        return own.T @ own

    square = _added(fit, products, size, size, "double")
    covariance = square / max(n, 1) - np.outer(rest, rest)
    values, vectors = components((covariance + covariance.T) / 2, min(most, size))
    trace = float(np.trace(covariance))
    real = values > max(size, 2) * EPS * max(float(values[0]), 0.0) if len(values) else np.zeros(0, bool)
    values, vectors = values[real], vectors[:, real]
    model = spark.sparkContext.broadcast((centre, rest, vectors / np.sqrt(values)))

    def projected(x: np.ndarray) -> np.ndarray:
        centre, rest, map_ = model.value
        return ((x - centre) - rest) @ map_

    def checked(batch: pa.RecordBatch) -> np.ndarray:
        own = projected(_rows(batch.column(0), size))
        return np.vstack([own.T @ own, own.sum(axis=0, keepdims=True)])

    count = len(values)
    error = 0.0
    if count:
        check = _added(fit, checked, count + 1, count, "double")
        mean = check[count] / n
        error = float(np.abs(check[:count] / n - np.outer(mean, mean) - np.eye(count)).max())
    shares = (values / trace).tolist() if count else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less = [s - n * int(c) for s, c in zip(exact, centre, strict=True)]
        for batch in batches:
            x = _rows(batch.column(1), size)
            found = projected(x)
            far = np.abs((x - centre).astype(np.float64)).max(initial=0) + 1
            if (far * n) ** 2 * size < 2**62:
                deviation = ((n * (x - centre) - np.array(less)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [
                    sum((n * v - s) ** 2 for v, s in zip(r, less, strict=True)) for r in (x - centre).tolist()
                ]
                deviation = [d if d < 2**63 else None for d in deviation]
            arrays = [batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(found), pa.list_(pa.float64()))]
            yield pa.record_batch(arrays, ["row", "deviation", "values"])

    schema = kept.select("row", F.lit(None).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("values")).schema
    shared = F.array(*[F.lit(s) for s in shares]) if shares else F.array().cast("array<double>")
    each = F.transform(
        "values",
        lambda v, k: F.struct(
            (k + 1).alias("component"),
            v.alias("whitened"),
            F.get(shared, k).alias("explained"),
            F.lit(error).alias("identity_error"),
        ),
    )
    return kept.mapInArrow(run, schema).select(
        "row", F.lit(n).cast("long").alias("n"), "deviation", each.alias("components")
    )
