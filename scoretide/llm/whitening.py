"""Whitening directions of vectors: blockwise QR, a bidiagonal matrix, its singular values by dqds, twisted factorisations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoretide.llm.common import over_batches, stored

COMPONENTS = 4
GRID = 256

# Rows that one QR step takes in; triangles that one task of the tree merges.
BLOCK, FAN = 4096, 16

EPS = float(np.finfo(float).eps)
SAFE = 1 << 62


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(w, s): the reflection 1 - 2 w w' turns x into s times the first unit vector."""
    top = np.abs(x).max(initial=0.0)
    if top == 0 or not np.any(x[1:]):
        return np.zeros_like(x), float(x[0])
    w = x / top
    size = math.copysign(math.sqrt(w @ w), w[0])
    w[0] += size
    return w / math.sqrt(w @ w), -size * top


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and V of the square matrix r = U B V' with orthogonal U and V, by Householder reflections."""
    m, d = np.array(r, dtype=float), len(r)
    v, a, b = np.eye(d), np.zeros(d), np.zeros(max(d - 1, 0))
    for k in range(d):
        w, a[k] = reflector(m[k:, k])
        m[k:, k:] -= 2 * np.outer(w, w @ m[k:, k:])
        if k < d - 1:
            w, b[k] = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return a, b, v


def _pass(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int]:
    """One differential quotient-difference step with a shift, and the place where it failed, or -1."""
    new_q, new_e, d = [], [], q[0] - shift
    for i, over in enumerate(e):
        if d < 0:
            return new_q, new_e, i
        top = d + over
        if top == 0:
            return new_q, new_e, i
        t = q[i + 1] / top
        new_q.append(top)
        new_e.append(over * t)
        d = d * t - shift
    new_q.append(d)
    return new_q, new_e, len(e) if d < 0 else -1


def singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All singular values of the upper bidiagonal matrix (a, b), falling, by dqds.

    No step subtracts but for the shift, so that small values are as exact, relatively, as large ones. A shift that goes
    beyond the smallest value makes the step fail, which costs a step and nothing else.
    """
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(a))
    least = (EPS * EPS) ** 2  # zero on the diagonal would stop the recurrence
    todo = [([max((x / scale) ** 2, least) for x in a.tolist()], [(x / scale) ** 2 for x in b.tolist()], 0.0)]
    tolerance, found, left = (10 * EPS) ** 2, [], 200 * len(a) + 1000
    while todo:
        q, e, moved = todo.pop()
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tolerance * (moved + q[i + 1]) or e[i] <= tolerance * tolerance * q[i]), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[-1] > 1.5 * q[0]:  # the small end belongs at the bottom
                q.reverse()
                e.reverse()
            left -= 1
            if left < 0:
                raise ArithmeticError("dqds did not come to an end")
            # the smaller value of the last two rows is never below the smallest of all
            half, low = (q[-2] + e[-1] + q[-1]) / 2, q[-2] * q[-1]
            shift = low / (half + math.sqrt(max(half * half - low, 0.0)))
            for attempt in range(4):
                new_q, new_e, failed = _pass(q, e, shift)
                if failed < 0:
                    break
                # a failure at the very end still tells how far the shift went too far
                shift = 0.0 if attempt == 2 else max(shift + new_q[-1], 0.0) if failed == len(e) else shift / 4
            q, e, moved = new_q, new_e, moved + shift
        found.append(moved + q[0])
    return scale * np.sqrt(np.sort(np.array(found))[::-1])


def twisted_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, close: float = 1e-3) -> np.ndarray:
    """Unit right singular vectors of the bidiagonal matrix for ``values``, as columns.

    B'B less a squared value is factorised from the top and from the bottom; the two meet where the pivot is smallest, and the
    vector follows by multiplications alone. Vectors of values that nearly agree are made orthogonal, from the next twist where one does
    not stand by itself.
    """
    n, scale = len(a), max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    tiny = EPS * EPS * scale
    diagonal = [x if abs(x) > tiny else tiny for x in a.tolist()]
    above = b.tolist()
    q, couple = [x * x for x in diagonal], [x * y for x, y in zip(diagonal, above)]
    out: list[np.ndarray] = []
    for k, value in enumerate(values.tolist()):
        lam, floor = value * value, EPS * EPS * scale * scale
        s, lower = [-lam], []
        for i in range(n - 1):
            pivot = s[i] + q[i]
            pivot = pivot if abs(pivot) > floor else math.copysign(floor, pivot)
            lower.append(couple[i] / pivot)
            s.append(lower[i] * (above[i] / diagonal[i]) * s[i] - lam)
        p, upper = [0.0] * n, [0.0] * (n - 1)
        p[-1] = q[-1] - lam
        for i in range(n - 2, -1, -1):
            p[i + 1] = p[i + 1] or floor
            pivot = above[i] ** 2 + p[i + 1]
            pivot = pivot if abs(pivot) > floor else math.copysign(floor, pivot)
            upper[i] = couple[i] / pivot
            p[i] = p[i + 1] * (q[i] / pivot) - lam
        twist = np.abs(np.array([s[i] + p[i] + lam for i in range(n)]))
        near = [v for j, v in enumerate(out) if abs(values[j] - value) <= close * values[0]]
        best, kept = None, -1.0
        for at in np.argsort(twist, kind="stable")[: 4 + 2 * len(near)]:
            z = np.zeros(n)
            z[at] = 1.0
            for i in range(at - 1, -1, -1):
                z[i] = -lower[i] * z[i + 1]
            for i in range(at, n - 1):
                z[i + 1] = -upper[i] * z[i]
            z /= math.sqrt(z @ z)
            for _ in range(2):
                for v in near:
                    z -= (v @ z) * v
            size = math.sqrt(z @ z)
            if size > kept:
                best, kept = z / size if size else z, size
            if kept > 0.5:
                break
        out.append(best)
    return np.array(out).T.reshape(n, len(values))


def _grid(vector: Column, grid: int) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * grid).cast("long"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _spread(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - total, exactly; as Python integers where 64 bits might not hold it."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + int(np.abs(total.astype(object)).max(initial=0)) < SAFE:
        return n * x - total
    return n * x.astype(object) - total.astype(object)


def _sums(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            part = x.sum(0) if len(x) * most < SAFE else x.astype(object).sum(0)
            n, total = n + len(x), [t + int(p) for t, p in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.int64()))], names=["n", "total"])

    return work


def _upper(r: np.ndarray | None, rows: np.ndarray, width: int) -> np.ndarray:
    """The triangle of QR over the rows of ``r`` and ``rows``."""
    both = rows if r is None else np.vstack([r, rows])
    out = np.zeros((width, width))
    found = np.linalg.qr(both, mode="r")
    out[: len(found)] = found
    return out


def _triangles(width: int, n: int, total: np.ndarray):
    """One triangle per partition: from centred rows, or with n = 0 from triangles."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if n:
                x = _matrix(batch.column("x"), width)
                for at in range(0, len(x), BLOCK):
                    r = _upper(r, (_spread(x[at : at + BLOCK], n, total) / n).astype(float), width)
            else:
                for part in batch.column("r"):
                    r = _upper(r, part.values.to_numpy(zero_copy_only=False).reshape(width, width), width)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["r"])

    return work


def triangle(fit: DataFrame, width: int, n: int, total: np.ndarray) -> np.ndarray:
    """R of the centred rows: one per partition, then merged ``FAN`` at a time until one is left."""
    r = stored(over_batches(fit.select("x"), _triangles(width, n, total), "r array<double>"), "triangles")
    left = r.count()
    while left > 1:
        left = -(-left // FAN)
        r = stored(over_batches(r.repartition(left), _triangles(width, 0, total), "r array<double>"), "triangles")
        left = r.count()
    return np.array(r.first()["r"]).reshape(width, width)


def _projected(n: int, total: np.ndarray, directions: np.ndarray, of_rows: bool):
    """The whitened coordinates, and for rows their id and deviation. ``directions`` has a column for each component, over its standard deviation."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _spread(_matrix(batch.column("x"), len(total)), n, total)
            white = (far / n).astype(float) @ directions
            white = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, directions.shape[1], dtype=np.int32)), pa.array(white.ravel()))
            if not of_rows:
                yield pa.RecordBatch.from_arrays([white], names=["white"])
                continue
            rough = (far.astype(float) ** 2).sum(1).max(initial=0.0)
            square = (far**2).sum(1) if rough < SAFE else [sum(int(v) ** 2 for v in row) for row in far]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(square, pa.int64()), white], names=["id", "deviation", "white"])

    return work


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, grid: int = GRID,
) -> DataFrame:
    """One row per usable input row and component: the id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``.

    Entries become whole numbers x = floor(grid * c). The covariance is that of the distinct x vectors; component k is its
    unit eigenvector with the k-th largest eigenvalue e, of either sign. ``whitened`` is the centred x along it over
    sqrt(e); ``deviation`` is the exact sum of (n x - S)**2 over the dimensions, S being the sum of all n distinct vectors;
    ``explained`` is e over the sum of all; ``identity_error`` is by how much the covariance of the whitened distinct vectors misses
    the identity.

    Distinct vectors are stored once. Each partition reduces its centred rows to a triangle by QR, block by block; triangles
    are merged sixteen at a time, so no task or driver holds more than a few matrices of dimension by dimension.

    Vectors that are NULL, empty or hold NULL, NaN or infinite entries are dropped. Where vectors have several lengths the most
    frequent one counts (the larger of equals) and the rest are dropped. Repeated rows and NULL ids get their rows like
    others, and the fit sees equal vectors once. Components without variance (fewer distinct vectors or dimensions than
    components) are left out; so one distinct vector, or an empty table, gives an empty result. Numbers that 64 bits
    cannot hold are an error.
    """
    x = F.col(f"`{vector_col}`")
    wide = x.cast("array<double>")
    usable = (F.size(wide) > 0) & F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(x.isNotNull()).where(usable).select(F.col(f"`{id_col}`").alias("id"), _grid(x, grid).alias("x"))
    out = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], out)
    width = common["width"]
    rows = rows.where(F.size("x") == width)
    fit = stored(rows.select("x").distinct(), "whiten-fit")

    parts = stored(over_batches(fit, _sums(width), "n long, total array<long>"), "whiten-sums")
    n = parts.agg(F.sum("n")).first()[0]
    sums = parts.select(F.posexplode("total").alias("place", "s")).groupBy("place").agg(F.sum("s").alias("s")).orderBy("place").collect()
    total = np.array([r["s"] for r in sums], dtype=np.int64)
    a, b, v = bidiagonal(triangle(fit, width, n, total))
    values = singular_values(a, b)
    kept = int((values[:components] > values[0] * max(n, width) * EPS).sum())
    if not kept:
        return vectors.sparkSession.createDataFrame([], out)
    explained = values[:kept] ** 2 / (values**2).sum()
    directions = v @ twisted_vectors(a, b, values[:kept]) / (values[:kept] / math.sqrt(n))

    white = over_batches(fit, _projected(n, total, directions, False), "white array<double>")
    pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
    covariance = white.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs))

    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, deviation long, white array<double>"
    return over_batches(rows, _projected(n, total, directions, True), schema).select(
        F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("white").alias("place", "whitened"),
    ).select(
        id_col, (F.col("place") + 1).alias("component"), "n", "deviation", "whitened",
        F.get(F.array(*[F.lit(float(x)) for x in explained]), F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"))
