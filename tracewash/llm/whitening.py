"""Whitening of embeddings by their covariance's eigenvectors, found by Jacobi rotations.

Entries become integers, ``floor(1024 c) + 100000``, whose sums are exact.  One
pass sums them, one sums products of centred vectors, each task giving one
partial sum for each pair of dimensions.  The driver turns the covariance by
cyclic Jacobi rotations until what is off the diagonal vanishes against the
diagonal entries of its row and column, so that small eigenvalues are as
accurate as large ones.  The sorted, scaled eigenvectors go to all tasks, a
third pass measures the covariance of the result and the last gives it.

Scale: the driver holds two matrices of dimension squared, whatever the number
of vectors.  Inputs are merged, without a shuffle, to a few partitions for each
core before they are summed, so partial sums stay few.

Defined results: a vector that is null, empty or of another length than the most
frequent one (of two, the shorter), or that holds an entry that is null, not
finite or beyond 2^43, is dropped; the same vector twice counts twice.  A
component has an eigenvalue above 1e-12 of the largest, so constant or too few
vectors give fewer components or no rows.  A ``deviation`` that no long can hold
is null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Eigenvalues below this part of the largest are taken for rounding.
LEAST = 1e-12


def _integers(column: pa.Array, width: int):
    """Rows of ``column`` that remain, by place, and their integers."""
    import numpy as np
    import pyarrow.compute as pc

    right = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    flat = column.filter(right).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    fine = (np.abs(flat) <= 2.0**43).all(axis=1)
    return np.flatnonzero(right.to_numpy(zero_copy_only=False))[fine], np.floor(SCALE * flat[fine]).astype(np.int64) + SHIFT


def _few(vectors: DataFrame) -> DataFrame:
    return vectors.coalesce(4 * vectors.sparkSession.sparkContext.defaultParallelism)


def sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors ``v`` remain, and the sum of each dimension."""

    def run(batches):
        import numpy as np

        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            _, x = _integers(batch.column(0), width)
            total += np.append(len(x), x.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(total)], ["i", "s"])

    rows = _few(vectors.select("v")).mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()
    by = {r.i: r.s for r in rows}
    return by.get(0, 0), [by.get(i, 0) for i in range(1, width + 1)]


def scatter(vectors: DataFrame, width: int, mean, matrix=None):
    """Sums of products of centred vectors, or of what ``matrix`` makes of them, and their sums.

    Returns ``(products, sums)``.
    """
    import numpy as np

    many = width if matrix is None else matrix.shape[1]
    one, two = np.triu_indices(many)

    def run(batches):
        products, total = np.zeros((many, many)), np.zeros(many)
        for batch in batches:
            _, x = _integers(batch.column(0), width)
            y = x - mean if matrix is None else (x - mean) @ matrix
            products += y.T @ y
            total += y.sum(axis=0)
        i, j = np.append(one, np.arange(many)), np.append(two, np.full(many, -1))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.append(products[one, two], total))], ["i", "j", "s"])

    out, total = np.zeros((many, many)), np.zeros(many)
    for r in _few(vectors.select("v")).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        if r.j < 0:
            total[r.i] = r.s
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.s
    return out, total


def jacobi(a, most_sweeps: int = 60):
    """Eigenvalues and, as columns, unit eigenvectors of a symmetric matrix, unsorted.

    A sweep meets each pair of dimensions once, in rounds of pairs that share no
    dimension, as players are paired in a tournament; the rotations of a round
    are applied together.
    """
    import numpy as np

    a, d = np.array(a, dtype=np.float64), len(a)
    v, order = np.eye(d), np.arange(d + d % 2)
    least = LEAST**2 * np.abs(a).max(initial=0.0)
    for _ in range(most_sweeps):
        turned = False
        for _ in range(max(len(order) - 1, 0)):
            p, q = order[: len(order) // 2], order[::-1][: len(order) // 2]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < d], q[q < d]
            off, x, y = a[p, q], a[p, p], a[q, q]
            live = np.abs(off) > np.maximum(2.0**-52 * np.sqrt(np.abs(x)) * np.sqrt(np.abs(y)), least)
            p, q, off, x, y = p[live], q[live], off[live], x[live], y[live]
            if len(p):
                turned = True
                with np.errstate(over="ignore"):
                    theta = (y - x) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                for m in (a.T, a, v):  # rows, then columns, of the matrix; columns of the vectors
                    left, right = m[:, p] * c - m[:, q] * s, m[:, p] * s + m[:, q] * c
                    m[:, p], m[:, q] = left, right
                a[p, q] = a[q, p] = 0.0
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            return np.diag(a).copy(), v
    raise ArithmeticError("the rotations did not come to an end")


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for each vector that remains and each component.

    ``deviation`` is exact; ``identity_error`` is the largest absolute entry of
    the covariance of ``whitened`` less the identity, over all vectors.
    """
    import numpy as np

    name = vectors.schema[key].name
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    schema = f"k {rows.schema['k'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("k", name)
    found = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    n, total = sums(rows, found["width"]) if found else (0, [])
    if not n:
        return nothing
    width, mean = found["width"], np.array(total, dtype=np.float64) / n
    covariance = scatter(rows, width, mean)[0] / n
    values, turned = jacobi(covariance)
    order = np.argsort(-values, kind="stable")
    order = [k for k in order[:components] if values[k] > LEAST * max(values)]
    if not order:
        return nothing
    matrix = turned[:, order] / np.sqrt(values[order])
    explained = values[order] / np.trace(covariance)
    products, shift = scatter(rows, width, mean, matrix)
    error = float(np.abs(products / n - np.outer(shift / n, shift / n) - np.eye(len(order))).max())
    total = np.array(total, dtype=object)

    def run(batches):
        c = len(order)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keep, x = _integers(part.column(1), width)
                most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, total))
                far = n * x - total.astype(np.int64) if most < 2**63 else n * x.astype(object) - total
                most = max(int(far.max(initial=0)), -int(far.min(initial=0)))
                far = far if most * most * width < 2**63 else far.astype(object)
                deviation = [s if s < 2**63 else None for s in map(int, (far * far).sum(axis=1))]
                y = (x - mean) @ matrix
                k = pa.array(np.repeat(keep, c))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(k),
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(keep))),
                        pa.array(np.full(c * len(keep), n, np.int64)),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(keep)), c))),
                        pa.array(y.reshape(-1)),
                        pa.array(np.tile(explained, len(keep))),
                        pa.array(np.full(c * len(keep), error)),
                    ],
                    ["k", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("k", name)
