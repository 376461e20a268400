"""Whitening of embeddings: the leading principal directions, each scaled to variance one.

Entries are taken as the integers ``floor(256 * c)``. The directions are those of the
distinct vectors. Their centred rows are never multiplied with each other: every task
reduces its rows blockwise by QR to one triangle, triangles are joined in a tree of
``FAN`` by QR again, and the last one, whose size is the dimension only, has the singular
values and right singular vectors of all rows. It is made bidiagonal by Householder
reflections; the dqds iteration (here with shifts that never pass the smallest value, as
the sum of reciprocals of a plain sweep bounds it) finds all squared singular values to high
relative accuracy; a twisted factorisation at each leading value gives its vector.

Defined cases: a null vector or one with a null, NaN or infinite entry is left out; shorter
vectors are filled with zeros up to the longest; repeated vectors are fitted once and
returned each; a direction of no variance (a singular value at rounding of the largest) is
not returned, so a single distinct vector gives no rows; equal eigenvalues have some
orthonormal directions; a deviation beyond the range of a long is null; extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.store import fresh, keep

COMPONENTS = 4
SCALE = 256
FAN = 16
ROWS = 4096  # rows of one QR step
EPS = np.finfo(float).eps


# d x d work, independent of the number of rows

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper diagonal of ``r`` after Householder reflections, and the right reflections."""
    r, d, right = r.copy(), len(r), []
    for i in range(d):
        reflect(r[i:, i:], r[i:, i])
        if i < d - 1:
            right.append(reflect(r[i:, i + 1:].T, r[i, i + 1:]))
    return np.diag(r).copy(), np.diag(r, 1).copy(), right


def reflect(block: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Reflect the rows of ``block`` so that ``x`` becomes a multiple of the first unit vector; gives the unit normal."""
    v = x.copy()
    top = np.abs(v).max(initial=0.0)
    if top == 0 or len(v) == 1:
        return np.zeros(len(v))
    v /= top
    v[0] += math.copysign(np.linalg.norm(v), v[0])
    v /= np.linalg.norm(v)
    block -= 2.0 * np.outer(v, v @ block)
    return v


def lifted(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """A vector of the bidiagonal form in the space of the rows."""
    z = z.copy()
    for i in range(len(right) - 1, -1, -1):
        z[i + 1:] -= 2.0 * right[i] * (right[i] @ z[i + 1:])
    return z


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform and its remainders; nothing if the shift is beyond the smallest value."""
    d, down, up, rest = q[0] - shift, [], [], []
    for i in range(len(e)):
        rest.append(d)
        if d < 0:
            return None
        top = d + e[i]
        if top == 0:
            return None
        ratio = q[i + 1] / top
        down.append(top)
        up.append(e[i] * ratio)
        d = d * ratio - shift
    rest.append(d)
    return None if d < 0 else (down + [d], up, rest)


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the upper bidiagonal matrix, falling."""
    values = []
    blocks = [((a * a).tolist(), (b * b).tolist(), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while q:
            small = [i for i in range(len(e)) if e[i] <= EPS * EPS * (q[i] + moved) or e[i] <= EPS * EPS * (q[i + 1] + moved)]
            if small:
                cut = small[-1]
                if cut < len(e) - 1:  # both halves go on by themselves
                    blocks.append((q[:cut + 1], e[:cut], moved))
                    q, e = q[cut + 1:], e[cut + 1:]
                    continue
                values.append(q[-1] + moved)
                q, e = q[:-1], e[:-1]
                continue
            if len(q) == 1:
                values.append(q[0] + moved)
                break
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            plain = sweep(q, e, 0.0)
            q, e, rest = plain
            if min(rest) <= 0 or max(rest) / min(rest) > 1e300:
                continue
            shift = (1 - 4 * EPS * len(rest)) / sum(1.0 / x for x in rest)  # at most the smallest value
            done = sweep(q, e, shift) if shift > EPS * EPS * moved else None
            if done:
                q, e, _ = done
                moved += shift
    return np.sort(np.array(values))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of the squared bidiagonal matrix next to ``value``, by its twisted factorisation."""
    n = len(a)
    pivot, low = a * a, b / a[:-1]
    tiny = EPS * EPS * max(value, pivot.max())
    s, p = np.empty(n), np.empty(n)
    lower, upper = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        top = pivot[i] + s[i]
        top = top if abs(top) > tiny else tiny
        lower[i] = low[i] * pivot[i] / top
        s[i + 1] = lower[i] * low[i] * s[i] - value
    p[-1] = pivot[-1] - value
    for i in range(n - 2, -1, -1):
        top = pivot[i] * low[i] * low[i] + p[i + 1]
        top = top if abs(top) > tiny else tiny
        upper[i] = low[i] * pivot[i] / top
        p[i] = p[i + 1] * pivot[i] / top - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def solved(a: np.ndarray, b: np.ndarray, value: float, y: np.ndarray) -> np.ndarray:
    """One step of inverse iteration near ``value``, for vectors of very close values."""
    full = np.diag(a) + np.diag(b, 1)
    near = value * (1 + 8 * EPS) + EPS * EPS
    return np.linalg.solve(full.T @ full - near * np.eye(len(a)), y)


def directions(r: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``r`` (all, falling) and its leading right singular vectors as rows."""
    if not r.size or not np.abs(r).max():
        return np.zeros(len(r)), np.zeros((0, len(r)))
    scale = np.abs(r).max()
    a, b, right = bidiagonal(r / scale)
    tiny = EPS * max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < tiny, tiny, a)
    b = np.where(np.abs(b) <= EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:])), 0.0, b)
    cuts = np.concatenate([[0], np.flatnonzero(b == 0) + 1, [len(a)]])
    found = [(v, lo, hi) for lo, hi in zip(cuts, cuts[1:]) for v in dqds(a[lo:hi], b[lo:hi - 1])]
    found.sort(key=lambda f: -f[0])
    values, made = np.array([f[0] for f in found]), []
    for value, lo, hi in found[:most]:
        if math.sqrt(value) <= len(a) * EPS * math.sqrt(values[0]) * 4:
            break
        z = twisted(a[lo:hi], b[lo:hi - 1], value)
        same = [o[lo:hi] for v, l, o in made if l == lo and v - value < 1e-4 * v]
        for trial in range(4):
            for o in same * 2:
                z = z - o * (o @ z)
            size = np.linalg.norm(z)
            if size > 0.1 and trial == 0 or size > 1e-3 and trial:
                break
            z = solved(a[lo:hi], b[lo:hi - 1], value, np.random.default_rng(trial).standard_normal(hi - lo))
            z /= np.linalg.norm(z)
        whole = np.zeros(len(a))
        whole[lo:hi] = z / np.linalg.norm(z)
        made.append((value, lo, whole))
    vectors = np.array([lifted(z, right) for _, _, z in made]).reshape(len(made), len(r))
    if len(vectors):
        vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    return values * scale * scale, vectors


# rows

def whole_numbers(df: DataFrame, vector: str) -> F.Column:
    """The vector as integers, null if it is left out."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def column_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and the sum of each dimension."""
    def run(batches):
        total, n, top = 0, 0, 0
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                n, top = n + len(x), max(top, int(np.abs(x).max(initial=0)))
                if top * n >= 2**62:
                    raise OverflowError("sums of the vectors pass 64 bits")
                total = total + x.sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], names=["i", "s", "n"])

    rows = fit.mapInArrow(run, "i int, s long, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").toArrow()
    return (rows["n"][0].as_py(), rows["s"].to_numpy()) if len(rows) else (0, np.zeros(0, np.int64))


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangle of a QR factorisation, with zero rows below where there are fewer rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    if int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0)) >= 2**62:
        return x - sums / n
    return (n * x - sums) / n


def reduced(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """The triangle of all centred rows."""
    def run(batches):
        from pyspark import TaskContext

        r, held, size = np.zeros((0, len(sums))), [], 0
        for batch in batches:
            held.append(centred(matrix(batch.column(0)), n, sums))
            size += len(batch)
            if size >= max(ROWS, 4 * len(sums)):
                r, held, size = triangle(np.vstack([r, *held])), [], 0
        if size or len(r):
            r = triangle(np.vstack([r, *held]))
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def join(table: pa.Table) -> pa.Table:
        r = triangle(matrix(table["r"].combine_chunks()).reshape(-1, len(sums)))
        return pa.table({"part": [table["part"][0].as_py() // FAN], "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    rows = keep(fit.mapInArrow(run, "part long, r array<double>"), "triangles")
    while rows.count() > FAN:
        rows = keep(rows.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(join, "part long, r array<double>"), "triangles")
    last = rows.orderBy("part").toArrow()
    return triangle(matrix(last["r"].combine_chunks()).reshape(-1, len(sums)))


def covariance(fit: DataFrame, n: int, sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The covariance of the whitened distinct rows."""
    k = weights.shape[1]

    def run(batches):
        total, found = np.zeros((k, k)), False
        for batch in batches:
            w = centred(matrix(batch.column(0)), n, sums) @ weights
            total, found = total + w.T @ w, True
        if found:
            yield pa.record_batch([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], names=["i", "s"])

    rows = fit.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toArrow()
    return rows["s"].to_numpy().reshape(k, k) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The exact sum of squares of ``n * x - sums`` of each row."""
    wide = int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0)) >= 2**62
    apart = x.astype(object) * n - sums.astype(object) if wide else n * x - sums
    about = (apart.astype(float) ** 2).sum(axis=1)
    sure = about < 9e18
    out = [None] * len(x)
    for i, v in zip(np.flatnonzero(sure), (apart[sure].astype(np.int64) ** 2).sum(axis=1).tolist()):
        out[i] = v
    for i in np.flatnonzero(~sure & (about < 1e19)):
        v = sum(int(y) ** 2 for y in apart[i])
        out[i] = v if v < 2**63 else None
    return pa.array(out, pa.int64())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each row and leading component."""
    name = fresh(df, "x")
    rows = df.select(F.col(key), whole_numbers(df, vector).alias(name)).where(F.col(name).isNotNull())
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    low, high = rows.agg(F.min(F.size(name)), F.max(F.size(name))).first()
    if low != high:
        rows = rows.withColumn(name, F.concat(name, F.array_repeat(F.lit(0).cast("long"), F.lit(high) - F.size(name))))
    if not high:
        return df.sparkSession.createDataFrame([], schema)
    fit = keep(rows.select(name).distinct(), "fit")
    n, sums = column_sums(fit)
    values, vectors = directions(reduced(fit, n, sums), most)
    if not len(vectors):
        return df.sparkSession.createDataFrame([], schema)
    k = len(vectors)
    variance = values[:k] / n
    explained = variance / (values.sum() / n)
    weights = vectors.T / np.sqrt(variance)
    error = float(np.abs(covariance(fit, n, sums, weights) - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.record_batch([batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), n)),
                                   deviations(x, n, sums).take(at), pa.array((centred(x, n, sums) @ weights).ravel()), pa.array(np.tile(explained, len(x))),
                                   pa.array(np.full(k * len(x), error))], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
