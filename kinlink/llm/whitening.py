"""Embedding whitening by a bidiagonal qd solver.

Each entry c of a vector becomes the whole number ``floor(64 * c) + 1000000``.  Sums of
these are exact, and so are ``n * x - S``; divided by n they are the centred rows.

*Blockwise QR.*  Tasks reduce their centred rows, block by block, to a triangle R, and
triangles are stacked and reduced again, ``FAN_IN`` at a time, until one is left.  No
covariance is formed, so small singular values keep their accuracy.

*Bidiagonal.*  Householder reflections from both sides make the last triangle bidiagonal;
the right ones are kept.

*dqds.*  The differential quotient-difference algorithm with shifts finds the singular
values from the bidiagonal's squared entries.  No subtraction in it loses relative
accuracy but the shift's, which is kept below the smallest value.

*Twisted factorisations.*  For each singular value the stationary and the progressive
transform of ``B'B`` meet at the index where their twist is least; the vector follows
from there by multiplications.  Where values lie close together, vectors are made
orthogonal to those before, and refined by the same factorisations.

The last triangle has as many rows as vectors have entries: a bound that does not
grow with the rows.  Vectors that are null, or hold null, NaN or infinite entries, are
dropped; so are those of another length than most have (the longer of equally frequent
ones stays).  Directions without variance have no whitened value and are left out.  Repeated
rows, null ids and other columns take part like any: each row gives its own.  No rows, or all
of them alike, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Rows reduced at a time; triangles stacked at a time.
BLOCK, FAN_IN = 4096, 16


def householder_bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, v): diagonal and upper diagonal of an upper bidiagonal B, and orthogonal v with ``r'r = v B'B v'``."""
    a = np.array(r, float)
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        w = x.copy()
        largest = np.abs(x).max(initial=0.0)
        if largest == 0.0 or not np.any(x[1:]):
            return w, 0.0
        w /= largest
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w, 2.0 / float(w @ w)

    for k in range(n):
        w, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(w, w @ a[k:, k:])
        if k < n - 2:
            w, beta = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """One step: the new q and e, the least of the d, and whether only the last of them is negative."""
    n = len(q)
    nq, ne = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        nq[i] = d + e[i]
        if not d >= 0.0 or not nq[i] > 0.0:
            return nq, ne, min(least, -1.0), False
        t = q[i + 1] / nq[i]
        ne[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    nq[n - 1] = d
    return nq, ne, least, True


def _shift(q: np.ndarray, w: np.ndarray, least: float) -> float:
    """A guess at the smallest value from the end of the arrays: the smaller root of the last two rows, less its coupling to the rest."""
    a, b, c2 = q[-2] + (w[-2] if len(w) > 1 else 0.0), q[-1] + w[-1], q[-2] * w[-1]
    half = (a - b) / 2
    root = b - c2 / (half + np.copysign(np.hypot(half, np.sqrt(c2)), half if half else 1.0)) if c2 else min(a, b)
    return max(0.0, min(least, root, q[-1])) * (1 - 1e-9)


def squared_singular_values(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The squares of the singular values of the bidiagonal (d, e), largest first, by dqds with deflation."""
    eps = np.finfo(float).eps
    out: list[float] = []
    # parts between zero entries of e are solved by themselves
    largest = max(np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0))
    cuts = [0, *(int(i) + 1 for i in np.flatnonzero(np.abs(e) <= np.finfo(float).tiny ** 0.5 * max(largest, 1.0))), len(d)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        q, w = np.asarray(d[a:b], float) ** 2, np.asarray(e[a : b - 1], float) ** 2
        if len(q) > 1 and np.any(q == 0.0):
            # a zero on the diagonal: one step without a shift brings an exact zero to the end
            q = np.maximum(q, np.finfo(float).tiny * max(1.0, q.max()))
        if len(q) > 1 and q[0] < q[-1]:
            q, w = q[::-1].copy(), w[::-1].copy()  # graded from large to small; B'B of the reversal has the same values
        total, shift, steps, tries = 0.0, 0.0, 0, 0
        while len(q):
            n = len(q)
            if n == 1:
                out.append(total + q[0])
                break
            if w[-1] <= eps**2 * (total + q[-1]) or w[-1] <= np.finfo(float).tiny:
                out.append(total + q[-1])
                q, w, shift = q[:-1], w[:-1], 0.0
                continue
            if steps > 100 * len(d) + 100:
                raise ArithmeticError("dqds did not converge")
            steps += 1
            nq, ne, least, late = _dqds(q, w, shift)
            if least < 0.0:
                # only the last one negative: the shift was too large by about as much
                tries += 1
                shift = 0.0 if tries > 3 else max(0.0, shift + least) * (1 - 1e-9) if late else shift / 4
                continue
            q, w, total, tries = nq, ne, total + shift, 0
            shift = _shift(q, w, least) if n > 1 else 0.0
    return np.sort(np.array(out))[::-1]


def twisted_vector(d: np.ndarray, e: np.ndarray, value: float) -> np.ndarray:
    """The unit vector of ``B'B`` for the eigenvalue ``value``, from the twisted factorisation at the least twist."""
    n = len(d)
    tiny = np.finfo(float).tiny ** 0.5 * max(1.0, float(np.max(d * d, initial=0.0)))
    q, w = d * d, e * e
    # stationary: L D L' - value from the top; progressive: U D U' - value from the bottom
    s, up = np.empty(n), np.empty(n)
    low, high = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = q[i] + s[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        low[i] = d[i] * e[i] / pivot
        s[i + 1] = w[i] * (s[i] / pivot) - value
    up[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = w[i] + up[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        high[i] = d[i] * e[i] / pivot
        up[i] = q[i] * (up[i + 1] / pivot) - value
    twist = s + up + value
    r = int(np.argmin(np.abs(twist)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -high[i] * z[i]
    largest = np.abs(z).max()
    z /= largest if np.isfinite(largest) and largest > 0 else 1.0
    return z / np.linalg.norm(z)


def _another(d: np.ndarray, e: np.ndarray, value: float, group: np.ndarray, seed: int) -> np.ndarray:
    """A vector for a value of several vectors, orthogonal to those of the group: inverse iteration from any start in the rest of the space."""
    q, w = d * d, np.concatenate([[0.0], e * e])
    off = d[:-1] * e
    near = np.diag(q + w - value * (1 + 4 * np.finfo(float).eps)) + np.diag(off, 1) + np.diag(off, -1)
    near[np.diag_indices_from(near)] += np.finfo(float).eps * np.abs(near).max() * 1e-2
    x = np.random.default_rng(seed).standard_normal(len(d))
    for _ in range(3):
        x = x - group @ (group.T @ x)
        x = np.linalg.solve(near, x / np.linalg.norm(x))
        x /= np.linalg.norm(x)
        x = x - group @ (group.T @ x)
        x /= np.linalg.norm(x)
    return x


def right_singular(r: np.ndarray, close: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, largest first; their right vectors as columns) of a triangle.

    close: values whose relative distance is less form a group, whose vectors are made orthogonal one after another.
    """
    d, e, v = householder_bidiagonal(r)
    values = squared_singular_values(d, e)
    n = len(d)
    z = np.zeros((n, n))
    # parts of B that hang together by no entry have vectors of their own
    size = max(np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0))
    cuts = [0, *(int(i) + 1 for i in np.flatnonzero(np.abs(e) <= np.finfo(float).eps * size * 1e-3)), n]
    own: list[tuple[float, np.ndarray]] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = squared_singular_values(d[a:b], e[a : b - 1])
        begin = 0
        vectors = np.zeros((b - a, b - a))
        for k, value in enumerate(part):
            if k and part[k - 1] - value > close * part[k - 1]:
                begin = k
            x = twisted_vector(d[a:b], e[a : b - 1], value)
            group = vectors[:, begin:k]
            if k > begin:
                own_part = x - group @ (group.T @ x)
                if np.linalg.norm(own_part) < 0.5:
                    own_part = _another(d[a:b], e[a : b - 1], value, group, k)
                x = own_part - group @ (group.T @ own_part)
            vectors[:, k] = x / np.linalg.norm(x)
            full = np.zeros(n)
            full[a:b] = vectors[:, k]
            own.append((float(value), full))
    own.sort(key=lambda t: -t[0])
    for k, (value, x) in enumerate(own):
        values[k], z[:, k] = value, x
    # what rounding has left between close vectors goes by one polar step: each moves by less than that
    z = z @ (1.5 * np.eye(n) - 0.5 * (z.T @ z))
    return values, v @ z


def _whole(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, width)


def _sums(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(place, s, n): the rows' sums by place, as exact decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in batches:
            x = _whole(batch.column(0), width)
            total = [t + int(s) for t, s in zip(total, x.sum(0), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([n] * width, pa.int64())], names=["place", "s", "n"])

    return run


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """``x - s / n`` with one rounding: n * x - s is exact in 64 bits up to 10^12 rows of such numbers."""
    return (n * x - s).astype(float) / n


def _triangles(width: int, n: int, s: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for batch in batches:
            x = _whole(batch.column(0), width)
            for at in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.vstack([r, centred(x[at : at + BLOCK], n, s)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    return run


def _stacked(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        r = np.vstack([np.frombuffer(b, float).reshape(-1, width) for b in group.sort_values("part")["r"]])
        return pd.DataFrame({"part": group["to"].iloc[:1], "r": [np.linalg.qr(r, mode="r").tobytes()]})

    return run


def triangle(rows: DataFrame, width: int, n: int, s: np.ndarray) -> np.ndarray:
    """The triangle R of all centred rows of (x)."""
    parts = saved(rows.select("x").mapInArrow(_triangles(width, n, s), "part long, r binary"), "triangles")
    while parts.count() > FAN_IN:
        numbered = parts.withColumn("to", F.floor(F.col("part") / FAN_IN))
        fewer = saved(numbered.groupBy("to").applyInPandas(_stacked(width), "part long, r binary"), "triangles")
        discard(parts)
        parts = fewer
    found = parts.orderBy("part").collect()  # at most FAN_IN triangles
    discard(parts)
    r = np.linalg.qr(np.vstack([np.frombuffer(row["r"], float).reshape(-1, width) for row in found]), mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))])


def _projected(width: int, n: int, s: np.ndarray, directions: np.ndarray):
    """(vec_id, deviation, whitened) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(1), width)
            for at in range(0, len(x), BLOCK):
                own = x[at : at + BLOCK]
                off = n * own - s
                if float(np.abs(off).max(initial=0)) ** 2 * width < 2.0**62:
                    deviation = [Decimal(int(v)) for v in (off * off).sum(1)]
                else:
                    deviation = [Decimal(sum(int(v) * int(v) for v in row)) for row in off]
                w = centred(own, n, s) @ directions
                ends = np.arange(len(own) + 1, dtype=np.int32) * directions.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(own)), pa.array(deviation, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.reshape(-1)))], names=["vec_id", "deviation", "whitened"])

    return run


def _products(k: int):
    """The sum of the outer products of a task's whitened rows; their mean is nought, as n * x - S add up to nought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((k, k)), False
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total, any_ = total + w.T @ w, True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.reshape(-1))], names=["place", "v"])

    return run


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of (vec_id, embedding): up to ``components`` rows for each vector, the largest variance first."""
    spark = df.sparkSession
    id_type = df.schema["vec_id"].dataType.simpleString()
    entries = F.col("embedding").cast("array<double>")
    finite = entries.isNotNull() & (F.size(entries) > 0) & F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    scaled = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    rows = saved(df.filter(finite).select("vec_id", scaled.alias("x")), "vectors")
    none = spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    most = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if most is None:
        return none
    width = most["width"]
    rows = rows.filter(F.size("x") == width)
    told = rows.select("x").mapInArrow(_sums(width), "place int, s decimal(38,0), n long").groupBy("place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("place").collect()  # a row for each place
    n, s = told[0]["n"], np.array([int(t["s"]) for t in told], np.int64)

    r = triangle(rows, width, n, s)
    values, vectors = right_singular(r)
    trace = float((r * r).sum())
    kept = min(components, int((values > trace * width * np.finfo(float).eps).sum()) if trace > 0 else 0)
    if not kept:
        return none
    directions = vectors[:, :kept] / np.sqrt(values[:kept] / n)
    out = saved(rows.select("vec_id", "x").mapInArrow(_projected(width, n, s, directions), f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>"), "whitened")
    products = out.select("whitened").mapInArrow(_products(kept), "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()  # components squared
    error = float(np.abs(np.array([p["v"] for p in products]).reshape(kept, kept) / n - np.eye(kept)).max())
    shares = F.array(*[F.lit(float(v / trace)) for v in values[:kept]])
    named = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return named.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
