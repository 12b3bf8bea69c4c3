"""Embedding whitening by polarisation: covariances from variances of sums.

Entries become integers ``x = floor(64 c) + 1000000``, so every sum is exact:

1. one pass gives the number n of vectors and the sums S of every dimension;
2. with the centred values ``y = n x - S`` a second pass adds up, per task,
   ``y_i ** 2`` for every dimension and ``(y_i + y_j) ** 2`` for every pair; the
   tasks' sums are added by Spark as base 2**32 digits, so they never overflow;
3. ``cov(i, j) = (var(y_i + y_j) - var(y_i) - var(y_j)) / 2`` assembles the
   matrix on the driver (dimensions squared, whatever the rows), divided once
   in whole numbers, and ``eigh`` gives the components;
4. a third pass projects every vector and measures the covariance of the result
   against the identity; a fourth returns the rows.

Defined cases: null vectors and those that hold null, NaN or infinite entries
are left out; so are vectors of another length than the most frequent one (of
equally frequent ones the longest), empty vectors among them, and 64 c is held
within +-2**62.  Repeated rows count as often as they stand, null ids keep their
row.  Components whose eigenvalue is zero to double precision (one vector, equal
vectors, dependent dimensions) have no scale and are left out; without any
component, or for an empty table, there are no rows.  A deviation beyond a long
is null.  Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
DIGITS = 6                  # base 2**32 digits of a sum, the last one signed
CELLS = 1 << 20             # numbers of a block of rows


# ---- whole numbers ----------------------------------------------------------

def whole(c: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as int64, for finite doubles."""
    v = np.floor(np.clip(np.asarray(c, np.float64), -2.0 ** 56, 2.0 ** 56) * SCALE)
    return v.astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S, as int64 where all fit with room for a sum of two, else as
    Python integers."""
    big = max((abs(int(v)) for v in s), default=0)
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * top + big < 2 ** 61:
        return x * np.int64(n) - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def sum_of_squares(z: np.ndarray) -> list[int]:
    """Exact sums of squares of the columns."""
    if z.dtype == object:
        return [int(v) for v in (z * z).sum(0)] if len(z) else [0] * z.shape[1]
    a = np.abs(z)
    top = int(a.max(initial=0))
    if top * top * max(len(z), 1) < 2 ** 63:
        return (z * z).sum(0).tolist()
    out = [0] * z.shape[1]
    for at in range(0, len(z), 8192):  # three limbs of 24 bits, whose products add up in 64 bits
        limb = [(a[at:at + 8192] >> np.int64(24 * k)) & np.int64(2 ** 24 - 1) for k in range(3)]
        for i in range(3):
            for j in range(i, 3):
                for col, v in enumerate((limb[i] * limb[j]).sum(0).tolist()):
                    out[col] += v << (24 * (i + j) + (i != j))
    return out


def digits(v: int) -> list[int]:
    """Base 2**32 digits, lowest first; sums of them stay within a long for 2**31
    tasks."""
    return [(v >> 32 * k) & 0xFFFFFFFF for k in range(DIGITS - 1)] + [v >> 32 * (DIGITS - 1)]


def number(d) -> int:
    return sum(int(v) << 32 * k for k, v in enumerate(d))


def _digit_rows(keys: list[int], values: list[int]) -> pa.RecordBatch:
    cols = list(zip(*[digits(v) for v in values])) if values else [()] * DIGITS
    return pa.RecordBatch.from_pydict(
        {"key": pa.array(keys, pa.int64()),
         **{f"d{k}": pa.array(cols[k], pa.int64()) for k in range(DIGITS)}})


_DIGIT_SCHEMA = "key long, " + ", ".join(f"d{k} long" for k in range(DIGITS))


def _added(rows: DataFrame) -> dict[int, int]:
    """key -> sum; as many rows as there are keys, whatever the data."""
    out = rows.groupBy("key").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)])
    return {r["key"]: number([r[f"d{k}"] for k in range(DIGITS)]) for r in out.collect()}


# ---- passes -----------------------------------------------------------------

def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id, v: the vectors without null or non-finite entries, of the most
    frequent length; and that length."""
    v = F.col("v")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .where(F.coalesce(ok, F.lit(False)))
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = first.d if first else 0
    return rows.where(F.size("v") == d), d


def _blocks(batch: pa.RecordBatch, d: int):
    """(ids, matrix) of a batch, in blocks of about ``CELLS`` numbers."""
    step = max(1, CELLS // max(d, 1))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False) \
            .astype(np.float64).reshape(part.num_rows, d)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and S."""
    def per_task(batches):
        n, total = 0, [0] * d
        for b in batches:
            for _, c in _blocks(b, d):
                x = whole(c)
                n += len(x)
                # high and low halves, so that no column sum overflows
                high, low = (x >> np.int64(32)).sum(0).tolist(), (x & np.int64(0xFFFFFFFF)).sum(0).tolist()
                total = [t + (h << 32) + w for t, h, w in zip(total, high, low)]
        if n:
            yield _digit_rows([-1, *range(d)], [n, *total])

    got = _added(rows.mapInArrow(per_task, _DIGIT_SCHEMA))
    return got.get(-1, 0), [got.get(i, 0) for i in range(d)]


def squares(rows: DataFrame, d: int, n: int, s: list[int]) -> dict[int, int]:
    """key i * d + j, i <= j: the sum of squares of y_i (i = j) or y_i + y_j."""
    def per_task(batches):
        acc: list[list[int]] | None = None
        for b in batches:
            for _, c in _blocks(b, d):
                y = centred(whole(c), n, s)
                if acc is None:
                    acc = [[0] * (d - i) for i in range(d)]
                for i in range(d):
                    z = y[:, i:i + 1] + y[:, i:]
                    z[:, 0] = y[:, i]
                    acc[i] = [a + v for a, v in zip(acc[i], sum_of_squares(z))]
        if acc is not None:
            for i in range(d):
                yield _digit_rows([i * d + j for j in range(i, d)], acc[i])

    return _added(rows.mapInArrow(per_task, _DIGIT_SCHEMA))


@dataclass
class Whitening:
    """What is fitted: all of it is dimensions squared at most."""

    n: int
    s: list[int]
    vectors: np.ndarray         # one column per component
    values: np.ndarray          # eigenvalues, falling
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        y = centred(x, self.n, self.s)
        return (y.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = centred(x, self.n, self.s)
        return [v if v < 2 ** 63 else None for v in sum_of_squares(y.T)]


def covariance(squared: dict[int, int], d: int, n: int) -> np.ndarray:
    """Covariance of x from the sums of squares: the centred values are n times
    too large and the sums n times the mean, hence n ** 3."""
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            twice = 2 * squared[i * d + i] if i == j else \
                squared[i * d + j] - squared[i * d + i] - squared[j * d + j]
            out[i, j] = out[j, i] = twice / (2 * n ** 3)  # of integers: rounded once
    return out


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    n, s = sums(rows, d) if d else (0, [])
    if not n:
        return None
    v = covariance(squares(rows, d, n, s), d, n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(components, int((values > max(values[0], 0) * d * np.finfo(float).eps).sum()))
    if not keep:
        return None
    values, vectors = values[:keep], np.ascontiguousarray(vectors[:, :keep])
    largest = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[largest, np.arange(keep)] < 0, -1.0, 1.0)
    return Whitening(n, s, vectors, values, values / np.trace(v))


def identity_error(rows: DataFrame, d: int, w: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the
    identity, measured on all rows."""
    k = len(w.values)

    def per_task(batches):
        acc = np.zeros((k + 1, k))
        for b in batches:
            for _, c in _blocks(b, d):
                p = w.project(whole(c))
                acc[0] += p.sum(0)
                acc[1:] += p.T @ p
        yield pa.RecordBatch.from_pydict({"key": pa.array(np.arange(acc.size)),
                                          "v": pa.array(acc.ravel())})

    got = rows.mapInArrow(per_task, "key long, v double").groupBy("key").agg(F.sum("v").alias("v"))
    flat = np.zeros((k + 1) * k)
    for r in got.collect():
        flat[r.key] = r.v
    m = flat.reshape(k + 1, k) / w.n
    return float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(k)).max())


OUT = ("id {kind}, component int, n long, deviation long, whitened double, explained double, "
       "identity_error double")


def whiten(df: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error:
    one row per usable vector and component."""
    kind = df.schema[id_col].dataType.simpleString()
    rows, d = usable(df, id_col, vector_col)
    w = fit(rows, d, components)
    if w is None:
        return df.sparkSession.createDataFrame([], OUT.format(kind=kind))
    error, k = identity_error(rows, d, w), len(w.values)

    def per_task(batches):
        for b in batches:
            for ids, c in _blocks(b, d):
                x = whole(c)
                at, m = np.repeat(np.arange(len(x)), k), len(x)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, w.n)), pa.array(w.deviations(x), pa.int64()).take(pa.array(at)),
                     pa.array(w.project(x).ravel()), pa.array(np.tile(w.explained, m)),
                     pa.array(np.full(m * k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(per_task, OUT.format(kind=kind))
