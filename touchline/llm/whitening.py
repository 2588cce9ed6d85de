"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

An entry ``c`` becomes ``floor(SCALE * c) + SHIFT``, a long. Sums per dimension are exact aggregates. Every task centres its vectors
and adds up their products; the tasks' matrices are summed entry by entry in one aggregation. The scatter of ``d`` dimensions is
factored on the driver: with the largest remaining diagonal entry as pivot, ``P'AP = LL'`` up to rounding, which also gives the rank.
Plane rotations then make the columns of ``L`` orthogonal (``L J = W``); as ``A = WW'``, the squared norms of the columns over the
number of rows are the eigenvalues of the covariance and the normalised columns its eigenvectors. The covariance itself is never
rotated, so small eigenvalues keep their digits.

Projections are written once; the covariance of what was written, centred before multiplying, is held against the identity.

Bounds: only matrices of ``d`` by ``d`` pass the driver, ``ENTRIES`` in all (``d`` up to 8,192), whatever the number of rows.

Cases: vectors that are NULL, empty or hold NULL, NaN or infinity are dropped; rows without id and repeated rows stay and count each
time. Vectors of different lengths are fitted apart. A direction without variance (rank below ``components``, as with one row or with
equal rows) has no component. Equal eigenvalues leave their components' directions open; the entry of largest size is positive in
each. Entries must fit a long after scaling; a deviation is a decimal of 38 digits. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.plans.materialize import materialize

SCALE, SHIFT = 1024, 100_000  # fixed values of the contract
COMPONENTS = 8
ENTRIES = 1 << 26
SWEEPS = 60


@dataclass
class Fit:
    """One vector length's fit: rows, exact sums, eigenvalues by falling size with their unit eigenvectors as rows, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``a[order][:, order] = L L'`` up to rounding; L is lower trapezoidal with as many columns as the rank."""
    a = np.array(a, np.float64)
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    floor = d * np.finfo(np.float64).eps * max(a.diagonal().max(initial=0.0), 0.0)
    left = a.diagonal().copy()
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > floor:
            return factor[:, :k], order
        for x in (order, left):
            x[[k, p]] = x[[p, k]]
        a[[k, p]] = a[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        factor[[k, p], :k] = factor[[p, k], :k]
        root = np.sqrt(left[k])
        factor[k, k] = root
        factor[k + 1 :, k] = (a[k + 1 :, k] - factor[k + 1 :, :k] @ factor[k, :k]) / root
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def _rounds(m: int):
    """Rounds of disjoint column pairs in which every two of ``m`` columns meet once (a tournament's circle)."""
    ring = list(range(m + m % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], ring[: half - 1 : -1], strict=True) if a < m and b < m]
        if pairs:
            yield np.array(pairs).T
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns turned in pairs until each two are orthogonal to rounding."""
    w = np.array(factor, np.float64)
    m = w.shape[1]
    rounds = list(_rounds(m))
    limit = np.sqrt(max(len(w), 1)) * np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        turned = False
        for left, right in rounds:
            p, q = w[:, left], w[:, right]
            a, b, c = np.einsum("ij,ij->j", p, p), np.einsum("ij,ij->j", q, q), np.einsum("ij,ij->j", p, q)
            turn = np.abs(c) > limit * np.sqrt(a * b)
            if not turn.any():
                continue
            turned = True
            zeta = (b - a)[turn] / (2 * c[turn])
            tan = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, tan)
            sin = cos * tan
            p, q = p[:, turn], q[:, turn]
            w[:, left[turn]], w[:, right[turn]] = cos * p - sin * q, sin * p + cos * q
        if not turned:
            return w
    raise ArithmeticError(f"columns not orthogonal after {SWEEPS} sweeps")


def eigen(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``scatter / n`` that are not zero, largest first, and their unit eigenvectors as rows."""
    factor, order = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(factor)
    norms = np.linalg.norm(turned, axis=0)
    by_size = np.argsort(-norms, kind="stable")
    vectors = np.zeros((turned.shape[1], len(scatter)))
    vectors[:, order] = (turned / norms).T
    vectors = vectors[by_size]
    largest = np.take_along_axis(vectors, np.argmax(np.abs(vectors), axis=1, keepdims=True), 1) if len(vectors) else np.ones((0, 1))
    return norms[by_size] ** 2 / n, vectors * np.where(largest < 0, -1.0, 1.0)


def _usable(v: Column) -> Column:
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))


def _by_length(column: pa.Array):
    """(length, row numbers, long matrix) of the scaled vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) + SHIFT
    first = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, flat[first[rows][:, None] + np.arange(d)]


def fit(vectors: DataFrame, vector: str = "embedding") -> dict[int, Fit]:
    """The fit of each vector length in ``vectors``."""
    rows = vectors.where(_usable(F.col(vector))).select(F.col(vector).alias("v"))

    def totals(batches):
        n, sums = defaultdict(int), {}
        for batch in batches:
            for d, at, x in _by_length(batch.column("v")):
                n[d] += len(at)
                sums[d] = sums.get(d, 0) + x.sum(axis=0)
        for d in sums:
            yield pa.RecordBatch.from_pydict({"d": [d] * d, "i": range(d), "n": [n[d]] * d, "s": sums[d]}, _schema("n", pa.int64()))

    found: dict[int, list] = defaultdict(list)
    for r in rows.mapInArrow(totals, "d int, i int, n long, s long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        found[r["d"]].append((r["i"], r["n"], r["s"]))
    if sum(d * d for d in found) > ENTRIES:
        raise ValueError(f"the scatter matrices would hold more than {ENTRIES} entries")
    means = {d: np.array([s / n for _, n, s in sorted(r)]) for d, r in found.items()}

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch.column("v")):
                centred = x - means[d]
                sums[d] = sums.get(d, 0) + centred.T @ centred
        for d, matrix in sums.items():
            for i in range(d):
                yield pa.RecordBatch.from_pydict({"d": [d] * (i + 1), "i": [i] * (i + 1), "n": range(i + 1), "s": matrix[i, : i + 1]}, _schema("n", pa.float64()))

    scatter = {d: np.zeros((d, d)) for d in found}
    for r in rows.mapInArrow(products, "d int, i int, n long, s double").groupBy("d", "i", "n").agg(F.sum("s").alias("s")).collect():
        scatter[r["d"]][r["i"], r["n"]] = scatter[r["d"]][r["n"], r["i"]] = r["s"]
    out = {}
    for d, entries in found.items():
        n = entries[0][1]
        values, components = eigen(scatter[d], n)
        out[d] = Fit(n, [s for _, _, s in sorted(entries)], values, components, float(np.trace(scatter[d])) / n)
    return out


def _schema(third: str, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("d", pa.int32()), ("i", pa.int32()), (third, pa.int64()), ("s", kind)])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of ``(n * x - sum) ** 2`` per row, exactly."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most < 1 << 62:
        off = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(off).max(initial=0)) ** 2 < 1 << 63:
            return (off * off).sum(axis=1).tolist()
    return [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    ``deviation`` is a decimal; ``identity_error`` is the largest entry, by size, of the whitened rows' covariance less the identity.
    """
    spark = vectors.sparkSession
    fits = {d: f for d, f in fit(vectors, vector).items() if len(f.values)}
    kept = {d: min(components, len(f.values)) for d, f in fits.items()}
    rows = vectors.where(_usable(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    out_type = pa.schema([("d", pa.int32()), ("deviation", pa.decimal128(38, 0)), ("w", pa.list_(pa.float64()))])

    def project(batches):
        for batch in batches:
            for d, at, x in _by_length(batch.column("v")):
                if d not in fits:
                    continue
                f = fits[d]
                k = kept[d]
                w = (x - np.array([s / f.n for s in f.sums])) @ f.vectors[:k].T / np.sqrt(f.values[:k])
                made = [pa.array([d] * len(at), pa.int32()), pa.array([Decimal(y) for y in _deviations(x, f.n, f.sums)], pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * k + 1, k), pa.int32()), pa.array(w.ravel()))]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), *made], ["id", *out_type.names])

    placed = materialize(rows.mapInArrow(project, f"id {kind}, d int, deviation decimal(38,0), w array<double>"), "whitened")
    known = spark.createDataFrame([(d, f.n, [float(v / f.trace) for v in f.values[: kept[d]]], _identity_error(placed, d, kept[d])) for d, f in fits.items()],
                                  "d int, n long, shares array<double>, identity_error double")
    wide = placed.join(F.broadcast(known), "d")  # one row per vector length
    return wide.select(F.col("id").alias(key), F.posexplode("w").alias("at", "whitened"), "n", "deviation", "shares", "identity_error").select(
        key, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at("shares", F.col("at") + 1).alias("explained"), "identity_error")


def _identity_error(placed: DataFrame, d: int, k: int) -> float:
    """Largest entry of the covariance of the rows of length ``d`` less the identity, centred before multiplying."""
    own = placed.where(F.col("d") == d)
    mean = own.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    off = [F.col("w")[i] - mean[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    entries = own.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(entries[at] - (i == j)) for at, (i, j) in enumerate(pairs))
