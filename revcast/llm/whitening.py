"""Embedding whitening by QDWH spectral divide-and-conquer.

1. One pass gives the exact integer sums of all entries, one more the covariance of the centred
   vectors (each task adds up a matrix of its own; Spark adds the tasks' matrices by entry).
2. The covariance (vector length squared, whatever the number of rows) is split on the driver: the
   QDWH iteration gives the orthogonal polar factor U of ``V - shift``; ``(U + 1) / 2`` projects on
   the eigenvalues above the shift; a basis of that subspace and one of its complement turn V into
   two smaller matrices, and so on until each is a number or diagonal.
3. The components over the roots of their eigenvalues are broadcast, and each task whitens its rows.
   A last pass measures the covariance of what came out.

Entries are taken as integers ``x = floor(scale * c) + offset``; ``n * x - S`` is exact, so that
centring loses nothing however large the offset is.

Nulls and edge cases: a row whose vector is null, or holds a null, a non-finite entry or one whose x
is beyond a long, takes no part, nor does an empty vector or one whose length isn't the commonest (of
equally common lengths the longer is taken). A null id is kept as null; repeated rows count each;
components whose eigenvalue is under RANK of the largest are taken as none, so that constant
dimensions, a single row or equal rows give fewer components, or no rows; an empty table gives an
empty result; ``deviation`` is null where it exceeds a long; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm import common as C
from revcast.llm.vectors import commonest_length, finite_vectors, matrix

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: An eigenvalue below this share of the largest is rounding.
RANK = 1e-12
_EPS = float(np.finfo(float).eps)


# ------------------------------------------------------------------ QDWH
def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by QR-based dynamically weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:  # 1 over the inverse's Frobenius norm is never above the smallest singular value
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, _EPS / 8), 1.0)
    one = np.eye(n)
    for _ in range(30):
        gamma = (4 * (1 - low**2) / low**4) ** (1 / 3)
        root = math.sqrt(1 + gamma)
        a_ = root + math.sqrt(8 - 4 * gamma + 8 * (2 - low**2) / (low**2 * root)) / 2
        b_ = (a_ - 1) ** 2 / 4
        c_ = a_ + b_ - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(c_) * x, one]))
        new = b_ / c_ * x + (a_ - b_ / c_) / math.sqrt(c_) * q[:n] @ q[n:].T
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (a_ + b_ * low**2) / (1 + c_ * low**2), 1.0)
        if 1 - low < 10 * _EPS and moved < 1e-8:  # the next step would change it by the cube of that
            break
    return x


def _halves(v: np.ndarray, shift: float, random: np.random.Generator) -> tuple[float, np.ndarray, int]:
    """(what is left between the two subspaces, an orthogonal basis, size of the upper subspace)."""
    n = len(v)
    p = polar_factor(v - shift * np.eye(n))
    p = (p + p.T) / 4 + np.eye(n) / 2
    above = round(float(np.trace(p)))
    if not 0 < above < n:
        return math.inf, np.eye(n), 0
    up = np.linalg.qr(p @ random.standard_normal((n, above)))[0]
    down = random.standard_normal((n, n - above))
    basis = np.linalg.qr(np.hstack([p @ up, down - p @ down]))[0]
    return float(np.linalg.norm(basis[:, above:].T @ v @ basis[:, :above])), basis, above


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; the largest entry positive) of a symmetric matrix."""
    random = np.random.default_rng(7)
    size = float(np.linalg.norm(v)) or 1.0

    def split(v: np.ndarray) -> np.ndarray:
        n, diagonal = len(v), np.sort(np.diag(v))
        if n == 1 or np.linalg.norm(v - np.diag(np.diag(v))) <= _EPS / 4 * size:
            return np.eye(n)
        middle = sorted(range(1, n), key=lambda k: (abs(2 * k - n), k))[:6]
        shifts = [(diagonal[k - 1] + diagonal[k]) / 2 for k in middle]
        wide = float(np.linalg.norm(v - np.diag(np.diag(v)))) + diagonal[-1] - diagonal[0]
        shifts += [shifts[0] + wide * t for t in (0.01, -0.013, 0.07, -0.09, 0.3, -0.37)]
        best = (math.inf, np.eye(n), 0)
        for shift in shifts:  # a shift next to an eigenvalue leaves something between the halves
            best = min(best, _halves(v, shift, random), key=lambda x: x[0])
            if best[0] <= 8 * _EPS * size * math.sqrt(n):
                break
        _, basis, above = best
        if not above:
            return np.eye(n)  # no shift tells the eigenvalues apart: all equal to rounding
        out = np.zeros((n, n))
        for part in (slice(0, above), slice(above, n)):
            inner = basis[:, part].T @ v @ basis[:, part]
            out[:, part] = basis[:, part] @ split((inner + inner.T) / 2)
        return out

    vectors = split((v + v.T) / 2)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)
    return values[order], vectors


# ------------------------------------------------------------------ centred rows
@dataclass
class Centre:
    """n and the exact sums of x by dimension; ``wide``: n * x - S may exceed a long."""

    n: int
    sums: list[int]
    wide: bool
    scale: int
    offset: int

    def deviations(self, entries: np.ndarray) -> np.ndarray:
        """n * x - S for a matrix of entries: int64, or Python's integers if wide."""
        x = np.floor(self.scale * entries).astype(np.int64) + self.offset
        if self.wide:
            return x.astype(object) * self.n - np.array(self.sums, object)
        with np.errstate(over="ignore"):  # modulo 2**64; the difference itself fits
            return x * np.int64(self.n) - np.array([s - (s + (1 << 63)) // (1 << 64) * (1 << 64) for s in self.sums], np.int64)

    def centred(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(float)


def square_sums(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of integers."""
    if d.dtype == object:
        return [sum(e * e for e in row) for row in d.tolist()]
    high, rest = d >> 42, d & ((1 << 42) - 1)  # d = (high << 42) + (mid << 21) + low
    mid, low = rest >> 21, rest & ((1 << 21) - 1)
    part = [np.einsum("ij,ij->i", a, b).tolist() for a, b in ((high, high), (high, mid), (high, low), (mid, mid), (mid, low), (low, low))]
    return [(hh << 84) + (hm << 64) + (hl << 43) + (mm << 42) + (ml << 22) + ll for hh, hm, hl, mm, ml, ll in zip(*part)]


def centre_of(rows: DataFrame, length: int, scale: int = SCALE, offset: int = OFFSET) -> Centre:
    entries = rows.select(F.posexplode("v").alias("pos", "c")).select("pos", (F.floor(F.lit(float(scale)) * F.col("c")) + offset).alias("x"))
    found = entries.groupBy("pos").agg(F.count("x").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("pos").collect()
    n = found[0]["n"]
    return Centre(n, [int(r["s"]) for r in found], n * max(r["hi"] - r["lo"] for r in found) >= 1 << 62, scale, offset)


def covariance(rows: DataFrame, length: int, centre: Centre, turn: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the centred rows times ``turn``."""
    shared = rows.sparkSession.sparkContext.broadcast((centre, turn))

    def run(batches):
        centre, turn = shared.value
        total = np.zeros((turn.shape[1],) * 2)
        for batch in batches:
            y = centre.centred(centre.deviations(matrix(batch.column("v"), length))) @ turn
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "total"])

    sums = C.small_batches(rows).select("v").mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    return np.array([r["total"] for r in sums]).reshape((turn.shape[1],) * 2) / centre.n


# ------------------------------------------------------------------ the operator
@dataclass
class Whitening:
    """A fitted whitening: ``vectors`` (columns) and ``values`` of the components kept, ``trace`` of the covariance."""

    length: int
    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float


SCHEMA = "vec_id long, n long, deviation long, whitened array<double>"


def vectors_of(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their vectors' length."""
    kept = finite_vectors(rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v")), "v", float(1 << 62) / scale)
    length = commonest_length(kept, "v")
    return kept.filter(F.size("v") == length) if length else kept.limit(0), length


def fit(rows: DataFrame, length: int, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The whitening of ``rows`` (vec_id, v); None without rows."""
    if not length:
        return None
    centre = centre_of(rows, length, scale, offset)
    v = covariance(rows, length, centre, np.eye(length))
    values, vectors = eigen(v)
    kept = int(np.sum(values[:components] > max(RANK * values[0], 0.0)))
    return Whitening(length, centre, vectors[:, :kept], values[:kept], float(np.trace(v)))


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, n, deviation and the whitened vector of each row."""
    shared = rows.sparkSession.sparkContext.broadcast((model.length, model.centre, model.vectors / np.sqrt(model.values)))

    def run(batches):
        length, centre, turn = shared.value
        for batch in batches:
            d = centre.deviations(matrix(batch.column("v"), length))
            y = centre.centred(d) @ turn
            deviation = [s if s < 1 << 63 else None for s in square_sums(d)]
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * turn.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(np.full(len(y), centre.n)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))],
                names=["vec_id", "n", "deviation", "whitened"])

    return C.small_batches(rows).mapInArrow(run, SCHEMA)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all of them."""
    got = covariance(rows, model.length, model.centre, model.vectors / np.sqrt(model.values))
    return float(np.abs(got - np.eye(len(got))).max(initial=0.0))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    rows, length = vectors_of(C.table(spark, sf_dir, "embeddings"))
    model = fit(rows, length)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = transform(rows, model).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
                       F.lit(identity_error(rows, model)).alias("identity_error"))
