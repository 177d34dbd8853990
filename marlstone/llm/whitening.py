"""Embedding whitening by a tree of QR factorisations (TSQR): no covariance is formed on the way to the components.

1. Entries become integers x = floor(64 c) + 1000000. Their number and sums are exact: partial sums of each task in two halves
   of 32 bits, added up as decimals.
2. Each task centres its rows from the exact sums, (n x - S) / n, and folds them into one triangular factor R. The factors are
   merged in a tree, a few (``FAN``) at once, each level a table, until one is left: as large as one vector's square.
3. The singular values and right vectors of that R are those of all centred rows: eigenvalues e = s^2 / n, components, and
   whitened values (x - S / n) v / sqrt(e). Rows are not gathered; the driver holds one R.
4. The whitened rows' own second moments, summed over all rows, give ``identity_error``.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries (or entries beyond 2^40, whose integers would
not fit) are dropped; of vectors of several lengths those of the most frequent length count (ties: the longest), others are
dropped; a component without variance (fewer rows than entries, constant entries) has explained 0 and whitened null, and does not
count in identity_error; deviation is null where it exceeds a long; null and repeated vec_ids and repeated rows stay rows of
their own; equal eigenvalues have any orthonormal vectors of their space; an empty table gives an empty result; columns
beside vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Factors merged at once, fewer where they are large (see ``_fan``).
FAN = 16
#: Entries beyond it are as good as infinite: 64 times it plus the shift, and sums of 2^31 such in a task, fit a long.
LARGEST = float(1 << 40)
LONG = (1 << 63) - 1


def integers(column: pa.Array, dims: int) -> np.ndarray:
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _sums(batches):
    """Of each length of vectors in a task: rows, and for each place the halves of the sum of its integers."""
    found: dict[int, list] = {}
    for batch in batches:
        column = batch.column("v")
        sizes = np.diff(column.offsets.to_numpy())
        for dims in np.unique(sizes).tolist():
            x = integers(column.filter(pa.array(sizes == dims)), dims)
            own = found.setdefault(dims, [0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)])
            own[0] += len(x)
            own[1] += (x >> 32).sum(0)
            own[2] += (x & 0xFFFFFFFF).sum(0)
    for dims, (n, high, low) in found.items():
        columns = [np.full(dims, dims), np.arange(dims), np.full(dims, n), high, low]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dims", "place", "n", "high", "low"])


class Centre:
    """n, sums S, and centred rows: n x - S in integers, exact."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def rows(self, x: np.ndarray) -> np.ndarray:
        if len(x) and self.n * int(np.abs(x).max()) + max(abs(s) for s in self.sums) <= LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, d: np.ndarray) -> list[int | None]:
        """Sums of squares of rows of n x - S."""
        if d.dtype != object and len(d) and int(np.abs(d).max()) ** 2 * d.shape[1] <= LONG:
            return (d * d).sum(1).tolist()
        return [v if v <= LONG else None for v in (sum(int(e) ** 2 for e in row) for row in d)]


def _factor(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r")


def _factors(centre: Centre, dims: int):
    """One triangular factor of a task's rows."""

    def run(batches):
        r = np.zeros((0, dims))
        for batch in batches:
            for k in range(0, len(batch), 4096):
                rows = centre.rows(integers(batch.column("v").slice(k, 4096), dims)).astype(np.float64) / centre.n
                r = _factor(np.concatenate([r, rows]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    return run


def _merged(dims: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = table.sort_by("part").column("r").to_pylist()
        r = _factor(np.concatenate([np.frombuffer(p).reshape(-1, dims) for p in parts]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def _fan(dims: int) -> int:
    """So many factors that they take some 64 MB."""
    return int(max(2, min(FAN, (64 << 20) // (8 * dims * dims))))


def triangle(vectors: DataFrame, centre: Centre, dims: int) -> np.ndarray:
    """R of all centred rows of vectors (v)."""
    level = cut(vectors.select("v").mapInArrow(_factors(centre, dims), "part long, r binary"), "factors")
    fan = _fan(dims)
    while level.count() > 1:
        level = cut(level.groupBy(F.floor(F.col("part") / fan).alias("_to")).applyInArrow(_merged(dims), "part long, r binary"), "factors")
    return np.frombuffer(level.first()["r"]).reshape(-1, dims)


class Whitening:
    """n, S, unit components (dims, k), scales sqrt(e) and shares of the trace."""

    def __init__(self, centre: Centre, r: np.ndarray, components: int):
        _, s, v = np.linalg.svd(r)
        self.centre, dims = centre, r.shape[1]
        s = np.concatenate([s, np.zeros(dims - len(s))])
        k = min(components, dims)
        self.axes, self.scale = v[:k].T, s[:k] / np.sqrt(centre.n)
        total = float((s * s).sum())
        self.explained = s[:k] ** 2 / total if total else np.zeros(k)
        self.alive = s[:k] > dims * np.finfo(float).eps * max(float(s[0]), 1e-300)
        self.explained[~self.alive] = 0.0

    def rows(self, d: np.ndarray) -> np.ndarray:
        """Whitened rows of n x - S; nan where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (d.astype(np.float64) / self.centre.n) @ self.axes / self.scale
        out[:, ~self.alive] = np.nan
        return out


def _moments(model: Whitening, dims: int):
    """Upper triangle of the sum of products of whitened rows (they are centred), and their sums (b = -1), of a task."""

    def run(batches):
        k = len(model.scale)
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = np.nan_to_num(model.rows(model.centre.rows(integers(batch.column("v"), dims))))
            total += w.T @ w
            sums += w.sum(0)
        a, b = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, np.arange(k)], pa.int32()), pa.array(np.r_[b, np.full(k, -1)], pa.int32()), pa.array(np.r_[total[a, b], sums])], ["a", "b", "s"])

    return run


def _whitened(model: Whitening, dims: int, error: float):
    def run(batches):
        k = len(model.scale)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                d = model.centre.rows(integers(part.column("v"), dims))
                w, m = model.rows(d).reshape(-1), len(part)
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.centre.n)),
                    pa.array(model.centre.deviations(d), pa.int64()).take(each),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row of embeddings (vec_id, embedding)."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("size(v) > 0").where(F.forall("v", lambda e: F.coalesce(F.abs(e) <= LARGEST, F.lit(False))))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sums = cut(rows.select("v").mapInArrow(_sums, "dims long, place long, n long, high long, low long"), "sums")
    most = sums.where("place = 0").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    dims = most["dims"]
    own = sums.where(F.col("dims") == dims).groupBy("place").agg(F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low")).orderBy("place").collect()
    centre = Centre(most["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in own])
    rows = rows.where(F.size("v") == dims)
    model = Whitening(centre, triangle(rows, centre, dims), components)
    k = len(model.scale)
    product, mean = np.zeros((k, k)), np.zeros(k)
    for r in rows.select("v").mapInArrow(_moments(model, dims), "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect():
        if r["b"] < 0:
            mean[r["a"]] = r["s"] / centre.n
        else:
            product[r["a"], r["b"]] = product[r["b"], r["a"]] = r["s"] / centre.n
    off = np.abs(product - np.outer(mean, mean) - np.eye(k))[np.ix_(model.alive, model.alive)]
    return rows.mapInArrow(_whitened(model, dims, float(off.max()) if off.size else 0.0), schema)
