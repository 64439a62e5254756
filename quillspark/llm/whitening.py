"""Whitening of embeddings: mean and covariance by pairwise merges, eigenvectors on the driver, a second pass as proof.

Entries are put on a lattice (floor(scale * c) + shift, as long). The fit list holds each distinct lattice vector once,
so that copies have no weight of their own, however many there are. Each partition of the list computes its count, exact
sums, local mean and centred scatter; Chan's formula merges two such states at a time in a tree; the driver gets one
state of dimension**2 numbers, whatever the number of rows. The fitted components are applied to the list again, and the
covariance of what comes out is compared with the identity.

Cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped. The dimension is the most frequent
length on the fit list (ties: the longer); vectors of another length, empty ones included, have no place in that space
and are dropped too. Repeated rows, repeated and null ids are kept as they come. Components whose eigenvalue is no more
than 1e-12 of the trace have no direction and are left out, so that a single distinct vector or an empty table gives no
rows. Equal eigenvalues come in the order that the solver gives them. Entries beyond 2**61 / scale are held there.
A deviation that no long can hold is null. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import pick
from .workspace import Workspace

LEAST = 1e-12
_FAR = 2**61


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        rows = np.asarray(rows)
        if rows.dtype.kind == "f":
            sums, origin = [], 0.0
        else:  # counted from a whole number near the mean, so that doubles keep all digits
            sums = exact_sums(rows)
            origin = np.array([s // len(rows) for s in sums], dtype=np.int64)
        near = (rows - origin).astype(np.float64)
        mean = near.mean(axis=0)
        centred = near - mean
        return cls(len(rows), sums, origin + mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n, delta = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return Moments(n, sums, self.mean + delta * (other.n / n), scatter)


NOTHING = Moments(0, [], np.zeros(0), np.zeros((0, 0)))


@dataclass
class Whitening:
    """n vectors with sums were fitted; components[k] is the unit eigenvector of eigenvalues[k], largest first."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: float
    shift: int
    identity_error: float = float("nan")

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One row per vector, one column per component."""
        origin = [s // self.n for s in self.sums]
        rest = np.array([(s - self.n * o) / self.n for s, o in zip(self.sums, origin, strict=True)])
        near = (x - np.array(origin, dtype=np.int64)).astype(np.float64) - rest
        return (near @ self.components.T) / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None] | np.ndarray:
        """Exact sum over the dimensions of (n * x - sum) ** 2."""
        origin = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = [s - self.n * int(o) for s, o in zip(self.sums, origin, strict=True)]
        near = x - origin
        most = (self.n * (int(np.abs(near).max(initial=0)) + 1)) ** 2 * max(1, self.dimension)
        if most < 2**63:
            far = self.n * near - np.array(rest, dtype=np.int64)
            return (far * far).sum(axis=1)
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near.tolist()]
        return [v if v < 2**63 else None for v in exact]


def exact_sums(rows: np.ndarray) -> list[int]:
    if int(np.abs(rows).max(initial=0)) * max(1, len(rows)) < 2**62:
        return [int(v) for v in rows.sum(axis=0)]
    return [sum(column) for column in rows.T.tolist()]


def usable(vector: Column) -> Column:
    """No null, NaN or infinite entry, and not null itself."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _lattice(vector: Column, scale: float, shift: int) -> Column:
    far = float(_FAR)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(far)), F.lit(-far))) + F.lit(shift).cast("long"))


def _rows(column: pa.ListArray, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _merge_tree(vectors: DataFrame, dimension: int, model: Whitening | None = None) -> Moments:
    """Moments of all rows of the one array column, or of what ``model`` makes of them."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = NOTHING
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0), dimension)
                state = state.merged(Moments.of(x if model is None else model.whitened(x)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    found = vectors.mapInArrow(states, "state binary").rdd.map(lambda row: pickle.loads(row["state"]))
    if not found.getNumPartitions():
        return NOTHING
    return found.treeReduce(Moments.merged, depth=4)


def fit(
    table: DataFrame, vector_col: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000
) -> Whitening | None:
    """The first ``components`` components over the distinct lattice vectors of ``table``; None if there are none.

    The list of distinct vectors is written to the shared folder once and read by both passes.
    """
    spark = table.sparkSession
    space = Workspace(spark, "whitening")
    vectors = pick(table, vector_col).select(F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    listed = space.save(vectors.select(_lattice(F.col("v"), scale, shift).alias("x")).distinct(), "fit")
    lengths = listed.groupBy(F.size("x").alias("length")).count().where("length > 0")
    common = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    model = None
    if common is not None:
        dimension = common["length"]
        listed_here = listed.where(F.size("x") == dimension)
        whole = _merge_tree(listed_here, dimension)
        values, vectors_ = np.linalg.eigh(whole.scatter / whole.n)
        order = np.argsort(-values, kind="stable")[:components]
        trace = float(np.trace(whole.scatter) / whole.n)
        order = order[values[order] > LEAST * trace]
        found = vectors_[:, order].T
        signs = np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])
        model = Whitening(whole.n, whole.sums, found * signs[:, None], values[order], trace, scale, shift)
        if len(order):
            again = _merge_tree(listed_here, dimension, model)
            model.identity_error = float(np.abs(again.scatter / again.n - np.eye(len(order))).max())
        else:
            model = None
    space.drop(listed)
    return model


def whiten(table: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component: id_col, component, n, deviation, whitened, explained, identity_error."""
    table = pick(table, id_col, vector_col)
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    k, dimension = len(model.eigenvalues), model.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = model.eigenvalues / model.trace
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _rows(batch.column(1), dimension)
            at = np.repeat(np.arange(rows), k)
            columns = [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n, dtype=np.int64)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(at)),
                pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col), vector.alias("v")).where(usable(F.col("v")) & (F.size("v") == dimension))
    return rows.select(F.col(id_col), _lattice(F.col("v"), model.scale, model.shift).alias("x")).mapInArrow(run, schema)
