"""Whitening of embeddings by their principal components, in two passes over the vectors.

The first pass adds up whole numbers exactly and gives the mean; the second adds up outer
products of centred vectors (one matrix product a batch).  Both leave one small state a task and
vector length, merged by ``treeAggregate``, so the driver sees a few matrices of the vectors'
length squared.  The symmetric eigenproblem is LAPACK's; the projection is broadcast (length
times components, 8 bytes each).  A third pass measures the covariance of what was whitened.

Entries are fixed-point numbers: x = floor(1024 * c) + 100000.

Defined results: vectors that are null or hold null or non-finite entries have no row; nor do
those with an entry beyond 2 ** 52, whose x is no 64-bit number, and empty vectors, which have no component.
Vectors of another length are a list of their own, fitted alone.  Components without variance
(eigenvalues within rounding of 0: one vector, equal vectors, constant dimensions) have a null
``whitened`` and take no part in ``identity_error`` (null if none does); ``explained`` is null
where nothing varies.  A ``deviation`` beyond 64 bits is null.  Null and repeated ids are rows
like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries up to which x is a 64-bit number.
LARGEST = float(1 << 52)
#: Whole numbers below this add and multiply by two without leaving 64 bits.
_SAFE = 1 << 61
#: Rows of one matrix product.
CHUNK = 4096

State = dict[int, tuple]


def usable(table: DataFrame, vector: str, *carried: str) -> DataFrame:
    """carried columns and ``v`` (doubles) of vectors whose entries are all numbers in range."""
    doubles = F.col(vector).cast("array<double>")
    rows = table.select(*carried, doubles.alias("v"))
    return rows.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) <= F.lit(LARGEST))))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and x-vectors of a batch's last column, by length of vector, a chunk at a time."""
    lists = batch.column(batch.num_columns - 1)
    ends = lists.offsets.to_numpy()
    entries = lists.values.to_numpy()
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        for part in np.array_split(which, -(-len(which) // CHUNK)):
            c = entries[ends[part][:, None] + np.arange(size)]
            yield part, np.floor(c * SCALE).astype(np.int64) + SHIFT


def _gap(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: 64 bits where they hold it, else Python's whole numbers."""
    if n * int(np.abs(x).max(initial=1)) < _SAFE and max(map(abs, total)) < _SAFE:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _squares(gap: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond 64 bits."""
    most = int(np.abs(gap).max(initial=0))
    if most * most * gap.shape[1] >= 1 << 63:
        gap = gap.astype(object)
    return [s if s < 1 << 63 else None for s in map(int, (gap * gap).sum(axis=1))]


def _merged(table: DataFrame, state: Callable[[Iterator[pa.RecordBatch]], State], merge: Callable[[tuple, tuple], tuple]) -> State:
    """States of all tasks, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import cloudpickle

        yield pa.RecordBatch.from_pydict({"state": pa.array([cloudpickle.dumps(state(batches))], pa.binary())})

    def both(a: State, b: State) -> State:
        return a | {size: merge(a[size], s) if size in a else s for size, s in b.items()}

    def add(done: State, row: tuple) -> State:
        from pyspark import cloudpickle

        return both(done, cloudpickle.loads(bytes(row[0])))

    return table.mapInArrow(run, "state binary").rdd.treeAggregate({}, add, both)


def sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length of vector: how many there are, and the exact sum of each dimension."""

    def state(batches: Iterator[pa.RecordBatch]) -> State:
        done: State = {}
        for batch in batches:
            for _, x in matrices(batch):
                wide = x if len(x) * int(np.abs(x).max(initial=0)) < _SAFE else x.astype(object)
                size, own = x.shape[1], [int(s) for s in wide.sum(axis=0)]
                n, total = done.get(size, (0, [0] * size))
                done[size] = n + len(x), [a + b for a, b in zip(total, own, strict=True)]
        return done

    return _merged(vectors.select("v"), state, lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]))


def covariances(vectors: DataFrame, means: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length of vector the covariance (divisor n) of vectors centred exactly before multiplying."""

    def state(batches: Iterator[pa.RecordBatch]) -> State:
        done: State = {}
        for batch in batches:
            for _, x in matrices(batch):
                n, total = means[x.shape[1]]
                y = (_gap(x, n, total) / n).astype(np.float64)
                outer = y.T @ y
                done[x.shape[1]] = (done[x.shape[1]][0] + outer,) if x.shape[1] in done else (outer,)
        return done

    return {size: s[0] / means[size][0] for size, s in _merged(vectors.select("v"), state, lambda a, b: (a[0] + b[0],)).items()}


@dataclass
class Fit:
    """Mean and projection of the vectors of one length."""

    n: int
    total: list[int]
    #: Columns: components over the root of their eigenvalue; NaN without variance.
    projection: np.ndarray
    explained: list[float | None]

    def whiten(self, gap: np.ndarray) -> np.ndarray:
        return (gap / self.n).astype(np.float64) @ self.projection


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """One fit for each length of vector."""
    means = sums(vectors)
    found = {}
    for size, v in covariances(vectors, means).items():
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        trace = float(np.trace(v))
        varies = values > trace * size * np.finfo(float).eps
        scale = np.full(len(values), np.nan)
        scale[varies] = 1 / np.sqrt(values[varies])
        explained = [max(0.0, float(e)) / trace if trace > 0 else None for e in values]
        found[size] = Fit(*means[size], axes * scale, explained)
    return found


def identity_errors(vectors: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """By length of vector the largest absolute entry of the whitened vectors' covariance minus the identity."""

    def state(batches: Iterator[pa.RecordBatch]) -> State:
        done: State = {}
        for batch in batches:
            for _, x in matrices(batch):
                f = fits[x.shape[1]]
                w = f.whiten(_gap(x, f.n, f.total))
                mean = w.mean(axis=0)
                own = len(w), mean, (w - mean).T @ (w - mean)
                done[x.shape[1]] = _joined(done[x.shape[1]], own) if x.shape[1] in done else own
        return done

    found: dict[int, float | None] = {}
    for size, (n, _, moment) in _merged(vectors.select("v"), state, _joined).items():
        error = np.abs(moment / n - np.eye(len(moment)))
        found[size] = float(error[np.isfinite(error)].max()) if np.isfinite(error).any() else None
    return found


def _joined(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred second moment of two lists as one."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whiten(table: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = usable(table, vector, F.col(vec_id).alias("vec_id"))
    fits = fit(vectors, components)
    errors = identity_errors(vectors, fits)
    held = table.sparkSession.sparkContext.broadcast({size: (f, errors[size]) for size, f in fits.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in matrices(batch):
                f, error = held.value[x.shape[1]]
                gap = _gap(x, f.n, f.total)
                w = f.whiten(gap)
                k, each = w.shape[1], len(x)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(part, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), each)),
                    pa.array(np.full(each * k, f.n, np.int64)),
                    pa.array(_squares(gap), pa.int64()).take(pa.array(np.repeat(np.arange(each), k))),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(f.explained * each, pa.float64()),
                    pa.array([error] * (each * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return vectors.mapInArrow(run, schema)
