"""Embedding whitening: projections on the leading eigenvectors of the covariance, at unit variance.

Components are floored to integers and moved by an offset far larger than their spread, so sums of squares
of the raw numbers would lose what the covariance needs. The covariance is therefore exact: one pass
over the distinct vectors adds up their number n and sums S, a second one the products of vectors centred at the
integer next to S / n, all as integers of any size; what the centre is off is corrected in integers, and
only the final quotient is rounded. Its leading eigenpairs come from spectrum slicing (`spectrum.py`).

Every task adds up its own products, at most d (d + 1) / 2 numbers for vectors of length d, and Spark adds those. The driver
holds one d x d matrix, which does not grow with the rows; d up to about 2,000 is what this is for. The distinct
vectors are written down once and read by the three passes (sums, products, check).

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and so are those with an
entry whose integer lies beyond 2**52, where doubles no longer tell integers apart. Shorter vectors are continued with zeros to
the longest. A component must have variance: eigenvalues not above rounding (d * 2**-49 of the largest) give none,
so constant vectors, a single one, or an empty table give no rows, and fewer dimensions than components give fewer. Equal eigenvalues share
an arbitrary basis of their space. `deviation` is null where it does not fit a long. Repeated rows and null ids
are projected like any other. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.spectrum import leading
from roadlens.llm.store import written
from roadlens.llm.vectors import exact_sums, floors, matrix, pieces, whole_rows, width

ROWS = -1                        # the position under which a task counts its vectors
MOST = 2.0 ** 52


@dataclass(frozen=True)
class Settings:
    components: int = 16
    scale: int = 64
    offset: int = 1_000_000


@dataclass(frozen=True)
class Whitening:
    """The fit: count and sums of the distinct vectors, eigenvalues, unit eigenvectors, and share of variance."""
    n: int
    sums: np.ndarray             # Python integers
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def scaled_deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as longs where these cannot overflow when squared and added, else as Python integers."""
        centre = _centre(self.sums, self.n)
        near = x - centre
        off = np.array([int(s) - self.n * int(c) for s, c in zip(self.sums, centre)], object)
        reach = (int(np.abs(near).max()) if near.size else 0) * self.n + self.n
        if reach ** 2 * max(x.shape[1], 1) < 1 << 62:
            return near * self.n - off.astype("int64")
        return near.astype(object) * self.n - off

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(float) @ self.vectors / np.sqrt(self.values)


def _centre(sums: np.ndarray, n: int) -> np.ndarray:
    return np.array([(2 * int(s) + n) // (2 * n) for s in sums], "int64")


def _integers(column, size: int, settings: Settings) -> np.ndarray:
    return floors(matrix(column, size), settings.scale).astype("int64") + settings.offset


def products(rows: np.ndarray) -> np.ndarray:
    """rows' @ rows exactly, by doubles where every sum stays below 2**53, else by Python integers."""
    reach = int(np.abs(rows).max()) if rows.size else 0
    if reach ** 2 * len(rows) < 1 << 53:
        return (rows.astype(float).T @ rows.astype(float)).astype("int64")
    return rows.astype(object).T @ rows.astype(object)


def covariance(distinct: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, S and the covariance (divisor n) of the distinct integer vectors, each entry rounded once."""
    def add_sums(totals: dict, batch) -> None:
        for piece in pieces(batch, size):
            x = _stored(piece.column(0), size)
            high, low = x >> 31, x & (1 << 31) - 1                # a batch of either adds up in longs
            for i, (h, w) in enumerate(zip(high.sum(0).tolist(), low.sum(0).tolist())):
                totals[(i,)] = totals.get((i,), 0) + (h << 31) + w
            totals[(ROWS,)] = totals.get((ROWS,), 0) + len(x)
    found = exact_sums(distinct, add_sums, 1)
    n = found.pop((ROWS,), 0)
    sums = np.array([found[(i,)] for i in range(size)] if n else [0] * size, object)
    if not n or not size:
        return n, sums, np.zeros((size, size))
    centre, upper = _centre(sums, n), np.triu_indices(size)

    def add_entries(totals: dict, batch) -> None:
        for piece in pieces(batch, size):
            gram = products(_stored(piece.column(0), size) - centre)
            for i, j, value in zip(*[a.tolist() for a in upper], gram[upper].tolist()):
                totals[i, j] = totals.get((i, j), 0) + value
    entries = exact_sums(distinct, add_entries, 2)
    off = [int(s) - n * int(c) for s, c in zip(sums, centre)]      # n times what the centre is off
    out = np.zeros((size, size))
    for (i, j), value in entries.items():
        out[i, j] = out[j, i] = (n * value - off[i] * off[j]) / (n * n)
    return n, sums, out


def _stored(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def distinct_vectors(vectors: DataFrame, vector: str, size: int, settings: Settings = Settings()) -> DataFrame:
    """Each integer vector once; copies are taken together in the tasks before they are shuffled."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, size):
                x = _integers(piece.column(0), size, settings)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(x.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([lists], names=["x"])
    return vectors.select(vector).mapInArrow(run, "x array<long>").distinct()


def fitted(distinct: DataFrame, size: int, settings: Settings = Settings()) -> Whitening | None:
    """The leading components; None where no component has variance."""
    n, sums, spread = covariance(distinct, size)
    if not n or not size:
        return None
    values, vectors = leading(spread, settings.components)
    there = values > size * 2.0 ** -49 * values[0]
    if not there.any():
        return None
    return Whitening(n, sums, values[there], vectors[:, there], values[there] / np.trace(spread))


def identity_error(distinct: DataFrame, fit: Whitening) -> float:
    """The largest absolute entry of the whitened distinct vectors' covariance minus the identity, from the vectors."""
    import pyarrow as pa
    size, count = len(fit.sums), len(fit.values)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count))
        for batch in batches:
            for piece in pieces(batch, size):
                w = fit.whiten(fit.scaled_deviations(_stored(piece.column(0), size)))
                total[:-1] += w.T @ w
                total[-1] += w.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel(), f.type) for v, f in zip((i, j, total), schema)], schema=schema)
    sums = np.zeros((count + 1, count))
    for row in distinct.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        sums[row["i"], row["j"]] = row["value"] / fit.n
    # Vectors were centred before they were projected, so the means left here are rounding only.
    return float(np.abs(sums[:-1] - np.multiply.outer(sums[-1], sums[-1]) - np.eye(count)).max())


def whitened(df: DataFrame, settings: Settings = Settings(), id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row per whole vector and component."""
    import pyarrow as pa
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    result = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    limit = F.lit((MOST - settings.offset) / settings.scale)
    inside = F.forall(vector, lambda c: F.abs(c.cast("double")) < limit)
    vectors = whole_rows(df.select(id_column, vector), vector).filter(inside)
    size = width(vectors, vector)
    distinct = written(distinct_vectors(vectors, vector, size, settings), "distinct-vectors")
    fit = fitted(distinct, size, settings)
    if fit is None:
        return spark.createDataFrame([], result)
    error, count = identity_error(distinct, fit), len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, max(size, 8 * count)):
                far = fit.scaled_deviations(_integers(piece.column(1), size, settings))
                squares = [v if v < 1 << 63 else None for v in (far * far).sum(1).tolist()]
                ids = np.repeat(np.arange(len(far)), count)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(ids)), pa.array(np.tile(np.arange(1, count + 1), len(far)), pa.int32()),
                     pa.array(np.full(len(ids), fit.n), pa.int64()), pa.array(squares, pa.int64()).take(pa.array(ids)),
                     pa.array(fit.whiten(far).ravel()), pa.array(np.tile(fit.explained, len(far))),
                     pa.array(np.full(len(ids), error))],
                    names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return vectors.mapInArrow(run, result)
