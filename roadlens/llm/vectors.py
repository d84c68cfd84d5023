"""Reading columns of vectors: which rows are whole, and their components as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 1 << 20             # components worked on together, whatever the length of a vector
LIMB = 32


def whole(column) -> np.ndarray:
    """Of an Arrow list column: True where the list is not null and holds finite numbers only."""
    import pyarrow.compute as pc
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    with np.errstate(invalid="ignore"):
        bad = ~np.isfinite(flat.cast("double").fill_null(np.nan).to_numpy(zero_copy_only=False))
    upto = np.concatenate([[0], np.cumsum(bad)])
    ends = np.cumsum(sizes)
    return column.is_valid().to_numpy(zero_copy_only=False) & (upto[ends] == upto[ends - sizes])


def matrix(column, width: int) -> np.ndarray:
    """The lists of an Arrow column as rows of doubles, continued with zeros to `width`."""
    import pyarrow.compute as pc
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().cast("double").to_numpy(zero_copy_only=False)
    return out


def whole_rows(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is not null and holds neither null nor non-finite components."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(whole(batch.column(batch.schema.get_field_index(vector)))))
    return df.mapInArrow(run, df.schema)


def width(df: DataFrame, vector: str) -> int:
    """The length of the longest vector; 0 without rows."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def pieces(batch, width: int) -> Iterator:
    """Slices of a batch that hold a bounded number of components."""
    rows = max(1, MOST_CELLS // max(width, 1))
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), exactly: as longs, or as Python integers where one is beyond 2**26."""
    if not values.size or np.abs(values).max() < 2.0 ** 26 / scale:
        return np.floor(values * scale).astype("int64")

    def one(value: float) -> int:
        over, under = float(value).as_integer_ratio()
        return over * scale // under
    return np.frompyfunc(one, 1, 1)(values)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, digit) in base 2**32, the last digit signed: digits of many integers add up in longs."""
    number = 0
    while not -(1 << LIMB - 1) <= value < 1 << LIMB - 1:
        yield number, value & (1 << LIMB) - 1
        value, number = value >> LIMB, number + 1
    yield number, value


def exact_sums(df: DataFrame, add: Callable[[dict, object], None], keys: int) -> dict[tuple, int]:
    """Sums of integers of any size, by tuples of `keys` integers.

    `add(totals, batch)` adds what a batch holds to the totals of its task, a dict from key to integer.
    Each task sends its totals once, as digits, and Spark adds these. The number of keys must be
    bounded; only their sums come to the driver.
    """
    import pyarrow as pa
    names = [f"k{i}" for i in range(keys)]
    schema = pa.schema([(n, pa.int32()) for n in names] + [("limb", pa.int32()), ("digit", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, int] = {}
        for batch in batches:
            add(totals, batch)
        rows = [(*key, number, digit) for key, value in totals.items() for number, digit in limbs(int(value))]
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at:at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    sent = df.mapInArrow(run, ", ".join(f"{n} int" for n in names) + ", limb int, digit long")
    out: dict[tuple, int] = {}
    for row in sent.groupBy(*names, "limb").agg(F.sum("digit").alias("digit")).collect():
        key = tuple(row[n] for n in names)
        out[key] = out.get(key, 0) + (row["digit"] << LIMB * row["limb"])
    return out
