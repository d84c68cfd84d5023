"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, in integers.

Components are floored to integers and a vector is cut into equal consecutive parts. Parts and entries
are continued with zeros to a power of two and Walsh-Hadamard transformed by additions only; that scales every
squared distance by the length. Coefficients are taken in sequency order (by number of sign changes), where
neighbouring components of a smooth part put their energy first. Squared differences are added up coefficient
by coefficient; an entry leaves as soon as its sum exceeds the full distance of the entry that led after
the first coefficients. Sums only grow, so the nearest entry never leaves, and among entries at equal
distance the lowest number wins. Nothing is rounded: distances are long integers, and Python integers where
a component lies beyond 2**26.

Each round is one pass: every task adds up its parts by entry and sends those sums, at most parts x entries x
part length numbers, which Spark adds. Only sums and codebooks, whose size does not depend on the number of
rows, come to the driver.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped. Vectors shorter
than the longest, and a length that the number of parts does not divide, are continued with zeros. Fewer rows than
entries give that many entries. Rows of equal id are ordered by their vectors, null ids come last; repeated
rows count as often as they occur. An error that does not fit a long is null and left out of the label's sum;
a sum that does not fit is null.
An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.hot import hot_keys, join_salted
from roadlens.llm.store import written
from roadlens.llm.vectors import exact_sums, floors, matrix, pieces, whole_rows, width

COUNT = -1                       # the position under which a task counts the parts of an entry
SAFE = 1 << 26


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


def sequency(size: int) -> np.ndarray:
    """For a power of two: the rows of the Hadamard matrix by their number of sign changes."""
    bits = size.bit_length() - 1
    rank = np.arange(size)
    gray = rank ^ (rank >> 1)
    return sum((((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(size, "int64"))


def transformed(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of integer rows, continued with zeros to a power of two, in sequency order."""
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), size), rows.dtype)
    out[:, :rows.shape[1]] = rows
    half = 1
    while half < size:
        pairs = out.reshape(len(rows), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(rows), size)
        half *= 2
    return out[:, sequency(size)]


def nearest(points: np.ndarray, entries: np.ndarray, first: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry and the scaled squared distance, for transformed points and entries.

    After `first` coefficients the leading entry's full distance becomes the bound of its point; then
    one coefficient at a time is added for the (point, entry) pairs that are still within it.
    """
    size = points.shape[1]
    begun = ((points[:, None, :first] - entries[None, :, :first]) ** 2).sum(2)
    lead = begun.argmin(1)
    bound = ((points - entries[lead]) ** 2).sum(1)
    point, entry = np.nonzero((begun <= bound[:, None]).astype(bool))
    total = begun[point, entry]
    for at in range(first, size):
        total = total + (points[point, at] - entries[entry, at]) ** 2
        stays = (total <= bound[point]).astype(bool)
        if not stays.all():
            point, entry, total = point[stays], entry[stays], total[stays]
    # The leading entry of every point is still there, so each point has a run of pairs, entries ascending.
    begins = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
    least = np.minimum.reduceat(total, begins)
    hits = np.flatnonzero((total == least[point]).astype(bool))
    hits = hits[np.concatenate([[True], point[hits][1:] != point[hits][:-1]])]
    return entry[hits], least


def _small(rows: np.ndarray) -> np.ndarray:
    """Python integers as longs where their squares cannot overflow."""
    if rows.dtype == object and all(-SAFE < v < SAFE for v in rows.ravel()):
        return rows.astype("int64")
    return rows


class Books:
    """The codebook of every part: integer rows as long as a part."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = [_small(e) for e in entries]
        self.coefficients = [transformed(e) for e in self.entries]

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers by row and part, and the squared distances added up over the parts."""
        codes, error = np.zeros((len(rows), len(self.entries)), "int64"), np.zeros(len(rows), "int64")
        size = rows.shape[1] // len(self.entries)
        for part, known in enumerate(self.coefficients):
            own = transformed(_small(rows[:, part * size:(part + 1) * size]))
            codes[:, part], distance = nearest(own, known)
            error = error + (distance >> (own.shape[1].bit_length() - 1))
        return codes, error

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position, joined by commas."""
        text = ",".join(str(int(v)) for book in self.entries for entry in book for v in entry)
        return hashlib.sha256(text.encode()).hexdigest()


def train(vectors: DataFrame, part_size: int, settings: Settings = Settings(),
          id_column: str = "vec_id", vector: str = "embedding") -> Books | None:
    """Codebooks after the rounds, from whole vectors; None without rows."""
    total = part_size * settings.parts
    head = vectors.orderBy(F.col(id_column).asc_nulls_last(), vector).limit(settings.entries).select(vector).collect()
    if not head:
        return None
    start = np.zeros((len(head), total))
    for i, row in enumerate(head):
        start[i, :len(row[0])] = row[0]
    rows = floors(start, settings.scale)
    books = Books([rows[:, p * part_size:(p + 1) * part_size] for p in range(settings.parts)])
    for _ in range(settings.rounds):
        def add(totals: dict, batch, books: Books = books) -> None:
            for piece in pieces(batch, total):
                rows = floors(matrix(piece.column(0), total), settings.scale)
                codes, _ = books.codes(rows)
                for part in range(settings.parts):
                    by = np.argsort(codes[:, part], kind="stable")
                    begins = np.flatnonzero(np.diff(codes[by, part], prepend=-1))
                    sums = np.add.reduceat(rows[by, part * part_size:(part + 1) * part_size], begins, axis=0)
                    for entry, n, values in zip(codes[by[begins], part].tolist(), np.diff([*begins, len(by)]).tolist(), sums.tolist()):
                        for position, value in enumerate([n, *values], COUNT):
                            key = (part, entry, position)
                            totals[key] = totals.get(key, 0) + value
        sums = exact_sums(vectors.select(vector), add, 3)
        new = []
        for part, book in enumerate(books.entries):
            moved = book.astype(object)
            for entry in range(len(book)):
                if n := sums.get((part, entry, COUNT), 0):
                    moved[entry] = [sums[part, entry, i] // n for i in range(part_size)]
            new.append(moved)
        books = Books(new)
    return books


def encoded(df: DataFrame, settings: Settings = Settings(), id_column: str = "vec_id",
            vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, code (two hex digits a part), error, label_error and codebooks_sha256 of every row with a whole vector.

    The vectors are read once for the choice of rows and once a round; the codes are written once, because
    both the sums by label and the rows need them. Rows of a hot label spread over salts for the join.
    """
    import pyarrow as pa
    spark = df.sparkSession
    vectors = written(whole_rows(df.select(id_column, label, vector), vector), "vectors")
    part_size = max(1, -(-width(vectors, vector) // settings.parts))
    books = train(vectors, part_size, settings, id_column, vector)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    result = f"{id_column} {kinds[id_column]}, code string, error long, label_error long, codebooks_sha256 string"
    if books is None:
        return spark.createDataFrame([], result)
    total = part_size * settings.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{i:02x}" for i in range(256)], object)
        for batch in batches:
            for piece in pieces(batch, total):
                codes, error = books.codes(floors(matrix(piece.column(2), total), settings.scale))
                fits = [e if e < 1 << 63 else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(hexes[codes].sum(1), pa.string()), pa.array(fits, pa.int64())],
                    names=[id_column, label, "code", "error"])
    coded = written(vectors.mapInArrow(run, f"`{id_column}` {kinds[id_column]}, `{label}` {kinds[label]}, code string, error long"), "codes")
    # A text that also stands for the null label, which an equi-join would lose.
    keyed = coded.select(id_column, "code", "error", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")).alias("_label"))
    sums = written(keyed.groupBy("_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_rows")), "label-errors")
    joined = join_salted(keyed, sums.drop("_rows"), "_label", hot_keys(sums, "_label", "_rows"))
    return joined.select(id_column, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
