"""Vector bin packing of token sequences by the dot-product heuristic.

An example costs tokens, segments (one a piece) and loss-bearing tokens; a sequence holds at most so many of each.
The open sequence takes, again and again, the waiting piece whose demand vector has the largest dot
product with what is still free, each dimension scaled by its limit: a piece that uses what the
sequence has most of. Where examples may be cut, a sequence that no waiting piece fits is filled with the
front of one, so it closes full. One that must close short (segments or loss exhausted, or the end
of the input) is cut back to a power of two tokens, a length that is stored without padding; what was
cut off waits for the next. So cut packing pads nothing.

Each task packs its own input and holds a bounded pool, nothing is shuffled, and sequence ids are the
partition's number and a counter, so they are unique without a central count. A task that is run again
gives the same rows.

Defined cases: a NULL text is empty and still has its end id. Any number of ids is cut into pieces of
at most one sequence. Repeated rows are examples of their own, and a NULL id stays NULL. No rows give
no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.tokens import encoder

SEQUENCE_BITS = 32


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    pool: int = 256          # pieces that wait to be placed
    cut: bool = True         # documents may be cut; instruction examples often may not


class Packer:
    """Places pieces (example, start, length, loss) and gives out closed sequences as lists of pieces.

    Each token of a piece bears loss or not; with cutting, the first `loss` tokens do and the rest, such
    as an end id, do not.
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss_tokens], "float64")
        self.keys: list = [None] * (limits.pool + limits.segments + 2)
        self.demand = np.zeros((len(self.keys), 3))
        self.starts = np.zeros(len(self.keys), "int64")
        self.waiting = 0

    def add(self, key, start: int, length: int, loss: int) -> Iterator[list]:
        """Take one example; full sequences come out when the pool has enough to choose from."""
        most = self.limits.tokens
        if not self.limits.cut and (length > most or loss > self.limits.loss_tokens):
            raise ValueError("an example is larger than a sequence and may not be cut")
        while length > most:
            bearing = min(loss, most)
            if bearing > self.limits.loss_tokens:
                break
            yield [(key, start, most)]
            start, length, loss = start + most, length - most, loss - bearing
        while length > most:                      # the loss limit is the tighter one
            self._wait(key, start, most, min(loss, most))
            start, length, loss = start + most, length - most, loss - min(loss, most)
            yield from self._drain()
        self._wait(key, start, length, loss)
        yield from self._drain()

    def _wait(self, key, start: int, length: int, loss: int) -> None:
        n = self.waiting
        if n == len(self.keys):
            self.keys += [None] * n
            self.demand = np.concatenate([self.demand, np.zeros((n, 3))])
            self.starts = np.concatenate([self.starts, np.zeros(n, "int64")])
        self.keys[n], self.starts[n], self.demand[n] = key, start, (length, 1, loss)
        self.waiting += 1

    def _take(self, i: int):
        found = self.keys[i], int(self.starts[i]), int(self.demand[i, 0]), int(self.demand[i, 2])
        last = self.waiting - 1
        self.keys[i], self.starts[i], self.demand[i] = self.keys[last], self.starts[last], self.demand[last]
        self.keys[last] = None
        self.waiting = last
        return found

    def _drain(self) -> Iterator[list]:
        while self.waiting > self.limits.pool:
            yield self._sequence()

    def finish(self) -> Iterator[list]:
        while self.waiting:
            yield self._sequence()

    def _sequence(self) -> list:
        free = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], "float64")
        placed, used = [], 0
        while self.waiting and free[0] >= 1 and free[1] >= 1:
            pool = self.demand[:self.waiting]
            fits = (pool <= free).all(axis=1)
            score = (pool * self.scale) @ (free * self.scale)
            if fits.any():
                key, start, length, loss = self._take(int(np.argmax(np.where(fits, score, -1.0))))
            elif self.limits.cut:
                room = int(min(free[0], free[2])) if free[2] >= 1 else 0
                if not room:
                    break
                key, start, length, loss = self._take(int(np.argmax(score)))
                part = min(length, room)
                if part < length:
                    self._wait(key, start + part, length - part, loss - min(loss, part))
                length, loss = part, min(loss, part)
            else:
                break
            placed.append((key, start, length, loss))
            free -= (length, 1, loss)
            used += length
        return [p[:3] for p in (self._trimmed(placed, used) if self.limits.cut and used < self.limits.tokens else placed)]

    def _trimmed(self, placed: list, used: int) -> list:
        """Cut back to the largest power of two; the rest waits again."""
        over = used - (1 << (used.bit_length() - 1))
        while over:
            key, start, length, loss = placed.pop()
            keep = max(0, length - over)
            over -= length - keep
            self._wait(key, start + keep, length - keep, loss - min(loss, keep))
            if keep:
                placed.append((key, start, keep, min(loss, keep)))
        return placed


def packed(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0, with_ids: bool = False,
           texts_at_once: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every id of a document bears loss, its end id does not.
    """
    import pyarrow as pa
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encode, packer, rows = encoder(tokenizer).encode, Packer(limits), []
        number = TaskContext.get().partitionId() << SEQUENCE_BITS

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def emit(sequences: Iterator[list]) -> None:
            nonlocal number
            for pieces in sequences:
                offset = 0
                for (doc_id, ids), start, length in pieces:
                    piece = ids[start:start + length]
                    row = (doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), number, offset)
                    rows.append(row + (piece.astype("int32"),) if with_ids else row)
                    offset += length
                number += 1
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                texts = [t or "" for t in part.column(1).to_pylist()]
                flat, sizes = encode(texts)
                flat, ends = flat.astype("<u4"), np.cumsum(sizes)
                for doc_id, end, size in zip(part.column(0).to_pylist(), ends, sizes):
                    ids = np.append(flat[end - size:end], np.uint32(end_id)).astype("<u4")
                    emit(packer.add((doc_id, ids), 0, len(ids), len(ids) - 1))
                if len(rows) >= 2000:
                    yield out()
                    rows.clear()
        emit(packer.finish())
        if rows:
            yield out()
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, ddl + (", ids array<int>" if with_ids else ""))
