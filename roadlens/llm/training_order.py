"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride shards.

Documents are encoded and each task cuts its stream of ids (every document ended by an end id) into
sequences of `length` ids, the last one padded. The sequences are written down once, so their number N is
exact. A balanced Feistel network over the next even power of two, walked until it lands below N, is a keyed
permutation of 0 .. N-1: it gives every sequence its slot without a sort, and its inverse finds the
sequence of a slot. Slots are cut into ranges of `per_shard`; the ranges are the shuffle's partitions, one
task a range (several neighbouring ones beyond `MOST_TASKS`), and a range is written as one file of records of `length` ids of 2 bytes, or of
4 where the vocabulary has more than 65,536 entries. Slot s lies in file s // per_shard at record s % per_shard, so training reads
files in order and resumes at any slot without an index.

A shard is written under a name of its own and then renamed: a repeated task writes the same bytes.
The index of all slots is written next, and a manifest of one row (N, key, length, width, slots a shard, end id) last:
a folder without a manifest is not complete. `read_slots` takes all it needs from the manifest.

Blocks of sequences travel compressed. Only one count per task reaches the driver. Which sequence gets which number follows the
order of the input's rows and its split into tasks; a rerun over the same files with the same settings repeats it.

Defined cases: a NULL text is empty and gives its end id. A sequence may span documents of one task. Repeated rows
are encoded each. No rows give no shard, no row, and a manifest with N = 0. An id that does not fit the width ends the job. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.files import committed, located, store_of
from roadlens.llm.store import shared_folder, written
from roadlens.llm.tokens import encoder, vocabulary_size

MOST_TASKS = 10_000
ROUNDS = 6
BLOCK = 512                       # sequences compressed together
LEVEL = 3


@dataclass(frozen=True)
class Order:
    key: int = 20250901
    length: int = 1024
    per_shard: int = 16384
    end_id: int = 0
    kind: str | None = None        # of an id: "<u2" or "<u4"; by the vocabulary if None

    def for_tokenizer(self, tokenizer: str) -> "Order":
        """The order with the width that the tokenizer's vocabulary needs, or ValueError if a given one is too narrow."""
        size = vocabulary_size(tokenizer)
        kind = self.kind or ("<u2" if size <= 1 << 16 else "<u4")
        if max(size, self.end_id + 1) > 1 << 8 * np.dtype(kind).itemsize:
            raise ValueError(f"ids of {tokenizer} ({size} entries) do not fit {kind}")
        return replace(self, kind=kind)

    @property
    def record(self) -> int:
        """Bytes of one sequence."""
        return self.length * np.dtype(self.kind).itemsize


def _mix(half: np.ndarray, key: int, turn: int) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slots of indices in 0 .. n-1, or with `inverse` the indices of slots."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    turns = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for turn in turns:
            if inverse:
                left, right = right ^ (_mix(left, key, turn) & low), left
            else:
                left, right = right, left ^ (_mix(right, key, turn) & low)
        return left << np.uint64(half) | right
    with np.errstate(over="ignore"):
        out = once(np.asarray(index).astype("uint64"))
        while (outside := out >= n).any():
            out[outside] = once(out[outside])
    return out.astype("int64")


def sequences(docs: DataFrame, tokenizer: str, order: Order = Order(), texts_at_once: int = 256) -> DataFrame:
    """part, first, n, tokens, block: compressed blocks of `n` sequences, numbered from `first` within the task.

    `tokens` counts the ids of the block without padding.
    """
    import pyarrow as pa
    order = order.for_tokenizer(tokenizer)
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("tokens", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext
        part, encode, squeeze = TaskContext.get().partitionId(), encoder(tokenizer).encode, zstandard.ZstdCompressor(LEVEL).compress
        stream, first, size = [], 0, BLOCK * order.length

        def block(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal first
            n = -(-len(ids) // order.length)
            full = np.full(n * order.length, order.end_id, order.kind)
            full[:len(ids)] = ids
            row = [[part], [first], [n], [len(ids)], [squeeze(full.tobytes())]]
            first += n
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                flat, sizes = encode([t or "" for t in batch.column(0).slice(at, texts_at_once).to_pylist()])
                stream.append(np.insert(flat, np.cumsum(sizes), order.end_id).astype(order.kind))
                if sum(map(len, stream)) >= size:
                    ids = np.concatenate(stream)
                    whole = len(ids) // size * size
                    for k in range(0, whole, size):
                        yield block(ids[k:k + size])
                    stream = [ids[whole:]]
        ids = np.concatenate(stream) if stream else np.zeros(0, order.kind)
        if len(ids):
            yield block(ids)
    return docs.select("text").mapInArrow(run, "part int, first long, n long, tokens long, block binary")


MANIFEST = "n long, key long, length int, per_shard int, end_id long, kind string, tokenizer string"


def materialise(docs: DataFrame, tokenizer: str, folder: str | None = None, order: Order = Order()) -> DataFrame:
    """Write shards, index and manifest; the index: slot, shard, byte_offset, n_tokens, ids_crc32, sequence, folder."""
    import pyarrow as pa
    spark = docs.sparkSession
    order = order.for_tokenizer(tokenizer)
    folder = located(spark, folder or f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}")
    blocks = written(sequences(docs, tokenizer, order), "sequences")
    counts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    begins = dict(zip([p for p, _ in counts], np.cumsum([0] + [n for _, n in counts]).tolist()))
    total = sum(n for _, n in counts)
    record, shards = order.record, -(-total // order.per_shard)
    schema = pa.schema([("shard", pa.int64()), ("slots", pa.binary()), ("index", pa.binary()), ("tokens", pa.binary()), ("block", pa.binary())])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut the blocks by shard, several blocks together."""
        import zstandard
        squeeze, open_ = zstandard.ZstdCompressor(LEVEL).compress, zstandard.ZstdDecompressor().decompress
        held, size = [], 0

        def out() -> pa.RecordBatch:
            index, tokens = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            records = np.concatenate([h[2] for h in held])
            slots = permute(index, total, order.key)
            shard_of = slots // order.per_shard
            by = np.argsort(shard_of, kind="stable")
            bounds = np.flatnonzero(np.diff(shard_of[by], prepend=-1))
            groups = np.split(by, bounds[1:])
            rows = [(int(shard_of[g[0]]), slots[g].tobytes(), index[g].tobytes(), tokens[g].tobytes(), squeeze(records[g].tobytes())) for g in groups]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                records = np.frombuffer(open_(row["block"]), "uint8").reshape(n, record)
                tokens = np.clip(row["tokens"] - np.arange(n) * order.length, 0, order.length)
                held.append((begins[row["part"]] + row["first"] + np.arange(n), tokens.astype("int64"), records))
                size += n
                if size >= 16 * BLOCK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    index_schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("n_tokens", pa.int64()),
                              ("ids_crc32", pa.int64()), ("sequence", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards of one task, one after another; its rows come sorted by shard."""
        import zstandard
        open_, now, image, found = zstandard.ZstdDecompressor().decompress, None, None, []

        def done() -> pa.RecordBatch:
            slots, index, tokens = (np.concatenate([f[i] for f in found]) for i in range(3))
            base = now * order.per_shard
            if len(slots) != len(image):
                raise ValueError(f"shard {now} has {len(slots)} of {len(image)} sequences")
            with committed(folder, f"shard-{now:08d}.bin") as stream:
                stream.write(memoryview(image).cast("B"))
            crc = [zlib.crc32(image[s - base].tobytes()) for s in slots]
            columns = [slots, np.full(len(slots), now), (slots - base) * record, tokens, crc, index]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, index_schema)], schema=index_schema)
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if now is not None:
                        yield done()
                    now, found = row["shard"], []
                    image = np.zeros((min(order.per_shard, total - now * order.per_shard), record), "uint8")
                slots, index, tokens = (np.frombuffer(row[c], "int64") for c in ("slots", "index", "tokens"))
                image[slots - now * order.per_shard] = np.frombuffer(open_(row["block"]), "uint8").reshape(-1, record)
                found.append((slots, index, tokens))
        if now is not None:
            yield done()
    moved = blocks.mapInArrow(scatter, "shard long, slots binary, index binary, tokens binary, block binary")
    tasks = max(1, min(shards, MOST_TASKS))
    ranged = moved.repartitionById(tasks, F.floor(F.col("shard") * tasks / F.lit(max(shards, 1))).cast("int")).sortWithinPartitions("shard")
    index = "slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long, sequence long"
    ranged.mapInArrow(write, index).write.parquet(f"{folder}/index")
    name = tokenizer.rsplit("/", 1)[-1]
    spark.createDataFrame([(total, order.key, order.length, order.per_shard, order.end_id, order.kind, name)], MANIFEST) \
        .coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.schema(index).parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


def read_slots(spark: SparkSession, folder: str, first: int, count: int) -> np.ndarray:
    """`count` sequences from slot `first` on, by range reads; fewer at the end. Raises without a manifest."""
    folder = located(spark, folder)
    known = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").first()
    order = Order(known["key"], known["length"], known["per_shard"], known["end_id"], known["kind"])
    store, path = store_of(folder)
    out, last = [], min(first + count, known["n"])
    while first < last:
        shard, at = divmod(first, order.per_shard)
        n = min(last - first, order.per_shard - at)
        with store.open_input_file(f"{path}/shard-{shard:08d}.bin") as file:
            out.append(np.frombuffer(file.read_at(n * order.record, at * order.record), order.kind).reshape(n, order.length))
        first += n
    return np.concatenate(out) if out else np.zeros((0, order.length), order.kind)


def sequence_of(spark: SparkSession, folder: str, slot: int) -> int:
    """The number of the sequence in a slot, by the inverse permutation."""
    known = spark.read.schema(MANIFEST).parquet(f"{located(spark, folder)}/manifest").first()
    return int(permute(np.array([slot]), known["n"], known["key"], inverse=True)[0])
