"""SimHash near-duplicates, found by pigeonring filtering.

A document's fingerprint has bit j set when more than half of its shingles' XXH64 hashes (seed 42) have it.
Two fingerprints link when they differ in at most `distance` bits.

Pigeonring: cut the 64 bits into m > distance segments on a ring. If the total difference is at most d,
some start i has a chain of segments i, i+1, ... whose first j segments differ in at most j * d / m bits
together, for every j. The first segment of that chain is equal (m > d), the first two differ in at most
floor(2 d / m) <= 1 bits. These two are the join key: one side gives its own two segments, the other
also every variant of the second with one bit turned. What the key finds is then held against the
longer prefixes of the chain, and last against the full distance. A pair is kept at its first viable
start only, so no pair comes twice.

Copies share a fingerprint and are one node, so a group of copies costs one row; links are between
distinct fingerprints. With d = 2 a fingerprint has at most 2,080 others to link to.

Defined cases: NULL and blank texts have no words and the fingerprint zero. Fewer words than a shingle
make one shingle of them all. A group's id is its smallest non-NULL document id, NULL if it has none.
Repeated rows are copies of each other. No rows give no rows. Extra columns are not read, or carried
through unchanged by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.components import components
from roadlens.llm.hot import hot_keys, join_salted
from roadlens.llm.store import written

SEED = 42
BATCH_SHINGLES = 400_000


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of the text's shingles; ASCII capitals lowered, blanks are 0x20 and 0x09 to 0x0D."""
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]


def fingerprints(hashes: list[list[int]]) -> np.ndarray:
    """One signed 64-bit fingerprint per list: a count per document, byte place and byte value, then per bit."""
    sizes = np.fromiter(map(len, hashes), "int64", len(hashes))
    flat = np.fromiter((h for part in hashes for h in part), "uint64", int(sizes.sum()))
    owner = np.repeat(np.arange(len(hashes)) * 256, sizes)
    octets = flat.astype(">u8").view("uint8").reshape(-1, 8)
    bits_of = np.unpackbits(np.arange(256, dtype="uint8")[:, None], axis=1).astype("int64")
    ones = np.concatenate([
        np.bincount(owner + octets[:, place], minlength=256 * len(hashes)).reshape(-1, 256) @ bits_of
        for place in range(8)], axis=1)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype("uint64").view("int64")


def fingerprint_udf(shingle: int):
    """Arrow batches of texts to fingerprints, a bounded number of shingles at a time."""
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made, waiting, size = [], [], 0
            for text in texts:
                waiting.append(shingle_hashes(text, shingle))
                size += len(waiting[-1])
                if size > BATCH_SHINGLES or len(waiting) == 256:
                    made.append(fingerprints(waiting))
                    waiting, size = [], 0
            if waiting:
                made.append(fingerprints(waiting))
            yield pd.Series(np.concatenate(made) if made else np.zeros(0, "int64"))
    return of


def _segments(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; widths differ by one bit at most."""
    widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
    shifts = [sum(widths[:i]) for i in range(parts)]
    return list(zip(shifts, widths))


def _cut(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def similar_pairs(distinct: DataFrame, fp: str = "fp", distance: int = 2, parts: int | None = None) -> DataFrame:
    """`a` < `b`: all pairs of distinct fingerprints that differ in at most `distance` bits, once each."""
    parts = parts or distance + 1
    if parts <= distance or parts < 2:
        raise ValueError("pigeonring needs more segments than differing bits, and two at least")
    rings = _segments(parts)
    budget = [j * distance // parts for j in range(parts + 1)]

    def keys(variants: bool) -> Column:
        out = []
        for i, (shift, width) in enumerate(rings):
            after, wide = rings[(i + 1) % parts]
            flips = [0] + ([1 << bit for bit in range(wide)] if variants and budget[2] >= 1 else [])
            chain = [F.struct(F.lit(i).alias("start"), _cut(F.col(fp), shift, width).alias("one"),
                              _cut(F.col(fp), after, wide).bitwiseXOR(F.lit(flip)).alias("two")) for flip in flips]
            out += chain
        return F.inline(F.array(*out))

    index = distinct.select(F.col(fp).alias("b"), keys(False))
    probe = distinct.select(F.col(fp).alias("a"), keys(True))
    met = probe.join(index, ["start", "one", "two"]).filter("a < b")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    steps = F.array(*[F.bit_count(_cut(apart, *ring)).cast("int") for ring in rings])
    pairs = met.select("a", "b", "start", steps.alias("steps"))

    def viable(start: int) -> Column:
        holds, total = F.lit(True), F.lit(0)
        for j in range(1, parts + 1):
            total = total + F.col("steps")[(start + j - 1) % parts]
            holds = holds & (total <= budget[j])
        return holds
    earliest = F.coalesce(*[F.when(viable(i), F.lit(i)) for i in range(parts)])
    return pairs.filter(F.col("start") == earliest).select("a", "b")


def grouped(docs: DataFrame, shingle: int = 3, distance: int = 2, parts: int | None = None) -> tuple[DataFrame, DataFrame, list]:
    """Rows of documents (doc_id, fp, text_hash), the group of each distinct fingerprint, and the hot fingerprints."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                               fingerprint_udf(shingle)(F.col("text")).alias("fp"),
                               F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")), "simhash-rows")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "simhash-distinct")
    found = components(similar_pairs(distinct.select("fp"), distance=distance, parts=parts), "a", "b")
    placed = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    groups = written(placed.join(smallest, "component").select("fp", "component", "component_id"), "simhash-groups")
    return rows, groups, hot_keys(distinct, "fp", "rows")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    rows, groups, hot = grouped(docs, shingle, distance, parts)
    return join_salted(rows, groups, "fp", hot).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2, parts: int | None = None) -> DataFrame:
    """The documents with all their columns, one of each group: smallest id (NULL last), then text hash.

    Of rows alike in id and text the first by their other columns, read as JSON, stays.
    """
    rows, groups, hot = grouped(docs, shingle, distance, parts)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    stay = written(join_salted(rows, groups, "fp", hot).groupBy("component")
                   .agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash"), "simhash-stay")
    keyed = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("hash"))
    met = keyed.join(stay, keyed["id"].eqNullSafe(stay["doc_id"]) & (keyed["hash"] == stay["text_hash"]), "left_semi")
    first = Window.partitionBy("id", "hash").orderBy(F.to_json("row"))
    return met.withColumn("n", F.row_number().over(first)).filter("n = 1").select("row.*")
