"""WARC archives: a deterministic sharded writer, and a reader of what its manifest lists.

Writing takes three steps.
1. A narrow table of keys (id, payload digest, payload size) is written. Per digest the smallest id is
   the response; every other record of that digest is a revisit of it. Small payloads are always responses.
2. The running total of payload bytes over the order (id, digest) cuts the keys into shards of about equal
   size: the same pages give the same shards on any cluster, however the input is split. The number of bytes in a shard
   grows with the total until there are `most_shards` of them, and then to `largest_shard`.
3. Pages go to the task of their shard, payload and all, once; what step 1 found about copies is mixed in as rows
   of a few bytes, so no payload takes part in a join. A task sorts by shard, id and digest and writes
   each shard as one or more files, starting the next file when the compressed size reaches `roll_bytes`.

Headers are made anew from the page: status line, content type and length, digests of block and payload, and a
record id derived from page id, digest and occurrence. Dates are a parameter. So the bytes of every file
depend on the pages alone. A file is written under a temporary name and renamed when it is whole; the manifest, a table with
a row per file (name, shard, records, bytes, SHA-256), is written last by Spark's own commit. Readers take
only files of the manifest and check size and SHA-256 of the file and the digests of every record, so files of lost
or doubled attempts are never seen.

Defined cases: a null html is empty. A null url gives no target header. A page without an id is always a response, and no record
refers to it. Of pages with the same id and payload the first by url is the response, if that id is the smallest; the
others revisit it. Rows alike in id, url and html are a record each; they stay in one shard, and
their payload is written once. No pages give a manifest without files and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.files import committed, located, store_of
from roadlens.llm.hot import hot_keys, join_salted
from roadlens.llm.store import shared_folder, written
from roadlens.operators.ordered import running_totals

NO_ID = -(1 << 63)               # the place of pages without an id: before all others
OVERHEAD = 512                   # bytes of headers that a record counts besides its payload
READ = 1 << 20
END = b"\r\n"


@dataclass(frozen=True)
class Settings:
    least_copied: int = 100
    smallest_shard: int = 4 << 20
    largest_shard: int = 1 << 30
    most_shards: int = 1024
    roll_bytes: int = 256 << 20
    level: int = 6
    date: str = "2025-09-01T00:00:00Z"
    software: str = "roadlens"


# Keys, copies, shards ---------------------------------------------------------------


def keys(pages: DataFrame) -> DataFrame:
    """page_id, place (the id as a number that is never null), digest, spread (of the digest), bytes."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes")) \
        .select("page_id", F.coalesce("page_id", F.lit(NO_ID)).alias("place"), "digest", F.xxhash64("digest").alias("spread"), "bytes")


def copies(known: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """place, spread, digest and `first`, the id of the response, of the keys whose digest occurs more than once."""
    able = known.filter((F.col("bytes") >= settings.least_copied) & F.col("page_id").isNotNull())
    groups = written(able.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
                     .filter("rows > 1"), "payload-groups")
    return join_salted(able.select("place", "spread", "digest"), groups.select("digest", "first"), "digest",
                       hot_keys(groups, "digest", "rows"))


def shard_bounds(known: DataFrame, settings: Settings = Settings()) -> list[tuple[int, int]]:
    """(place, spread) at which each shard begins, ascending: at most the total over the shard size, plus one."""
    total = known.agg(F.sum(F.col("bytes") + OVERHEAD)).first()[0] or 0
    size = min(max(settings.smallest_shard, -(-total // settings.most_shards)), settings.largest_shard)
    weighed = known.select("place", "spread", (F.col("bytes") + OVERHEAD).alias("weight"))
    upto = running_totals(weighed, [F.col("place"), F.col("spread")], {"upto": "weight"})
    shard = F.floor((F.col("upto") - F.col("weight")) / F.lit(size))
    begins = upto.groupBy(shard.alias("shard")).agg(F.min(F.struct("place", "spread")).alias("begin"))
    return sorted({tuple(r["begin"]) for r in begins.collect()})


def _ordered(place: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Pairs of longs as byte strings in the same order."""
    turned = np.stack([place, spread], 1).astype("int64").view("uint64") ^ np.uint64(1 << 63)
    return turned.astype(">u8").view("S16")[:, 0]


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of the last shard that begins at or before (place, spread)."""
    begins = _ordered(np.array([b[0] for b in bounds], "int64"), np.array([b[1] for b in bounds], "int64"))

    @F.pandas_udf("long")
    def found(place: pd.Series, spread: pd.Series) -> pd.Series:
        at = np.searchsorted(begins, _ordered(place.to_numpy(), spread.to_numpy()), "right") - 1
        return pd.Series(np.maximum(at, 0))
    return found("place", "spread")


# Records ---------------------------------------------------------------


def _id(page_id: int | None, digest: str, occurrence: int) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id} {digest} {occurrence}'.encode()).hexdigest()[:32])}>"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in fields if value is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END * 2 + block + END * 2


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def page_record(row: dict, first: int | None, occurrence: int, settings: Settings) -> bytes:
    """The response or revisit record of a page; `first` is the id of its group's response, if it has a group."""
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    url = None if row["url"] is None else quote(row["url"], safe="%:/?#[]@!$&'()*+,;=~-._")
    revisit = first is not None and (first != row["page_id"] or occurrence > 0)
    head = _http(len(payload))
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(row["page_id"], row["digest"], occurrence)),
              ("WARC-Date", settings.date), ("WARC-Target-URI", url), ("X-Page-Id", row["page_id"]),
              ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _id(first, row["digest"], 0)), ("X-Refers-To-Page-Id", first)]
    block = head if revisit else head + payload
    return _record([*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")], block)


class _File:
    """One archive file while it is written: its stream, and what the manifest says of it."""

    def __init__(self, folder: str, shard: int, number: int, settings: Settings):
        self.name, self.shard, self.settings = f"shard-{shard:08d}-{number:04d}.warc.gz", shard, settings
        self.number, self.records, self.bytes, self.hash = number, 0, 0, hashlib.sha256()
        self.opened = committed(folder, self.name)
        self.stream = self.opened.__enter__()
        about = f"software: {settings.software}\r\nformat: WARC File Format 1.1\r\n".encode()
        self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id(None, self.name, 0)), ("WARC-Date", settings.date),
                           ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about))

    def _put(self, record: bytes) -> None:
        packed = zlib.compress(record, self.settings.level, wbits=31)       # a gzip member a record, without a time
        self.stream.write(packed)
        self.hash.update(packed)
        self.bytes += len(packed)

    def add(self, record: bytes) -> None:
        self._put(record)
        self.records += 1

    def close(self) -> tuple:
        self.opened.__exit__(None, None, None)
        return self.name, self.shard, self.records, self.bytes, self.hash.hexdigest()

    def drop(self, error: BaseException) -> None:
        """Leave the temporary file behind, unnamed by any manifest."""
        try:
            self.opened.__exit__(type(error), error, error.__traceback__)
        except BaseException as same:  # noqa: BLE001  the caller raises it
            if same is not error:
                raise


def write(pages: DataFrame, folder: str | None = None, settings: Settings = Settings()) -> str:
    """Write the archives and their manifest below `folder`; its full URI."""
    import pyarrow as pa
    spark = pages.sparkSession
    folder = located(spark, folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    known = written(keys(pages), "payload-keys")
    bounds = shard_bounds(known, settings) or [(NO_ID, NO_ID)]
    tags = copies(known, settings).select("place", "spread", "digest", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"),
                                          F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first")
    shown = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                         F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    full = shown.select(F.coalesce("page_id", F.lit(NO_ID)).alias("place"), F.xxhash64("digest").alias("spread"), "digest", F.lit(1).alias("kind"),
                        "page_id", "url", "html", F.lit(None).cast("long").alias("first"))
    tasks = min(len(bounds), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = full.unionByName(tags).withColumn("shard", shard_of(bounds))
    sorted_ = dealt.repartitionById(tasks, (F.col("shard") * tasks / F.lit(len(bounds))).cast("int")) \
        .sortWithinPartitions("shard", "place", "spread", "digest", "kind", "url") \
        .select("shard", "digest", "kind", "page_id", "url", "html", "first")
    schema = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done, tag, last, occurrence = None, [], None, None, 0
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for row in batch.slice(at, 64).to_pylist():
                        if row["kind"] == 0:
                            tag = row["digest"], row["first"]
                            continue
                        if file is None or file.shard != row["shard"] or file.bytes >= settings.roll_bytes:
                            number = 0
                            if file is not None:
                                number = file.number + 1 if file.shard == row["shard"] else 0
                                done.append(file.close())
                                file = None
                            file = _File(folder, row["shard"], number, settings)
                        key = row["page_id"], row["digest"]
                        occurrence, last = (occurrence + 1 if key == last else 0), key
                        own = tag is not None and tag[0] == row["digest"] and row["page_id"] is not None
                        file.add(page_record(row, tag[1] if own else None, occurrence, settings))
            if file is not None:
                done.append(file.close())
        except BaseException as error:
            if file is not None:
                file.drop(error)
            raise
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    sorted_.mapInArrow(run, "file string, shard long, records long, bytes long, sha256 string").write.parquet(f"{folder}/manifest")
    return folder


# Reading ---------------------------------------------------------------


def _members(stream, expected: str) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, whose bytes must have the SHA-256 `expected`."""
    whole, rest = hashlib.sha256(), b""
    unpack, parts = zlib.decompressobj(wbits=31), []
    while data := rest or stream.read(READ):
        if not rest:
            whole.update(data)
        parts.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(wbits=31), []
    if any(parts) or whole.hexdigest() != expected:
        raise ValueError("the file is not the one that the manifest lists")


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(END * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != END * 2:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} does not end where its length says")
    return fields, rest[:size]


def _checked(fields: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP fields and payload of a record whose digests and lengths agree."""
    head, _, payload = block.partition(END * 2)
    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    good = fields["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
    if fields["WARC-Type"] == "response":
        good &= fields["WARC-Payload-Digest"] == f"sha256:{hashlib.sha256(payload).hexdigest()}"
        good &= int(http["Content-Length"]) == len(payload)
    if not good:
        raise ValueError(f"record {fields['WARC-Record-ID']} differs from its digests")
    return http, payload


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, file of every record; payload if asked for.

    A revisit has the size and digest of the payload it stands for, and no payload of its own. A file that is
    not as the manifest says, or a record that differs from its digests, ends the job.
    """
    import pyarrow as pa
    folder = located(spark, folder)
    manifest = spark.read.schema("file string, shard long, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")
    files = manifest.count()
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
              ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string())] + [("payload", pa.string())] * with_payload
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        store, path = store_of(folder)
        number = lambda text: None if text is None else int(text)
        for batch in batches:
            for listed in batch.to_pylist():
                rows, held, count = [], 0, 0
                with store.open_input_stream(f"{path}/{listed['file']}", compression=None) as stream:
                    for member in _members(stream, listed["sha256"]):
                        record, block = _parsed(member)
                        if record["WARC-Type"] == "warcinfo":
                            continue
                        http, payload = _checked(record, block)
                        kind, count = record["WARC-Type"], count + 1
                        row = (number(record.get("X-Page-Id")), int(http["Content-Length"]), record["WARC-Payload-Digest"].removeprefix("sha256:"),
                               kind, number(record.get("X-Refers-To-Page-Id")), record.get("WARC-Target-URI"), listed["file"])
                        rows.append(row + ((payload.decode("utf-8", "surrogatepass") if kind == "response" else None,) if with_payload else ()))
                        held += len(payload) if with_payload else 0
                        if len(rows) >= 1024 or held >= READ:
                            yield batch_of(rows)
                            rows, held = [], 0
                if count != listed["records"]:
                    raise ValueError(f"{listed['file']} holds {count} records instead of {listed['records']}")
                if rows:
                    yield batch_of(rows)
    tasks = max(1, min(files, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    result = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"
    return manifest.repartition(tasks).mapInArrow(run, result + ", payload string" * with_payload)
