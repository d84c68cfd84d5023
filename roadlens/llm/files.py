"""Files that tasks write and read themselves, in any store that Spark's file systems name."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def located(spark: SparkSession, folder: str) -> str:
    """`folder` as a full URI. A path without a scheme lies in the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return re.sub(r"^file:/(?!//)", "file:///", whole).rstrip("/")


def store_of(uri: str):
    """The file system of a full URI and the path in it."""
    from pyarrow import fs
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", uri):
        raise ValueError(f"{uri} names no file system; pass it through `located` first")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(folder: str, name: str) -> Iterator:
    """An open stream whose bytes appear as `folder/name` only when the block ends without an error.

    They are written under a name of their own first, so a task that is lost leaves no half file, and a
    repeated task, which writes the same bytes, replaces or keeps what is there.
    """
    from pyarrow import fs
    store, path = store_of(folder)
    store.create_dir(f"{path}/_temporary", recursive=True)
    own, last = f"{path}/_temporary/{uuid.uuid4().hex}-{name}", f"{path}/{name}"
    with store.open_output_stream(own, compression=None) as stream:
        yield stream
    try:
        store.move(own, last)
    except OSError:
        # Some stores refuse to replace: an earlier attempt has committed the same bytes.
        there, mine = store.get_file_info([last, own])
        if there.type != fs.FileType.File or there.size != mine.size:
            raise
        store.delete_file(own)
