"""What the operators share: reading tables, the shared folder, row batches and storage."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.sources.shared import discard, fresh_path, materialise, scratch, shared_dir  # noqa: F401

#: Rows that a Python step turns into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of documents (null text: empty), whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def release() -> None:
    """Gives memory that is free back to the system: workers live on, and an executor's memory is that of
    all its workers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library: nothing to do
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """What is written within goes to Python in batches of about so many bytes (a row at least), not of so many
    rows only: JVM and worker hold two each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that long texts don't pile up as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def text_slices(batches: Iterable[pa.RecordBatch], chars: int = 1 << 23, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about so many bytes of text, at least a row each."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + chars, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- files in the shared folder ------------------------------------------------------------


def open_output(uri: str):
    """A binary stream to a file of a shared store. Local paths are published by a rename,
    so a task that dies leaves no half file under the final name."""
    if uri.startswith("file:") or "://" not in uri:
        return _Renamed(local_path(uri))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path)


def read_file(uri: str) -> memoryview:
    if uri.startswith("file:") or "://" not in uri:
        with open(local_path(uri), "rb") as f:
            return memoryview(f.read())
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return memoryview(f.read())


def local_path(uri: str) -> str:
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


class _Renamed:
    def __init__(self, path: str):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.path, self.part = path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.f = open(self.part, "wb")
        self.write = self.f.write

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.f.close()
        if kind is None:
            os.replace(self.part, self.path)
        else:
            os.unlink(self.part)
