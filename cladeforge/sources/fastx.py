"""FASTA and FASTQ as a Spark data source, and the text sinks.

``spark.dataSource.register(FastxSource)`` and then ``spark.read.format("fastx").load(path)`` gives
file, ordinal, label, seq, qual. Paths (several: separated by commas; a folder: its files but hidden ones) are local or of
a shared store (``scheme://``). A file (plain, gzip or zstd) is one partition, as compressed files can't
be split and ordinals count records in order; of several files each has its own ordinals, which
``numbered`` makes one count over all. Labels must be non-empty and without control characters,
qualities printable; ``references=true`` refuses FASTQ. An empty file gives no rows.
"""

from __future__ import annotations

import gzip
import io
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, ordinal long, label string, seq string, qual string"
BATCH_ROWS, BATCH_BASES = 1024, 1 << 22


def store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), os.path.abspath(path)


def open_text(path: str) -> io.TextIOBase:
    where, name = store(path)
    with where.open_input_file(name) as f:
        head = bytes(f.read(4))
    raw = where.open_input_file(name)
    if head[:2] == b"\x1f\x8b":
        raw = gzip.open(raw, "rb")
    elif head == b"\x28\xb5\x2f\xfd":
        import zstandard

        raw = zstandard.open(raw, "rb")
    return io.TextIOWrapper(io.BufferedReader(raw) if not isinstance(raw, io.IOBase) else raw, encoding="utf-8", newline="")


def listed(paths: str) -> list[str]:
    """The files that a path names, in order."""
    out = []
    for path in paths.split(","):
        where, name = store(path)
        if where.get_file_info(name).type == fs.FileType.Directory:
            inside = where.get_file_info(fs.FileSelector(name))
            prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
            out += sorted(prefix + i.path for i in inside if i.type == fs.FileType.File and i.base_name[0] not in "._")
        else:
            out.append(path)
    return out


def check_label(label: str) -> str:
    if not label or any(unicodedata.category(c) == "Cc" for c in label):
        raise ValueError("empty label or control character in a label")
    return label


def records(lines: Iterator[str], references: bool = False) -> Iterator[tuple[str, str, str | None]]:
    """(label, seq, qual) of FASTA (sequences over several lines) or FASTQ (four lines) text."""
    rows = (x.rstrip("\r\n") for x in lines)
    label, parts = None, []
    for row in rows:
        if label is None and not row:
            continue
        if row.startswith(">"):
            if label is not None:
                yield check_label(label), "".join(parts), None
            label, parts = row[1:], []
        elif label is not None:
            parts.append(row)
        elif row.startswith("@"):
            if references:
                raise ValueError("references must be FASTA")
            seq, plus, qual = (next(rows, None) for _ in range(3))
            if plus is None or not plus.startswith("+") or qual is None or len(qual) != len(seq):
                raise ValueError("truncated FASTQ record")
            if not all("!" <= c <= "~" for c in qual):
                raise ValueError("quality out of range")
            yield check_label(row[1:]), seq, qual
        else:
            raise ValueError("neither FASTA nor FASTQ")
    if label is not None:
        yield check_label(label), "".join(parts), None


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = listed(options["path"])
        self.references = str(options.get("references", "false")).lower() == "true"

    def partitions(self):
        return [InputPartition(p) for p in self.paths] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        names = ["file", "ordinal", "label", "seq", "qual"]
        with open_text(partition.value) as f:
            rows = ((partition.value, n, *r) for n, r in enumerate(records(f, self.references)))
            held, size = [], 0
            for r in rows:
                held.append(r)
                size += len(r[3])
                if len(held) >= BATCH_ROWS or size >= BATCH_BASES:
                    yield _batch(held, names)
                    held, size = [], 0
            if held:
                yield _batch(held, names)


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def numbered(rows: DataFrame, paths: str) -> DataFrame:
    """Rows of several files with one count of ordinals over all, in the order of the files."""
    files = listed(paths)
    if len(files) < 2:
        return rows
    counts = {r.file: r.n for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()}  # a row a file
    before, first = 0, []
    for f in files:
        first.append((f, before))
        before += counts.get(f, 0)
    starts = rows.sparkSession.createDataFrame(first, "file string, __first long")
    return rows.join(F.broadcast(starts), "file").withColumn("ordinal", F.col("ordinal") + F.col("__first")).drop("__first")  # a row a file


def fasta_lines(reads: DataFrame) -> DataFrame:
    """value: each record as its header and its sequence on one line, in input order."""
    return reads.orderBy("ordinal").select(F.concat(F.lit(">"), "label", F.lit("\n"), "seq").alias("value"))


def write_fasta(reads: DataFrame, path: str) -> None:
    """Text files whose concatenation in name order is the records in input order."""
    fasta_lines(reads).write.text(path)


def write_features(design: DataFrame, path: str) -> None:
    """The design matrix as tab-separated values with a header."""
    design.write.csv(path, sep="\t", header=True)
