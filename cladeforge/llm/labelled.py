"""Bounded samples of labelled and unlabelled documents for training.

A document's fold is crc32 of its id as text, mod 4; fold HELD_OUT is never trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def training_ids(table: DataFrame, count: int, *columns: str) -> DataFrame:
    """doc_id and columns of at most ``count`` rows outside the held-out fold: those of the smallest
    hash of the id. Only these narrow columns are moved, and at most ``count`` rows result."""
    some = table.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).where(F.col("doc_id").isNotNull() & ~held_out())
    return some.orderBy(F.xxhash64("doc_id"), "doc_id", *columns).limit(count)
