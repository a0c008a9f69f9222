"""Tables written once in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset (tests, one machine) a folder of this session is made and set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    conf = "file://" + tempfile.mkdtemp(prefix="cladeforge-shared-")
    spark.conf.set("spark.checkpoint.dir", conf)
    return conf


_made: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made within are deleted at the end: what is computed from them must be written before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            discard(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage is cut, the rows survive
    lost executors, and later uses don't compute them again."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
