"""Candidates of a stream of reads against a stored index: each read stands alone, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cladeforge.operators import index, rank


def candidates(stream: DataFrame, postings: DataFrame, path: str, checkpoint: str, target: int = 2048) -> StreamingQuery:
    """Appends the candidates of every micro-batch of stream(ordinal, label, seq) to Parquet."""

    def batch(reads: DataFrame, number: int) -> None:
        words = index.records(reads).select("ordinal", "words").withColumnRenamed("ordinal", "query")
        rank.select(rank.counts(words, postings), target).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
