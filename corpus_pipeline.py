"""A cleaning pipeline over documents: toxicity, quality, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. Stages but the last keep the columns of documents; their decisions
take effect: toxic and poor documents go, of near copies (five-word shingles, Jaccard 0.8 or more) the one with the smallest id stays,
secrets are cut out of the text, and what is left is packed into sequences of token ids.

Rows with a null or empty text pass the filters that accept them, are near duplicates of each other
(no shingles), and still take their end id in a sequence. Rows with a null doc_id are documents like
others; of near copies a row with an id goes before one without, and different texts under one id
all stay. Repeated rows are copies: one stays. Texts of any length are read whole. Extra columns are
carried through to the last stage. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeforge.llm import hilbert_packing, markov_secrets, near_copies, pu_quality, toxicity_grammar
from cladeforge.llm.common import discard, fresh_path, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_grammar.keep_civil(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return markov_secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hilbert_packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Learned models and tokenizer ids are beyond SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's tables, and its predecessor's output, go once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
