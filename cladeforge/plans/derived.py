"""Sequences and labels derived from the supplied tables, as no sequence table is among them.

Letters of a text become bases (a few become rare ones), so whole documents are references and whole
benchmark items are queries. The label expressions are plain SQL and serve both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.functions import sequences as S
from cladeforge.operators import curate, index, rank
from cladeforge.operators.curate import Policy
from cladeforge.sources.shared import materialise

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_RARE = {"j": "-", "k": "w", "q": "u", "x": "r", "z": "n"}
LETTERS = _LOWER + _LOWER.upper()
BASES = "".join(_RARE.get(c, "acgt"[i % 4]) for i, c in enumerate(_LOWER))
BASES += BASES.upper()

POLICY = Policy(cap=5, demote_length=2000, max_length=20_000, shallow_covered=3, shallow_orphan=3, shallow_unplaced=3)
CANDIDATES = 20

_N = "CAST(substr(source, 4) AS INTEGER)"
REFERENCE_LABEL = f"""CASE WHEN doc_id % 101 = 0 THEN concat('ref', doc_id, ';size=1') ELSE concat(
  'ref', doc_id, ';tax=d:', CASE WHEN doc_id % 97 = 0 THEN '_mitochondrion' ELSE lang END,
  ',k:k', {_N} % 2, ',p:p', {_N} % 4,
  ',c:', CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('c', {_N} % 8) END,
  ',o:', CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'incertae' ELSE concat('o', {_N} % 16) END,
  ',f:', CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 19 = 0 THEN '' ELSE concat('f', {_N}) END,
  ',g:', CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 19 = 0 THEN '' ELSE source END, ';size=3') END"""
QUERY_LABEL = """concat('read', item_id, ';tax=d:', CASE WHEN item_id % 5 = 0 THEN 'xx' ELSE 'en' END,
  ',k:k', item_id % 2, ',p:p', item_id % 4, ',c:c', item_id % 8, ',o:o', item_id % 16, ',f:f', item_id % 20, ',g:src', item_id % 20)"""


def _bases(text: str) -> F.Column:
    return F.translate(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]", ""), LETTERS, BASES)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, label, seq: every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("ordinal"), F.expr(REFERENCE_LABEL).alias("label"), _bases("text").alias("seq"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, label, seq: every benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.col("item_id").alias("ordinal"), F.expr(QUERY_LABEL).alias("label"), _bases("text").alias("seq"))


def reference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.records(references(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_records(spark, sf_dir).where("tax.error is null")


def query_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.records(queries(spark, sf_dir)).withColumnRenamed("ordinal", "query")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.nodes(parsed(spark, sf_dir).select("ordinal", "tax.lineage"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.references(parsed(spark, sf_dir), tree(spark, sf_dir))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select(F.explode("words").alias("word"), F.col("ordinal").alias("ref_id"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.counts(query_records(spark, sf_dir).select("query", "words"), postings(spark, sf_dir))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey, written once: plans and selections read it many times, and it is a small share of
    the sequences."""
    return materialise(curate.survey(index.records(references(spark, sf_dir), sketches=True)), "survey")


def digest(words: F.Column) -> F.Column:
    """Of the words as letters."""
    return F.md5(F.array_join(F.transform(words, lambda w: S.letters(w)), ","))


def lettered(rows: DataFrame) -> DataFrame:
    """rows(word, ...) with the word as letters."""
    return rows.withColumn("word", S.letters(F.col("word")))


