"""One query for each operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeforge.llm import byte_bpe, disclosure, hilbert_packing, markov_secrets, order_minhash, packed_ids, pu_quality, simhash, toxicity_grammar, uniform_topk
from cladeforge.llm.common import table


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(table(spark, sf_dir, "documents"))


def op2_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_secrets.report(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_packing.packed(table(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.neighbours(table(spark, sf_dir, "documents"))


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.token_id_report(table(spark, sf_dir, "documents"))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_grammar.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_uniform_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_topk.top(table(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_disclosure, op2_markov_secrets, op3_simhash, op4_hilbert_packing, op5_order_minhash, op6_packed_ids, op7_pu_quality, op8_toxicity_grammar, op9_uniform_topk, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op9_uniform_topk": uniform_topk.ORACLE_SQL}
