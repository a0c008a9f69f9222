"""Shared words between queries and references, candidates and hold-outs."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(vocab: DataFrame, postings: DataFrame) -> DataFrame:
    """query, ref_id, count: different words of vocab(query, words) that the reference has.

    An equi-join on the word. A frequent word makes one large key; the adaptive join splits it, and
    counts are summed before the shuffle by pair.
    """
    words = vocab.select("query", F.explode("words").alias("word"))
    return words.join(postings, "word").groupBy("query", "ref_id").agg(F.count("*").alias("count"))


def select(counted: DataFrame, target: int) -> DataFrame:
    """The ``target`` references with most shared words, ties kept."""
    rank = F.rank().over(Window.partitionBy("query").orderBy(F.desc("count")))
    return counted.withColumn("rank", rank).where(F.col("rank") <= target)


def histogram(counted: DataFrame, queries: DataFrame, references: int) -> DataFrame:
    """query, count, refs, with the references that share nothing at count 0."""
    seen = counted.groupBy("query", "count").agg(F.count("*").alias("refs"))
    met = counted.groupBy("query").agg(F.count("*").alias("met"))
    zero = queries.select("query").join(met, "query", "left").select("query", F.lit(0).cast("long").alias("count"), (F.lit(references) - F.coalesce("met", F.lit(0))).alias("refs"))
    return seen.unionByName(zero.where("refs > 0"))


def holdout_self(counted: DataFrame, vocab: DataFrame, refs: DataFrame) -> DataFrame:
    """counted without references of the same word set as the query's."""
    sizes = vocab.select("query", F.size("words").alias("own"))
    joined = counted.join(sizes, "query").join(refs.select("ref_id", "vocabulary"), "ref_id")
    return joined.where(~((F.col("count") == F.col("own")) & (F.col("count") == F.col("vocabulary")))).select("query", "ref_id", "count")


def holdout_rank(counted: DataFrame, located: DataFrame, refs: DataFrame, rank: int) -> DataFrame:
    """counted without references in the query's own clade at the rank; a query whose clade at the
    rank is unknown keeps all. located(query, nodes) has -1 for unknown."""
    own = located.select("query", F.col("nodes")[rank].alias("clade"))
    joined = counted.join(own, "query", "left").join(refs.select("ref_id", F.col("lineage")[rank].alias("node")), "ref_id")
    return joined.where(F.col("clade").isNull() | (F.col("clade") < 0) | (F.col("clade") != F.col("node"))).select("query", "ref_id", "count")


def binomial_term(n: int, p: F.Column, k: int) -> F.Column:
    """P(Binomial(n, p) = k)."""
    return F.lit(float(comb(n, k))) * F.pow(p, F.lit(k)) * F.pow(1 - p, F.lit(n - k))


def binomial_tail(n: int, p: F.Column, least: int) -> F.Column:
    """P(Binomial(n, p) >= least), summed from the top."""
    if least <= 0:
        return F.lit(1.0)
    terms = sum((binomial_term(n, p, k) for k in range(n, least - 1, -1)), F.lit(0.0))
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(F.least(terms, F.lit(1.0)))


def risk(hist: DataFrame, vocab: DataFrame, thresholds: DataFrame, score: int, sample: int = 32) -> DataFrame:
    """query, risk: how many references below the query's threshold are expected to reach ``score``
    in one replicate of ``sample`` draws."""
    sized = hist.join(vocab.select("query", F.size("words").alias("v")), "query").join(thresholds, "query").where((F.col("count") < F.col("threshold")) & (F.col("v") > 0))
    expected = F.col("refs") * binomial_tail(sample, F.col("count") / F.col("v"), score)
    return sized.groupBy("query").agg(F.sum(expected).alias("risk"))
