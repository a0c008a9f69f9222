"""Classification of reads against an index, from options to calls."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.functions.taxonomy import RANKS

from cladeforge.operators import index as ix
from cladeforge.operators import logistic, rank, scoring
from cladeforge.sources.shared import materialise

WIDEN, WIDEST = 8, 64
HEAVY = 4


@dataclass(frozen=True)
class Config:
    seed: int = 1
    cutoff: float = 0.8
    strand: str = "plus"  # or "both"
    exact: bool = False
    candidates: int = 2048
    risk: float = 0.0
    weights: str = "off"  # or "df", "genus", "family"
    weight_share: int = 25
    support: str = "raw"  # or "adjusted"
    min_informative: float = 0.5
    scorer: str = "sintax"  # or "protax"
    floor: float = 0.001
    holdout: str | None = None  # "self" or a rank of dkpcofg
    emit_informative: bool = False
    emit_features: bool = False
    hash: str = "blake3"  # or "sha256"

    def __post_init__(self):
        allowed = {"strand": ("plus", "both"), "weights": ("off", "df", "genus", "family"), "support": ("raw", "adjusted"), "scorer": ("sintax", "protax"), "holdout": (None, "self", *RANKS), "hash": ("blake3", "sha256")}
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name}: unknown value {getattr(self, name)!r}")
        if not (0 <= self.cutoff <= 1 and 0 <= self.min_informative <= 1 and 0 <= self.floor < 1 and 0 <= self.risk < math.inf and 1 <= self.weight_share <= 99 and self.candidates >= 1):
            raise ValueError("option out of range")
        if self.risk and (self.exact or self.weights != "off"):
            raise ValueError("risk holds for unweighted scores of candidates")
        if self.holdout and self.exact:
            raise ValueError("exact runs hide nothing")
        if self.emit_features and not self.holdout:
            raise ValueError("features need a holdout: a query must not see itself")
        if self.scorer == "protax" and (self.support != "raw" or self.emit_informative):
            raise ValueError("support and informative votes belong to the vote of replicates")


def weight_table(index: ix.Index, config: Config) -> DataFrame | None:
    if config.weights == "off":
        return None
    column = {"df": "df", "genus": "genera", "family": "families"}[config.weights]
    return ix.word_weights(index.word_stats.select("word", F.col(column).alias("n")), config.weight_share)


def _measures(counted: DataFrame, queries: DataFrame, target: int, references: int) -> DataFrame:
    """query, threshold, bad: whether its candidates at the target are too many or not separated."""
    chosen = rank.select(counted, target).groupBy("query").agg(F.count("*").alias("size"), F.min("count").alias("least"), F.max("count").alias("most"))
    sized = queries.select("query").join(chosen, "query", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    threshold = F.when(F.col("size") >= target, F.col("least")).otherwise(1)
    separated = F.coalesce(F.col("most") > threshold, F.lit(False))
    return sized.select("query", threshold.alias("threshold"), ((2 * F.col("size") >= references) | ~separated).alias("bad"))


def _risk(topped: DataFrame, hist: DataFrame, queries: DataFrame, measured: DataFrame) -> DataFrame:
    """query, risk: expected pruned references that reach a replicate's best score, over replicates."""
    wanted = topped.select("query", F.greatest("score", F.lit(2)).alias("score")).groupBy("query", "score").agg(F.count("*").alias("times"))
    low = hist.join(measured, "query").where(F.col("count") < F.col("threshold")).join(queries.select("query", F.size("words").alias("v")), "query").where("count > 0")
    p = F.col("count") / F.col("v")
    tail = F.lit(0.0)
    for k in range(scoring.SAMPLE_SIZE, -1, -1):
        tail = tail + F.when(F.col("score") <= k, rank.binomial_term(scoring.SAMPLE_SIZE, p, k)).otherwise(0.0)
    expected = F.col("times") * F.col("refs") * F.least(F.lit(1.0), F.when(p >= 1, 1.0).otherwise(tail))
    return wanted.join(low, "query").groupBy("query").agg(F.sum(expected).alias("risk"))


def tops(queries: DataFrame, postings: DataFrame, references: int, config: Config, weights: DataFrame | None = None, strand: int = 0, hide=None, counted: DataFrame | None = None) -> DataFrame:
    """Best scores with ties of each replicate of queries(query, seq, words), over candidates where
    these are separated from the rest, else over all references (or, with ``hide``, over the
    candidates that are left: hide(counts) drops references). ``counted`` are the counts left, if known."""
    drawn = materialise(scoring.draws(queries, config.seed, strand=strand, hash=config.hash), "draws")
    pruned = not config.exact and references > 4 * config.candidates or hide is not None
    if not pruned:
        return scoring.tops(materialise(scoring.scores(drawn, postings, weights), "scores"))
    if counted is None:
        counted = rank.counts(queries, postings)
        counted = materialise(hide(counted) if hide else counted, "counts")
    target, ceiling, left, out = config.candidates, min(WIDEST * config.candidates, references), queries, None
    while True:
        measured = materialise(_measures(counted, left, target, references), "measures")
        now = left.select("query")
        mine = counted.join(now, "query", "left_semi")
        scored = materialise(scoring.scores(drawn.join(now, "query", "left_semi"), postings, weights, rank.select(mine, target)), "scores")
        topped = materialise(scoring.tops(scored), "tops")
        judged = measured
        if config.risk:
            hist = rank.histogram(mine, left, references)
            judged = judged.join(_risk(topped, hist, left, measured), "query", "left").withColumn("risky", F.coalesce(F.col("risk") > config.risk, F.lit(False)))
        else:
            judged = judged.withColumn("risky", F.lit(False))
        last = F.col("bad") | F.lit(target >= ceiling) | (F.col("threshold") <= 1)
        fate = F.when(~F.col("bad") & ~F.col("risky"), "keep").when(last, F.lit("keep" if hide else "exact")).otherwise("widen")
        judged = materialise(judged.select("query", fate.alias("fate")), "fates")
        kept = topped.join(judged.where("fate = 'keep'"), "query", "left_semi")
        exact = drawn.join(judged.where("fate = 'exact'"), "query", "left_semi")
        for part in (kept, scoring.tops(materialise(scoring.scores(exact, postings, weights), "scores"))):
            out = part if out is None else out.unionByName(part)
        left = left.join(judged.where("fate = 'widen'"), "query", "left_semi")
        if not config.risk or left.isEmpty():
            return out
        target = min(WIDEN * target, ceiling)


def hider(config: Config, queries: DataFrame, index: ix.Index):
    """A function that takes hidden references out of counts; None without a hold-out. A clade is that
    of the query's own label, queries(query, words, tax)."""
    if config.holdout is None:
        return None
    if config.holdout == "self":
        return lambda counted: rank.holdout_self(counted, queries, index.refs.select("ref_id", "vocabulary"))
    bad = queries.where("tax.error is not null").select("query", "tax.error").head()
    if bad:
        raise ValueError(f"hold-outs need a lineage, query {bad.query}: {bad.error}")
    level = RANKS.index(config.holdout)
    named = queries.where(F.col("tax.lineage")[level] != "").select("query", F.col("tax.lineage").alias("lineage"))
    located = materialise(ix.locate(named, index.nodes), "located")
    return lambda counted: rank.holdout_rank(counted, located, index.refs, level)


def winners(queries: DataFrame, index: ix.Index, config: Config) -> DataFrame:
    """query, strand, boot, score, ref_id: the winners of the better strand of each query. The reverse
    strand is not tried where all replicates of the forward one reach the highest score there is."""
    weights, references = weight_table(index, config), index.meta.first().references
    hide = hider(config, queries, index)
    own = queries.select("query", "seq", "words")
    topped = tops(own, index.postings, references, config, weights, 0, hide)
    won = materialise(scoring.picks(topped, own, config.seed, hash=config.hash).withColumn("strand", F.lit(0)), "winners")
    if config.strand == "plus":
        return won
    most = scoring.SAMPLE_SIZE * (1 if weights is None else HEAVY)
    sure = won.groupBy("query").agg(F.max("score").alias("max"), F.count("*").alias("winners")).where((F.col("max") == most) & (F.col("winners") == scoring.BOOTSTRAPS))
    turned = materialise(ix.reverse_strand(own.join(sure, "query", "left_anti")), "reverse")
    hide = hider(config, queries.drop("words").join(turned.select("query", "words"), "query"), index)
    topped = tops(turned, index.postings, references, config, weights, 1, hide)
    won = won.unionByName(materialise(scoring.picks(topped, turned, config.seed, strand=1, hash=config.hash).withColumn("strand", F.lit(1)), "winners"))
    outcome = won.groupBy("query", "strand").agg(F.max("score").alias("max"), F.count("*").alias("winners"))
    return won.join(scoring.best_strand(outcome).select("query", "strand"), ["query", "strand"], "left_semi")


def hits(queries: DataFrame, won: DataFrame, index: ix.Index, config: Config) -> DataFrame:
    """query, ref_id, similarity, outside: the candidates of each query's strand, and the winners that are
    not among them (outside = 1)."""
    strand = won.select("query", "strand").distinct()
    own = queries.join(strand, "query")
    words = own.where("strand = 0").select("query", "words").unionByName(ix.reverse_strand(own.where("strand = 1").select("query", "words")))
    words = materialise(words, "strands")
    counted, hide = rank.counts(words, index.postings), hider(config, queries.drop("words").join(words, "query"), index)
    return logistic.with_outside(materialise(hide(counted) if hide else counted, "counts"), won, words, index.refs, config.candidates)


def design(queries: DataFrame, won: DataFrame, index: ix.Index, config: Config) -> tuple[DataFrame, DataFrame]:
    """The design rows of queries with enough winners, and the hits that they come from."""
    enough = materialise(won.withColumn("n", F.count("*").over(Window.partitionBy("query"))).where(F.col("n") >= scoring.BOOTSTRAPS // 2).drop("n"), "enough")
    found = materialise(hits(queries, enough, index, config), "hits")
    return materialise(logistic.design(found, enough, index.refs, index.node_stats, index.nodes), "design"), found


def calls(queries: DataFrame, index: ix.Index, names: DataFrame, config: Config = Config(), params: dict | None = None, won: DataFrame | None = None) -> DataFrame:
    """query, strand, rank, name, votes, informative, confidence of queries(query, seq, words); with the
    logistic scorer (params: its coefficients) also novel, the probability of no named child. ``won`` are
    the winners, if known."""
    won = won if won is not None else materialise(winners(queries, index, config), "winners")
    if config.scorer == "protax":
        if not params:
            raise ValueError("the logistic scorer needs its coefficients")
        rows, found = design(queries, won, index, config)
        steps = logistic.resolve(logistic.softmax(rows, params), logistic.unnamed(found, index.refs, index.nodes), config.floor)
        votes = won.join(index.refs.select("ref_id", "lineage"), "ref_id").select("query", F.posexplode("lineage").alias("rank", "node")).groupBy("query", "rank", "node").agg(F.count("*").alias("votes"))
        named = steps.join(votes, ["query", "rank", "node"], "left").join(index.nodes.select(F.col("node_id").alias("node"), "name"), "node")
        found = named.select("query", "rank", "name", F.coalesce("votes", F.lit(0)).alias("votes"), F.lit(0).cast("long").alias("informative"), F.col("probability").alias("confidence"), "novel")
    else:
        found = scoring.support(scoring.consensus(won.select("query", "ref_id"), names), config.support == "adjusted", config.min_informative)
    return found.join(won.select("query", "strand").distinct(), "query")


def features(queries: DataFrame, index: ix.Index, config: Config) -> DataFrame:
    """query (its label), rank, kind, node, s1, gap, vote, genera, sentinel, multiplicity, truth: the design
    along each query's own lineage, queries(query, label, seq, words, tax), in the order of the query."""
    bad = queries.where("tax.error is not null").select("query", "tax.error").head()
    if bad:
        raise ValueError(f"features need a lineage, query {bad.query}: {bad.error}")
    rows, found = design(queries, winners(queries, index, config), index, config)
    located = ix.locate(queries.select("query", F.col("tax.lineage").alias("lineage")), index.nodes)
    along = logistic.along(rows, found, located.join(queries.select("query", "label", F.col("tax.lineage").alias("names")), "query"), index.refs, index.node_stats, index.nodes)
    return along
