"""The per-rank logistic scorer with an explicit novel-taxon outcome."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.functions.sequences import WORD_SPACE, K
from cladeforge.functions.taxonomy import LEVELS, RANKS
from cladeforge.operators import rank
from cladeforge.sources.shared import materialise

#: Fixed value: similarities count from here.
FLOOR_IDENTITY = 0.7
FEATURES = ("present", "s1", "gap", "vote", "genera", "sentinel", "absent")


def similarity(hits: DataFrame) -> DataFrame:
    """hits(count, vocabulary, own) with similarity: shared words corrected for chance, as identity."""
    chance = F.col("vocabulary") / F.lit(float(WORD_SPACE))
    adjusted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("count") / F.col("own") - chance) / (1 - chance)))
    value = F.greatest(F.lit(0.0), F.pow(adjusted, F.lit(1.0 / K)) - FLOOR_IDENTITY)
    return hits.withColumn("similarity", F.when((F.col("count") == 0) | (F.col("own") == 0) | (chance >= 1), 0.0).otherwise(value))


def gap(first: F.Column, second: F.Column, references: F.Column, scored: F.Column) -> F.Column:
    """How far the best reference of a taxon stands above its second."""
    behind = F.when(scored >= 2, second).otherwise(0.0)
    return F.when(references <= 1, 0.0).otherwise((1 - F.pow(references.cast("double"), F.lit(-0.2))) * F.greatest(first - behind, F.lit(0.0)))


def parse_params(text: str) -> dict[str, list[float]]:
    """Coefficients by rank: ``#`` comments, a rank and seven finite numbers a line, each rank once."""
    out: dict[str, list[float]] = {}
    for line in text.splitlines():
        parts = line.split("#", 1)[0].split()
        if not parts:
            continue
        rank, values = parts[0], [float(x) for x in parts[1:]]
        if rank not in RANKS or len(rank) != 1 or rank in out or len(values) != len(FEATURES) or not all(map(math.isfinite, values)):
            raise ValueError(f"bad line of coefficients: {line!r}")
        out[rank] = values
    if len(out) != LEVELS:
        raise ValueError("every rank needs its coefficients")
    return out


def design(hits: DataFrame, won: DataFrame, refs: DataFrame, stats: DataFrame, tree: DataFrame) -> DataFrame:
    """query, rank, parent, node, s1, gap, vote, genera, sentinel, absent: a row per named child that a
    scored reference hits(query, ref_id, similarity) lies under, for every parent at once."""
    lines = refs.select("ref_id", "lineage")
    levels = F.posexplode("lineage").alias("rank", "node")
    outside = F.col("outside") if "outside" in hits.columns else F.lit(0)
    by_ref = hits.join(lines, "ref_id").select("query", "similarity", "lineage", F.struct(outside.alias("outside"), "ref_id").alias("seat"), levels)
    parent = F.when(F.col("rank") > 0, F.try_element_at("lineage", F.col("rank"))).otherwise(0).alias("parent")
    places = by_ref.select("query", "rank", parent, "node", "similarity", "seat")
    order = F.row_number().over(Window.partitionBy("query", "rank", "node").orderBy(F.desc("similarity")))
    best = places.withColumn("place", order).groupBy("query", "rank", "parent", "node").agg(
        F.max(F.when(F.col("place") == 1, F.col("similarity"))).alias("s1"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("similarity"))), F.lit(0.0)).alias("second"), F.count("*").alias("scored"), F.min("seat").alias("seat")
    )
    votes = won.join(lines, "ref_id").select("query", F.posexplode("lineage").alias("rank", "node")).groupBy("query", "rank", "node").agg(F.count("*").alias("votes"))
    total = won.groupBy("query").agg(F.count("*").alias("all"))
    joined = best.join(votes, ["query", "rank", "node"], "left").join(total, "query", "left").join(stats.select(F.col("node_id").alias("node"), "references", "genera"), "node").join(tree.select(F.col("node_id").alias("node"), "name"), "node")
    own = Window.partitionBy("query", "rank", "parent")
    named = F.col("name") != ""
    rows = joined.withColumn("sentinel", F.coalesce(F.max(F.when(~named, F.col("s1"))).over(own), F.lit(0.0))).withColumn("matched", F.count_if(named).over(own))
    kids = stats.select(F.col("node_id").alias("parent"), "children")
    return rows.join(kids, "parent").where(named).select(
        "query", "rank", "parent", "node", "s1", gap(F.col("s1"), F.col("second"), F.col("references"), F.col("scored")).alias("gap"),
        (F.coalesce("votes", F.lit(0)) / F.greatest(F.coalesce("all", F.lit(1)), F.lit(1))).alias("vote"), F.log(F.greatest("genera", F.lit(1)).cast("double")).alias("genera"),
        "sentinel", "seat", F.greatest(F.col("children") - F.col("matched"), F.lit(0)).alias("absent"),
    )


def with_outside(counted: DataFrame, won: DataFrame, words: DataFrame, refs: DataFrame, target: int) -> DataFrame:
    """query, ref_id, similarity, outside: the ``target`` candidates of counted(query, ref_id, count), ties
    kept, and the winners that are not among them, with outside = 1."""
    chosen = materialise(rank.select(counted, target).select("query", "ref_id", "count"), "chosen")
    more = won.select("query", "ref_id").distinct().join(chosen, ["query", "ref_id"], "left_anti").join(counted, ["query", "ref_id"], "left").select("query", "ref_id", F.coalesce("count", F.lit(0)).alias("count"))
    every = chosen.withColumn("outside", F.lit(0)).unionByName(more.withColumn("outside", F.lit(1)))
    sized = every.join(words.select("query", F.size("words").alias("own")), "query").join(refs.select("ref_id", "vocabulary"), "ref_id")
    return similarity(sized).select("query", "ref_id", "similarity", "outside")


def along(rows: DataFrame, hits: DataFrame, truth: DataFrame, refs: DataFrame, stats: DataFrame, tree: DataFrame) -> DataFrame:
    """The rows of the design that lie along truth(query, label, names, nodes), a query's own lineage: those
    of its named children as ``present``, and, where named children are left that no hit lies under, one row
    ``absent`` for these. A rank that the query's label leaves blank is walked through without rows, and at
    the first taxon that the index doesn't know the walk ends."""
    steps = truth.select("query", "label", "names", F.posexplode("nodes").alias("rank", "target"), "nodes").where("target >= 0")
    steps = steps.select("query", "label", "rank", "target", F.when(F.col("rank") > 0, F.try_element_at("nodes", F.col("rank"))).otherwise(0).alias("parent"), F.col("names")[F.col("rank")].alias("name")).where("name <> ''")
    present = rows.join(steps, ["query", "rank", "parent"])
    number = lambda c, digits: F.format_string(f"%.{digits}f", F.col(c).cast("double"))
    kids = stats.select(F.col("node_id").alias("parent"), "children")
    lines = hits.join(refs.select("ref_id", "lineage"), "ref_id").select("query", "similarity", F.posexplode("lineage").alias("rank", "node"))
    under = lines.groupBy("query", "rank", "node").agg(F.max("similarity").alias("s1")).join(tree.select(F.col("node_id").alias("node"), "parent", "name"), "node")
    met = under.groupBy("query", "rank", "parent").agg(F.count_if(F.col("name") != "").alias("matched"), F.max(F.when(F.col("name") == "", F.col("s1"))).alias("sentinel"))
    seen = under.where("name <> ''").select("query", "rank", F.col("node").alias("target"), F.lit(True).alias("resolved"))
    absent = steps.join(met, ["query", "rank", "parent"]).join(kids, "parent").withColumn("multiplicity", F.col("children") - F.col("matched")).where("multiplicity > 0").join(seen, ["query", "rank", "target"], "left")
    code = F.substring(F.lit(RANKS), F.col("rank") + 1, F.lit(1)).alias("rank")
    zero = F.lit("0")
    one = present.select(F.col("query").alias("at"), F.col("rank").alias("level"), F.lit(0).alias("last"), F.col("seat.outside").alias("outside"), F.col("seat.ref_id").alias("first"), F.col("label").alias("query"), code, F.lit("present").alias("kind"), F.col("node").cast("long"), number("s1", 6).alias("s1"), number("gap", 6).alias("gap"), number("vote", 4).alias("vote"), number("genera", 6).alias("genera"), number("sentinel", 6).alias("sentinel"), F.lit(1).cast("long").alias("multiplicity"), (F.col("node") == F.col("target")).cast("int").alias("truth"))
    two = absent.withColumn("sentinel", F.coalesce("sentinel", F.lit(0.0))).select(F.col("query").alias("at"), F.col("rank").alias("level"), F.lit(1).alias("last"), F.lit(0).alias("outside"), F.lit(0).alias("first"), F.col("label").alias("query"), code, F.lit("absent").alias("kind"), F.lit(0).cast("long").alias("node"), *(zero.alias(c) for c in ("s1", "gap", "vote", "genera")), number("sentinel", 6).alias("sentinel"), F.col("multiplicity").cast("long"), F.col("resolved").isNull().cast("int").alias("truth"))
    return one.unionByName(two).orderBy("at", "level", "last", "outside", "first", "node").drop("at", "level", "last", "outside", "first")


def softmax(rows: DataFrame, params: dict[str, list[float]]) -> DataFrame:
    """design rows with probability (of the child) and novel (of none of the named children)."""
    beta = F.create_map(*(x for r, v in params.items() for x in (F.lit(RANKS.index(r)), F.array(*map(F.lit, v)))))[F.col("rank")]
    z = beta[0] + beta[1] * F.col("s1") + beta[2] * F.col("gap") + beta[3] * F.col("vote") + beta[4] * F.col("genera") + beta[5] * F.col("sentinel")
    own = Window.partitionBy("query", "rank", "parent")
    away = beta[6] + beta[5] * F.col("sentinel")
    scored = rows.withColumn("z", z).withColumn("away", away)
    scored = scored.withColumn("peak", F.greatest(F.lit(0.0), F.max("z").over(own), F.when(F.col("absent") > 0, F.col("away")).otherwise(0.0)))
    none = F.exp(-F.col("peak")) + F.when(F.col("absent") > 0, F.col("absent") * F.exp(F.col("away") - F.col("peak"))).otherwise(0.0)
    scored = scored.withColumn("term", F.exp(F.col("z") - F.col("peak"))).withColumn("none", none)
    total = F.sum("term").over(own) + F.col("none")
    return scored.withColumn("probability", F.col("term") / total).withColumn("novel", F.col("none") / total).drop("z", "away", "peak", "term", "none")


def resolve(chances: DataFrame, sentinels: DataFrame, floor: float = 0.001) -> DataFrame:
    """query, rank, node, probability, novel: the walk from the root. At each rank the most probable
    child is taken (ties: the one whose first hit comes last, hits in order of ``outside`` and id) and probabilities multiply; where nothing is named the
    walk goes through the unnamed child, sentinels(query, rank, parent, node), at no cost; below
    ``floor`` it ends. A query's rows are few: named children that its candidates lie under."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        parent, reached, out = 0, 1.0, []
        for rank in range(LEVELS):
            if reached < floor:
                break
            here = pdf[(pdf["rank"] == rank) & (pdf["parent"] == parent)]
            named = here[here["probability"].notna()]
            if len(named):
                best = named.sort_values(["probability", "outside", "first"]).iloc[-1]
                novel = reached * best["novel"]
                reached *= best["probability"]
                parent = int(best["node"])
                out.append((int(best["query"]), rank, parent, reached, novel))
            elif len(here):
                parent = int(here.iloc[0]["node"])
            else:
                break
        return pd.DataFrame(out, columns=["query", "rank", "node", "probability", "novel"])

    nothing = F.lit(None).cast("double")
    zero = F.lit(0).cast("long")
    rows = chances.select("query", "rank", "parent", "node", "probability", "novel", F.col("seat.outside").cast("long").alias("outside"), F.col("seat.ref_id").cast("long").alias("first"))
    rows = rows.unionByName(sentinels.select("query", "rank", "parent", "node", nothing.alias("probability"), nothing.alias("novel"), zero.alias("outside"), zero.alias("first")))
    return rows.groupBy("query").applyInPandas(walk, "query long, rank int, node long, probability double, novel double")


def unnamed(hits: DataFrame, refs: DataFrame, tree: DataFrame) -> DataFrame:
    """query, rank, parent, node: unnamed nodes that scored references lie under."""
    lines = hits.select("query", "ref_id").join(refs.select("ref_id", "lineage"), "ref_id").select("query", F.explode("lineage").alias("node")).distinct()
    return lines.join(tree.where("name = ''").select(F.col("node_id").alias("node"), "parent", "rank"), "node").select("query", "rank", "parent", "node")
