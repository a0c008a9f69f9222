"""A query for each operator of the engine, over whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.functions import sequences as S
from cladeforge.functions import taxonomy
from cladeforge.functions.hashing import SplitMix
from cladeforge.operators import classify, curate, index, logistic, rank, scoring
from cladeforge.plans import derived as D
from cladeforge.plans.derived import CANDIDATES, POLICY
from cladeforge.sources.shared import materialise

QUERIES = {}
PARAMS = {r: [0.2 + 0.05 * i, 6.0, 3.0, 2.5, 0.1, -1.5, -2.0] for i, r in enumerate("dkpcofg")}
SPLITMIX_SEEDS, SPLITMIX_BOUNDS = tuple(range(1, 9)), (1, 2, 3, 1000, 65535)


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- row-wise ---------------------------------------------------------------------------------


@query
def normalize_sequence(spark: SparkSession, d: str) -> DataFrame:
    r = D.references(spark, d)
    return r.select("ordinal", S.unknown(F.col("seq")).alias("unknown"), F.md5(S.normalize(F.col("seq"))).alias("seq_md5"))


@query
def unique_words(spark: SparkSession, d: str) -> DataFrame:
    return D.reference_records(spark, d).select("ordinal", F.size("words").alias("n"), D.digest(F.col("words")).alias("words_md5"))


@query
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return D.references(spark, d).select("ordinal", F.md5(S.reverse_complement(S.normalize(F.col("seq")))).alias("seq_md5"))


@query
def revcomp_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return index.reverse_strand(D.reference_records(spark, d).select("ordinal", "words")).select("ordinal", D.digest(F.col("words")).alias("words_md5"))


@query
def parse_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    r = D.references(spark, d).withColumn("tax", taxonomy.parse(F.col("label")))
    return r.select("ordinal", F.col("tax.error").isNull().alias("ok"), F.when(F.col("tax.error").isNull(), F.array_join("tax.lineage", "|")).alias("lineage"))


@query
def permute_word(spark: SparkSession, d: str) -> DataFrame:
    w = D.lettered(D.postings(spark, d).select("word").distinct()).withColumn("code", S.word_code(F.col("word")))
    return w.select("word", "code", S.permuted(F.col("code")).alias("hash"))


@query
def minhash_sketch(spark: SparkSession, d: str) -> DataFrame:
    return D.summaries(spark, d).select("ordinal", F.array_join("sketch", ",").alias("sketch"))


def _taxonomy(spark, d):
    """Nodes and references, each written once for the steps that read them again."""
    tree = materialise(D.tree(spark, d), "nodes")
    return tree, materialise(index.references(D.parsed(spark, d), tree).drop("seq", "words"), "references")


# -- index ------------------------------------------------------------------------------------


@query
def taxonomy_nodes(spark: SparkSession, d: str) -> DataFrame:
    return D.tree(spark, d).select("node_id", "parent", "rank", "name")


@query
def locate_lineage(spark: SparkSession, d: str) -> DataFrame:
    q = D.query_records(spark, d).select("query", F.col("tax.lineage").alias("lineage"))
    return index.locate(q, D.tree(spark, d)).select("query", F.array_join("nodes", ",").alias("nodes"))


@query
def rank_census(spark: SparkSession, d: str) -> DataFrame:
    return index.rank_census(D.parsed(spark, d))


@query
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return D.lettered(index.document_frequency(D.postings(spark, d)))


@query
def taxon_frequency(spark: SparkSession, d: str) -> DataFrame:
    return D.lettered(index.taxon_frequency(D.postings(spark, d), D.refs(spark, d)))


@query
def node_stats(spark: SparkSession, d: str) -> DataFrame:
    tree, refs = _taxonomy(spark, d)
    return index.node_stats(tree, refs)


@query
def word_weights(spark: SparkSession, d: str) -> DataFrame:
    return D.lettered(index.word_weights(index.document_frequency(D.postings(spark, d)).withColumnRenamed("df", "n")))


@query
def index_verify(spark: SparkSession, d: str) -> DataFrame:
    """Mismatches of an index from which known rows were taken: the postings and statistics of every
    word of the second smallest reference, one vocabulary and one node's statistics are wrong."""
    reads = D.references(spark, d)
    built = index.build(reads.where(taxonomy.parse(F.col("label"))["error"].isNull()))
    # words are made again from the sequences: as a table they would be several times these
    tree, refs = materialise(built.nodes, "nodes"), materialise(built.refs.drop("words"), "references")
    words = index.worded(refs)
    post, stats = index.postings(words), index.word_stats(words)
    low = refs.agg(F.min_by("ref_id", F.struct("vocabulary", "ref_id")).alias("ref_id"))
    low = refs.join(low, "ref_id", "left_anti").agg(F.min_by("ref_id", F.struct("vocabulary", "ref_id")).alias("ref_id"))
    hit = materialise(index.postings(index.worded(refs.join(F.broadcast(low), "ref_id"))), "hit")  # one row
    damaged = index.Index(
        tree,
        refs.join(F.broadcast(low.withColumn("off", F.lit(1))), "ref_id", "left").withColumn("vocabulary", F.col("vocabulary") + F.coalesce("off", F.lit(0))).drop("off"),  # one row
        post.join(hit, ["word", "ref_id"], "left_anti"),
        stats.join(hit, "word", "left_anti"),
        index.node_stats(tree, refs).where("node_id <> 0"),
        built.meta,
    )
    return index.verify(damaged)


# -- rank -------------------------------------------------------------------------------------


@query
def rank_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.counts(spark, d)


@query
def candidate_select(spark: SparkSession, d: str) -> DataFrame:
    return rank.select(D.counts(spark, d), CANDIDATES)


@query
def count_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rank.histogram(D.counts(spark, d), D.query_records(spark, d), D.parsed(spark, d).count())


@query
def holdout_self(spark: SparkSession, d: str) -> DataFrame:
    r = D.parsed(spark, d).select(F.col("ordinal").alias("ref_id"), F.size("words").alias("vocabulary"))
    return rank.holdout_self(D.counts(spark, d), D.query_records(spark, d), r)


@query
def holdout_genus(spark: SparkSession, d: str) -> DataFrame:
    tree = D.tree(spark, d)
    located = index.locate(D.query_records(spark, d).select("query", F.col("tax.lineage").alias("lineage")), tree)
    return rank.holdout_rank(D.counts(spark, d), located, D.refs(spark, d), 6)


@query
def risk_bound(spark: SparkSession, d: str) -> DataFrame:
    """Expected pruned references that would reach a score of 4."""
    counted, q = D.counts(spark, d), D.query_records(spark, d)
    hist = rank.histogram(counted, q, D.parsed(spark, d).count())
    thresholds = rank.select(counted, CANDIDATES).groupBy("query").agg(F.min("count").alias("threshold"))
    return rank.risk(hist, q, thresholds, 4).select("query", F.round("risk", 6).alias("risk"))


# -- replicates -------------------------------------------------------------------------------


def _bounded_draws() -> list[tuple[int, int, int]]:
    return [(s, n, int(SplitMix(s).bounded(n)[0])) for s in SPLITMIX_SEEDS for n in SPLITMIX_BOUNDS]


@query
def splitmix_bounded(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_bounded_draws(), "seed long, bound long, value long")


#: The engine's defaults, with the stream hash that SQL has as well.
CONFIG = classify.Config(hash="sha256")


def _weights(spark, d):
    return index.word_weights(index.document_frequency(D.postings(spark, d)).withColumnRenamed("df", "n"))


@query
def bootstrap_draws(spark: SparkSession, d: str) -> DataFrame:
    return D.lettered(scoring.draws(D.query_records(spark, d), hash="sha256"))


@query
def replicate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Exact weighted scores, summed up for each replicate: references that score, their sum, the
    largest, and a sum in which each reference's score counts differently."""
    scored = scoring.scores(scoring.draws(D.query_records(spark, d), hash="sha256"), D.postings(spark, d), _weights(spark, d))
    return scoring.unpacked(scored).groupBy("query", "boot").agg(F.count("*").alias("refs"), F.sum("score").alias("total"), F.max("score").alias("most"), F.sum(F.col("score") * (F.col("ref_id") % 1009)).alias("mixed"))


@query
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each query's candidates, summed up like those of all references."""
    few = rank.select(D.counts(spark, d), CANDIDATES)
    scored = scoring.scores(scoring.draws(D.query_records(spark, d), hash="sha256"), D.postings(spark, d), None, few)
    return scoring.unpacked(scored).groupBy("query", "ref_id").agg(F.count("*").alias("boots"), F.sum("score").alias("total"), F.sum(F.col("score") * F.col("boot")).alias("mixed"))


def _tops(spark, d):
    post = D.postings(spark, d)
    return classify.tops(D.query_records(spark, d).select("query", "seq", "words"), post, D.parsed(spark, d).count(), CONFIG)


@query
def replicate_tops(spark: SparkSession, d: str) -> DataFrame:
    return _tops(spark, d).select("query", "boot", "score", F.array_join("ties", ",").alias("ties"))


@query
def tie_pick(spark: SparkSession, d: str) -> DataFrame:
    return materialise(scoring.picks(_tops(spark, d), D.query_records(spark, d), hash="sha256"), "winners")


def _names(spark, d):
    return D.parsed(spark, d).select(F.col("ordinal").alias("ref_id"), F.col("tax.lineage").alias("lineage"))


@query
def consensus_calls(spark: SparkSession, d: str) -> DataFrame:
    return materialise(scoring.consensus(tie_pick(spark, d), _names(spark, d)), "calls")


@query
def consensus_tallies(spark: SparkSession, d: str) -> DataFrame:
    return scoring.tallies(tie_pick(spark, d), _names(spark, d))


@query
def confidence_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return scoring.support(consensus_calls(spark, d)).select("query", "rank", F.round("confidence", 6).alias("confidence"))


@query
def prediction_tsv(spark: SparkSession, d: str) -> DataFrame:
    return scoring.predictions(D.query_records(spark, d), scoring.support(consensus_calls(spark, d), adjusted=False))


@query
def minimum_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Records with too few words to draw from."""
    return D.reference_records(spark, d).where(F.size("words") < scoring.SAMPLE_SIZE).select("ordinal", F.size("words").alias("words"))


@query
def reference_lineages(spark: SparkSession, d: str) -> DataFrame:
    """The seven nodes above each reference."""
    return D.refs(spark, d).select("ref_id", "leaf", F.array_join("lineage", ",").alias("lineage"))


@query
def best_strand(spark: SparkSession, d: str) -> DataFrame:
    """Of both strands' best candidate counts, the strand that is taken."""
    q = D.query_records(spark, d)
    post = D.postings(spark, d)
    out, forward = None, q.select("query", "words")
    for strand, words in ((0, forward), (1, index.reverse_strand(forward))):
        c = rank.counts(words, post)
        side = c.groupBy("query").agg(F.max("count").alias("max"), F.count_if(F.col("count") >= 32).alias("winners")).withColumn("strand", F.lit(strand))
        out = side if out is None else out.unionByName(side)
    return scoring.best_strand(out)


# -- logistic scorer --------------------------------------------------------------------------


def _sized(spark, d):
    return D.parsed(spark, d).select(F.col("ordinal").alias("ref_id"), F.size("words").alias("vocabulary"))


def _hits(spark, d, won=None):
    """Similarities of the candidates, and of the winners that are not among them."""
    words = D.query_records(spark, d).select("query", "words")
    won = won if won is not None else words.select("query", F.lit(None).cast("long").alias("ref_id")).where(F.lit(False))
    return logistic.with_outside(materialise(D.counts(spark, d), "counts"), won, words, _sized(spark, d), CONFIG.candidates)


@query
def protax_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query", "ref_id", F.round("similarity", 6).alias("similarity"))


@query
def outside_winners(spark: SparkSession, d: str) -> DataFrame:
    """Candidates, few of them, and the replicate winners outside."""
    words = D.query_records(spark, d).select("query", "words")
    found = logistic.with_outside(materialise(D.counts(spark, d), "counts"), tie_pick(spark, d), words, _sized(spark, d), 3)
    return found.select("query", "ref_id", F.round("similarity", 6).alias("similarity"), "outside")


@query
def protax_gap(spark: SparkSession, d: str) -> DataFrame:
    """The gap between the two best candidates of each query, over all its candidates."""
    own = Window.partitionBy("query").orderBy(F.desc("similarity"), "ref_id")
    top = _hits(spark, d).withColumn("place", F.row_number().over(own))
    pair = top.groupBy("query").agg(F.max(F.when(F.col("place") == 1, F.col("similarity"))).alias("a"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("similarity"))), F.lit(0.0)).alias("b"), F.count("*").alias("n"))
    return pair.select("query", F.round(logistic.gap(F.col("a"), F.col("b"), F.col("n"), F.col("n")), 6).alias("gap"))


def _design(spark, d):
    """The design of queries with enough winners, and what it is made of: hits, references, nodes."""
    tree, refs = _taxonomy(spark, d)
    won = tie_pick(spark, d)
    won = materialise(won.withColumn("n", F.count("*").over(Window.partitionBy("query"))).where(F.col("n") >= scoring.BOOTSTRAPS // 2).drop("n"), "enough")
    hits = materialise(_hits(spark, d, won).join(won.select("query").distinct(), "query", "left_semi"), "hits")
    stats = materialise(index.node_stats(tree, refs), "node_stats")
    return materialise(logistic.design(hits, won, refs, stats, tree), "design"), hits, refs, tree, stats


@query
def protax_design(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _design(spark, d)[0].select("query", "rank", "parent", "node", r("s1"), r("gap"), r("vote"), r("genera"), r("sentinel"), "absent")


@query
def protax_softmax(spark: SparkSession, d: str) -> DataFrame:
    p = logistic.softmax(_design(spark, d)[0], PARAMS)
    return p.select("query", "rank", "node", F.round("probability", 6).alias("probability"), F.round("novel", 6).alias("novel"))


@query
def protax_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows, hits, refs, tree, _ = _design(spark, d)
    steps = logistic.resolve(logistic.softmax(rows, PARAMS), logistic.unnamed(hits, refs, tree))
    return steps.select("query", "rank", "node", F.round("probability", 6).alias("probability"), F.round("novel", 6).alias("novel"))


@query
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """The feature table along each query's own lineage."""
    rows, hits, refs, tree, stats = _design(spark, d)
    q = D.query_records(spark, d)
    located = index.locate(q.select("query", F.col("tax.lineage").alias("lineage")), tree)
    return logistic.along(rows, hits, located.join(q.select("query", "label", F.col("tax.lineage").alias("names")), "query"), refs, stats, tree)


# -- curation ---------------------------------------------------------------------------------


@query
def survey_summary(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(spark, d)
    return s.select("ordinal", F.array_join("lineage", "|").alias("lineage"), "length", "words", "ambiguous", "digest", "shallow", "organellar")


@query
def policy_flags(spark: SparkSession, d: str) -> DataFrame:
    return curate.policy_flags(D.summaries(spark, d), POLICY).select("ordinal", "demoted", "oversize", "low_complexity", "is_ambiguous", "rejected")


@query
def oversize_list(spark: SparkSession, d: str) -> DataFrame:
    return curate.oversize_list(D.summaries(spark, d), POLICY)


@query
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return curate.dedup_exact(D.summaries(spark, d)).select("ordinal")


@query
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    return curate.duplicate_audit(D.summaries(spark, d))


@query
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = curate.percentiles(D.summaries(spark, d))
    return p.withColumn("mean", F.round("mean", 6))


@query
def cap_curve(spark: SparkSession, d: str) -> DataFrame:
    return curate.cap_curve(curate.groups(D.summaries(spark, d)))


@query
def occupancy_classes(spark: SparkSession, d: str) -> DataFrame:
    return curate.occupancy_classes(D.summaries(spark, d))


@query
def occupancy_domains(spark: SparkSession, d: str) -> DataFrame:
    return curate.occupancy_domains(D.summaries(spark, d))


@query
def truncation_artifact(spark: SparkSession, d: str) -> DataFrame:
    return curate.truncation_artifact(D.summaries(spark, d))


@query
def plan_totals(spark: SparkSession, d: str) -> DataFrame:
    return curate.plan_totals(D.summaries(spark, d), POLICY)


@query
def order_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = curate.order_coverage(curate.groups(D.summaries(spark, d)))
    return c.select(F.translate("order_path", "\x1f", "|").alias("order_path"), "annotated")


@query
def shallow_classes(spark: SparkSession, d: str) -> DataFrame:
    c = curate.shallow_classes(curate.groups(D.summaries(spark, d)))
    return c.where("class is not null").groupBy("class").agg(F.count("*").alias("lineages"), F.sum("records").alias("records"))


@query
def group_caps(spark: SparkSession, d: str) -> DataFrame:
    return curate.group_caps(curate.groups(D.summaries(spark, d)), POLICY).select("g", "records", "class", "cap")


@query
def restored_groups(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(spark, d)
    _, back = curate.eligible(s, materialise(curate.groups(s), "groups"), POLICY)
    return back.select("g", "ordinal")


@query
def select_first(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(spark, d)
    return curate.select_first(s, materialise(curate.groups(s), "groups"), POLICY).select("g", "ordinal")


@query
def drop_counts(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(spark, d)
    g = materialise(curate.groups(s), "groups")
    return curate.drop_counts(s, g, POLICY, materialise(curate.select_first(s, g, POLICY), "kept"))


@query
def curation_invariants(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(spark, d)
    g = materialise(curate.groups(s), "groups")
    return curate.invariants(g, POLICY, materialise(curate.select_first(s, g, POLICY), "kept"))


@query
def hazard_after(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(spark, d)
    return curate.hazard_after(curate.select_first(s, materialise(curate.groups(s), "groups"), POLICY), POLICY)


@query
def diversity_probe(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(spark, d)
    p = curate.diversity(s, curate.groups(s))
    return p.select("ordinal", "partner", F.round("distance", 6).alias("distance"))


@query
def sketch_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each record's sketch to that of the first record of its lineage."""
    s = D.summaries(spark, d)
    first = curate.groups(s).select("leaf", F.col("first").alias("other")).join(s.select(F.col("ordinal").alias("other"), F.col("sketch").alias("second")), "other").select("leaf", "other", "second")
    return s.join(first, "leaf").select("ordinal", "other", F.round(S.jaccard(F.col("sketch"), F.col("second")), 6).alias("jaccard"))


@query
def lsh_density(spark: SparkSession, d: str) -> DataFrame:
    return curate.lsh_density(D.summaries(spark, d))


@query
def select_random(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(spark, d)
    return curate.select_random(s, materialise(curate.groups(s), "groups"), POLICY).select("ordinal")


@query
def select_maxmin(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(spark, d)
    return curate.select_maxmin(s, materialise(curate.groups(s), "groups"), POLICY).select("ordinal")


@query
def select_cover(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(spark, d)
    return curate.select_cover(s, materialise(curate.groups(s), "groups"), POLICY).select("ordinal")
