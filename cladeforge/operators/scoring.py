"""Bootstrap replicates: seeded draws, weighted scores, winners with ties, consensus and support.

Draws are a pure function of (seed, sequence, strand, replicate), so results don't depend on how
rows are partitioned. ``DOMAINS`` are the labels that are hashed in front; whoever must reproduce
draws keyed with other labels passes those. The hash is BLAKE3, or with ``hash="sha256"`` SHA-256 over
text, which SQL engines have as well: key = sha256("query:version:seed:sequence"), a stream's seed the
first 16 hex digits of sha256("key:strand:role:replicate").

Scores of all replicates are summed together: a score is at most 128, so a byte holds it and PER scores
share one long. A query and word has one row of LONGS numbers, and so has a query and reference; the only
wide join has a row per (query, word, reference), whatever the number of replicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.functions.hashing import SplitMix, blake3, blake3_short
from cladeforge.functions.taxonomy import LEVELS, RANKS

#: Fixed values.
BOOTSTRAPS, SAMPLE_SIZE, ALGORITHM_VERSION, FLOOR = 100, 32, 1, 2
DOMAINS = (b"cladeforge/query\0", b"cladeforge/strm\0")
PER = 7
LONGS = -(-BOOTSTRAPS // PER)


def stream_seeds(sequence: str, seed: int, strand: int, role: int, domains=DOMAINS, boots: int = BOOTSTRAPS, hash: str = "blake3") -> np.ndarray:
    """One generator seed for each replicate."""
    if hash == "sha256":
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        own = digest(f"query:{ALGORITHM_VERSION}:{seed}:{sequence}")
        return np.array([int(digest(f"{own}:{strand}:{role}:{boot}")[:16], 16) for boot in range(boots)], np.uint64)
    key = blake3(domains[0] + ALGORITHM_VERSION.to_bytes(4, "little") + seed.to_bytes(8, "little") + sequence.encode())
    head = domains[1] + key + bytes([strand, role])
    rows = np.empty((boots, len(head) + 4), np.uint8)
    rows[:, : len(head)] = np.frombuffer(head, np.uint8)
    rows[:, len(head) :] = np.arange(boots, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return blake3_short(rows)


def draw(sequence: str, vocabulary: int, seed: int, strand: int = 0, domains=DOMAINS, hash: str = "blake3") -> np.ndarray:
    """int[replicates, SAMPLE_SIZE]: positions in the vocabulary, drawn with replacement."""
    streams = SplitMix(stream_seeds(sequence, seed, strand, 0, domains, hash=hash))
    return np.stack([streams.bounded(vocabulary) for _ in range(SAMPLE_SIZE)], axis=1).astype(np.int64)


def draws(queries: DataFrame, seed: int = 1, domains=DOMAINS, strand: int = 0, hash: str = "blake3") -> DataFrame:
    """query, boot, word, mult: drawn words of queries(query, seq, words) with at least SAMPLE_SIZE
    words, with the times each was drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, s, w in zip(b.column("query").to_pylist(), b.column("seq").to_pylist(), b.column("words").to_pylist(), strict=True):
                found = draw(s, len(w), seed, strand, domains, hash)
                code = np.arange(BOOTSTRAPS)[:, None] * len(w) + found
                some, times = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_pydict({"query": pa.array([q] * len(some), pa.int64()), "boot": pa.array(some // len(w), pa.int32()), "word": pa.array(np.asarray(w, np.int32)[some % len(w)]), "mult": pa.array(times, pa.int32())})

    enough = queries.where(F.size("words") >= SAMPLE_SIZE).select("query", "seq", "words")
    return enough.mapInArrow(run, "query long, boot int, word int, mult int")


def scores(drawn: DataFrame, postings: DataFrame, weights: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """query, ref_id, p0 ..: weighted draws that the reference has, of candidates if given, for all
    replicates (see unpacked). Candidates' words are looked up before draws are joined, so that nothing
    is scored that is not asked for."""
    if weights is not None:
        drawn = drawn.join(weights, "word").select("query", "boot", "word", (F.col("mult") * F.col("weight")).alias("mult"))
    own = F.expr(f"shiftleft(cast(mult as bigint), cast(boot % {PER} * 8 as int))")
    packed = drawn.groupBy("query", "word").agg(*(F.sum(F.when(F.expr(f"boot div {PER} = {c}"), own).otherwise(F.lit(0))).alias(f"p{c}") for c in range(LONGS)))
    if candidates is None:
        hits = packed.join(postings, "word")
    else:
        hits = candidates.select("query", "ref_id").join(postings, "ref_id").join(packed, ["query", "word"])
    return hits.groupBy("query", "ref_id").agg(*(F.sum(f"p{c}").alias(f"p{c}") for c in range(LONGS)))


def _each() -> F.Column:
    """array<struct<boot, score>> of a row of scores."""
    return F.array(*(F.expr(f"struct({b} as boot, cast(shiftright(p{b // PER}, {8 * (b % PER)}) & 255 as bigint) as score)") for b in range(BOOTSTRAPS)))


def unpacked(scored: DataFrame) -> DataFrame:
    """query, ref_id, boot, score: a row for each score above zero."""
    return scored.select("query", "ref_id", F.inline(F.filter(_each(), lambda x: x["score"] > 0)))


def tops(scored: DataFrame) -> DataFrame:
    """query, boot, score, ties: the best score of a replicate and the references that have it,
    ascending. The best scores are found first, so only ties are gathered."""
    best = unpacked(scored).groupBy("query", "boot").agg(F.max("score").alias("score"))
    best = best.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("boot", "score"))).alias("best"))  # BOOTSTRAPS entries
    tied = F.inline(F.filter(_each(), lambda x: (x["score"] > 0) & (x["score"] == F.col("best")[x["boot"]])))
    return scored.join(best, "query").select("query", "ref_id", tied).groupBy("query", "boot", "score").agg(F.array_sort(F.collect_list("ref_id")).alias("ties"))


def picks(topped: DataFrame, queries: DataFrame, seed: int = 1, domains=DOMAINS, strand: int = 0, hash: str = "blake3") -> DataFrame:
    """query, boot, score, ref_id: the winner of each replicate that reaches FLOOR, ties broken by
    the replicate's own generator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[int, np.ndarray] = {}
            out = []
            for q, s, boot, score, ties in zip(*(b.column(c).to_pylist() for c in ("query", "seq", "boot", "score", "ties")), strict=True):
                if q not in known:
                    known[q] = stream_seeds(s, seed, strand, 1, domains, hash=hash)
                at = SplitMix(known[q][boot : boot + 1]).bounded(len(ties))[0]
                out.append((q, boot, score, ties[int(at)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "boot", "score", "ref_id"])

    ready = topped.where(F.col("score") >= FLOOR).join(queries.select("query", "seq"), "query")
    return ready.mapInArrow(run, "query long, boot int, score long, ref_id long")


def _walked(won: DataFrame, names: DataFrame) -> DataFrame:
    """query, c0 .. c6: what the consensus chose at each rank (see consensus)."""
    lines = won.join(names, "ref_id").groupBy("query", "lineage").agg(F.count("*").alias("n"))
    own = Window.partitionBy("query")
    state = lines.withColumn("all", F.sum("n").over(own)).where(F.col("all") >= BOOTSTRAPS // 2).withColumn("in", F.lit(True))
    for r in range(LEVELS):
        name = F.col("lineage")[r]
        state = state.withColumn("name", name).withColumn("counted", F.when(F.col("in"), F.col("n")).otherwise(0))
        state = state.withColumn("votes", F.sum("counted").over(Window.partitionBy("query", "name")))
        best = F.min(F.when(F.col("in"), F.struct((F.col("name") == "").alias("unnamed"), (-F.col("votes")).alias("less"), "name"))).over(own)
        state = state.withColumn("best", best).withColumn("informative", F.sum(F.when(F.col("name") != "", F.col("counted")).otherwise(0)).over(own))
        blank = F.sum(F.when(F.col("name") == "", F.col("counted")).otherwise(0)).over(own)
        call = F.struct(F.lit(r).alias("rank"), F.col("best.name").alias("name"), (-F.col("best.less")).alias("votes"), "informative", blank.alias("blank"))
        state = state.withColumn(f"call{r}", call).withColumn("in", F.col("in") & (F.col("name") == F.col("best.name"))).drop("name", "counted", "votes", "best", "informative")
    return state.groupBy("query").agg(F.array(*(F.first(f"call{r}") for r in range(LEVELS))).alias("calls"))


def consensus(won: DataFrame, names: DataFrame) -> DataFrame:
    """query, rank, name, votes, informative: the consensus down the ranks of won(query, ref_id),
    with names(ref_id, lineage array<string>).

    At each rank the winners still in are counted by name. The best named taxon is taken (ties: the
    smallest name); an unnamed one only where nothing is named, and then without a call. Winners
    outside it leave. Under half of the replicates: no calls. Rows are one per query and lineage (100
    at most a query), dealt once by query; all ranks are windows over that one exchange.
    """
    return _walked(won, names).select("query", F.explode("calls").alias("call")).select("query", "call.*").where("name <> ''").drop("blank")


def tallies(won: DataFrame, names: DataFrame) -> DataFrame:
    """query, voted, abstained, informative of queries with a call: the ranks that were voted on (all seven),
    those where winners without a name were as many as those of the taxon that was taken, or more, and
    the informative winners of each rank."""
    walked = _walked(won, names).where(F.exists("calls", lambda c: c["name"] != ""))
    outvoted = F.size(F.filter("calls", lambda c: (c["name"] != "") & (c["blank"] > 0) & (c["blank"] >= c["votes"])))
    return walked.select("query", F.lit(LEVELS).alias("voted"), outvoted.alias("abstained"), F.array_join(F.transform("calls", lambda c: c["informative"]), ",").alias("informative"))


def support(calls: DataFrame, adjusted: bool = True, min_informative: float = 0.5) -> DataFrame:
    """calls with confidence: votes of all replicates or, where enough of them are informative, of
    those; never rising down the ranks."""
    own = F.col("votes") / F.lit(float(BOOTSTRAPS))
    if adjusted:
        own = F.when(F.col("informative") < min_informative * BOOTSTRAPS, own).otherwise(F.col("votes") / F.col("informative"))
    down = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.withColumn("own", own).withColumn("confidence", F.min("own").over(down)).drop("own")


def best_strand(outcomes: DataFrame) -> DataFrame:
    """The strand with the highest score, then most winners; forward (0) if equal."""
    order = Window.partitionBy("query").orderBy(F.desc("max"), F.desc("winners"), "strand")
    return outcomes.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def predictions(queries: DataFrame, supported: DataFrame, cutoff: float = 0.8, strand: str = "+", informative: DataFrame | None = None) -> DataFrame:
    """query, line: tab-separated label, all calls, strand, calls at the cutoff. Confidence is
    written with two decimals, half to even as floating point is; the cutoff sees it unrounded.

    A column ``strand`` of supported (0, 1) goes before the argument. Where supported has ``novel``, the
    probability of a taxon not in the index, a column follows with it; ``informative`` (tallies) adds one with
    the informative winners of each rank that was voted on."""
    names = ["rank", "name", "confidence", *(["novel"] if "novel" in supported.columns else [])]
    extra = (len(names) == 4) + (informative is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for label, calls, mark, votes in zip(*(b.column(c).to_pylist() for c in ("label", "calls", "mark", "votes")), strict=True):
                if not calls:
                    out.append(label + "\t" * (3 + extra))
                    continue
                every = ",".join(f"{RANKS[c['rank']]}:{c['name']}({c['confidence']:.2f})" for c in calls)
                sure = ",".join(f"{RANKS[c['rank']]}:{c['name']}" for c in calls if c["confidence"] >= cutoff)
                line = f"{label}\t{every}\t{mark}\t{sure}"
                if "novel" in calls[0]:
                    line += "\t" + ",".join(f"{RANKS[c['rank']]}:{c['novel']:.3f}" for c in calls)
                if votes is not None:
                    line += "\t" + ",".join(f"{r}:{n}" for r, n in zip(RANKS, votes.split(","), strict=True))
                out.append(line)
            yield pa.RecordBatch.from_arrays([b.column("query"), pa.array(out, pa.string())], ["query", "line"])

    mark = F.when(F.first("strand") == 1, "-").otherwise("+") if "strand" in supported.columns else F.lit(strand)
    rows = supported.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("calls"), mark.alias("mark"))  # seven at most
    ready = queries.select("query", "label").join(rows, "query", "left")
    votes = informative.select("query", F.col("informative").alias("votes")) if informative is not None else None
    ready = ready.join(votes, "query", "left") if votes is not None else ready.withColumn("votes", F.lit(None).cast("string"))
    return ready.select("query", "label", "calls", "mark", "votes").mapInArrow(run, "query long, line string")


def classify(queries: DataFrame, postings: DataFrame, names: DataFrame, seed: int = 1, candidates: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Calls of queries(query, seq, words), as consensus() gives them."""
    scored = scores(draws(queries, seed), postings, weights, candidates)
    return consensus(picks(tops(scored), queries, seed), names)
