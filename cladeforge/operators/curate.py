"""Curation of a reference set: survey, plan, and selection with every lineage preserved.

Summaries are one row per parsed record; everything after the survey works on them, without the
sequences. Percentiles and medians are read off counts of values, so no group is gathered for them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.functions import sequences as S
from cladeforge.functions.hashing import SplitMix, blake3
from cladeforge.operators.index import prefix
from cladeforge.sources.shared import materialise

#: Fixed values.
ORDER, FAMILY, GENUS = 4, 5, 6
CAPS = (1, 2, 3, 5, 10, 20, 25, 50, 100, 250, 500, 1000, 2500)
CLASSES = ((">=20%", 0.20), ("10-20%", 0.10), ("5-10%", 0.05), ("2-5%", 0.02), ("<2%", 0.0))
QUANTILES = {"p01": 0.01, "p25": 0.25, "median": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}
DENSITY_BANDS, BANDS = 4, 8
SURVEY_VERSION = 1
TRUNCATION_LENGTH, TRUNCATION_RECORDS = 4096, 100


@dataclass(frozen=True)
class Policy:
    cap: int = 1000
    demote_length: int = 2000
    max_length: int | None = None
    max_ambiguity: float = 0.10
    min_words: int = 32
    ceiling: float = 0.95
    cover_bands: int = 4
    shallow_covered: int = 50
    shallow_orphan: int = 50
    shallow_unplaced: int = 50
    shallow_ratio: float = 0.10
    drop_shallow: bool = False
    drop_organellar: bool = False

    def __post_init__(self):
        if self.cap < 1 or min(self.shallow_covered, self.shallow_orphan, self.shallow_unplaced) < 1:
            raise ValueError("caps must be positive")
        if not (0 <= self.max_ambiguity <= 1 and 0 <= self.ceiling <= 1 and 0 <= self.shallow_ratio <= 1):
            raise ValueError("ratios must lie in 0..1")
        if not 1 <= self.cover_bands <= BANDS:
            raise ValueError(f"cover_bands must lie in 1..{BANDS}")

    def demoted(self) -> Column:
        return F.col("length") > self.demote_length

    def oversize(self) -> Column:
        return F.lit(False) if self.max_length is None else F.col("length") > self.max_length

    def low_complexity(self) -> Column:
        return F.col("words") < self.min_words

    def ambiguous(self) -> Column:
        return (F.col("length") > 0) & (F.col("ambiguous") / F.col("length") > self.max_ambiguity)

    def rejects(self) -> Column:
        return self.low_complexity() | self.ambiguous() | self.oversize()


def survey(recs: DataFrame) -> DataFrame:
    """Summaries of records(ordinal, label, seq, words, sketch, tax) with a valid lineage: ordinal, lineage,
    leaf and order (path strings), length, words, ambiguous, digest, sketch, shallow, organellar."""
    lineage = F.col("tax.lineage")
    domain = lineage[0]
    return recs.where("tax.error is null").select(
        "ordinal", "label", lineage.alias("lineage"), prefix(lineage, GENUS).alias("leaf"), prefix(lineage, ORDER).alias("order_path"), F.length("seq").alias("length"), F.size("words").alias("words"),
        S.ambiguous(F.col("seq")).alias("ambiguous"), F.sha2("seq", 256).alias("digest"), "sketch",
        ((lineage[FAMILY] == "") & (lineage[GENUS] == "")).alias("shallow"), (domain.startswith("_") | domain.startswith("Unispike")).alias("organellar"),
    )


def groups(summaries: DataFrame) -> DataFrame:
    """leaf, g, records, first: a row per stored lineage; g counts them by first record."""
    found = summaries.groupBy("leaf").agg(F.count("*").alias("records"), F.min("ordinal").alias("first"), F.first("lineage").alias("lineage"), F.first("order_path").alias("order_path"))
    return found.withColumn("g", F.row_number().over(Window.orderBy("first")) - 1)


def order_coverage(found: DataFrame) -> DataFrame:
    """order_path, annotated: records in lineages with a genus, by order."""
    return found.where(F.col("lineage")[GENUS] != "").groupBy("order_path").agg(F.sum("records").alias("annotated"))


def shallow_classes(found: DataFrame) -> DataFrame:
    """groups with class: null where a family or genus is named, else unplaced, covered or orphan."""
    joined = found.join(order_coverage(found), "order_path", "left")
    names = F.col("lineage")
    kind = F.when((names[FAMILY] != "") | (names[GENUS] != ""), None).when(names[ORDER] == "", "unplaced").when(F.col("annotated").isNotNull(), "covered").otherwise("orphan")
    return joined.withColumn("class", kind)


def group_caps(found: DataFrame, policy: Policy) -> DataFrame:
    """shallow_classes with cap and deliberate (the group is left out on purpose)."""
    proportional = F.ceil(F.col("annotated") * policy.shallow_ratio)
    covered = F.greatest(F.lit(1), F.least(F.lit(policy.shallow_covered), proportional))
    cap = F.when(F.col("class").isNull(), policy.cap).when(F.col("class") == "unplaced", policy.shallow_unplaced).when(F.col("class") == "orphan", policy.shallow_orphan).otherwise(covered)
    organellar = F.col("lineage")[0].startswith("_") | F.col("lineage")[0].startswith("Unispike")
    deliberate = F.lit(policy.drop_shallow) & F.col("class").isNotNull() | F.lit(policy.drop_organellar) & organellar
    return shallow_classes(found).withColumn("cap", cap.cast("long")).withColumn("deliberate", deliberate)


def policy_flags(summaries: DataFrame, policy: Policy) -> DataFrame:
    return summaries.withColumns({"demoted": policy.demoted(), "oversize": policy.oversize(), "low_complexity": policy.low_complexity(), "is_ambiguous": policy.ambiguous(), "rejected": policy.rejects()})


def oversize_list(summaries: DataFrame, policy: Policy) -> DataFrame:
    return summaries.where(policy.demoted()).select("label", "length")


def dedup_exact(summaries: DataFrame, keys=("leaf",)) -> DataFrame:
    """The earliest record of each sequence within a lineage. A grouped minimum, then a semi-join:
    copies shrink before they are shuffled, however many there are."""
    first = summaries.groupBy(*keys, "digest", "length").agg(F.min("ordinal").alias("ordinal")).select("ordinal")
    return summaries.join(first, "ordinal", "left_semi")


def duplicate_audit(summaries: DataFrame) -> DataFrame:
    """duplicates (copies that agree on the lineage), conflicting (sequences in several lineages)."""
    runs = summaries.groupBy("digest", "length", "leaf").agg(F.count("*").alias("n")).groupBy("digest", "length").agg(F.sum("n").alias("n"), F.count("*").alias("lineages"))
    return runs.agg(F.coalesce(F.sum(F.col("n") - F.col("lineages")), F.lit(0)).alias("duplicates"), F.count_if(F.col("lineages") > 1).alias("conflicting"))


def percentiles(summaries: DataFrame, column: str = "length") -> DataFrame:
    """min, p01 .. p99, max, mean: the value at floor(n * q), without interpolation."""
    steps = summaries.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    run = steps.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = {name: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("v"))).alias(name) for name, q in QUANTILES.items()}
    return run.agg(F.min("v").alias("min"), *at.values(), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))


def cap_curve(found: DataFrame) -> DataFrame:
    """cap, records: how many records each cap would leave."""
    return found.select("records", F.explode(F.array(*map(F.lit, CAPS))).alias("cap")).groupBy("cap").agg(F.sum(F.least("records", F.col("cap").cast("long"))).alias("records"))


def occupancy_class() -> Column:
    share = F.col("words") / F.lit(float(S.WORD_SPACE))
    out = F.lit(CLASSES[-1][0])
    for name, floor in reversed(CLASSES[:-1]):
        out = F.when(share >= floor, name).otherwise(out)
    return out


def occupancy_classes(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy(occupancy_class().alias("class")).agg(F.count("*").alias("records"), F.sum("length").alias("bases"))


def occupancy_domains(summaries: DataFrame, top: int = 3) -> DataFrame:
    found = summaries.groupBy(occupancy_class().alias("class"), F.col("lineage")[0].alias("domain")).agg(F.count("*").alias("records"))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("records"), "domain"))
    return found.withColumn("place", place).where(F.col("place") <= top)


def truncation_artifact(summaries: DataFrame, least: int = TRUNCATION_RECORDS) -> DataFrame:
    """length, records: the most frequent long length (ties: the shortest), if frequent enough."""
    found = summaries.where(F.col("length") > TRUNCATION_LENGTH).groupBy("length").agg(F.count("*").alias("records"))
    return found.orderBy(F.desc("records"), "length").limit(1).where(F.col("records") >= least)


def plan_totals(summaries: DataFrame, policy: Policy) -> DataFrame:
    n = lambda c: F.count_if(c)
    bases = lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0))
    return summaries.agg(
        F.count("*").alias("records"), n(F.col("organellar")).alias("organellar"), bases(F.col("organellar")).alias("organellar_bases"), n(policy.demoted()).alias("demoted"), bases(policy.demoted()).alias("demoted_bases"),
        n(policy.low_complexity()).alias("low_complexity"), n(policy.ambiguous()).alias("ambiguous"),
    )


def diversity(summaries: DataFrame, found: DataFrame, largest: int = 500, members: int = 128, probed: int = 64) -> DataFrame:
    """leaf, ordinal, partner, distance: sketch distances between records half a group apart, for the
    first members of the largest lineages (ties: earlier lineage)."""
    big = found.orderBy(F.desc("records"), "g").limit(largest).select("leaf")
    own = Window.partitionBy("leaf")
    first = F.row_number().over(own.orderBy("ordinal"))
    some = summaries.join(big, "leaf", "left_semi").select("leaf", "ordinal", "sketch").withColumn("i", first - 1).where(F.col("i") < members).withColumn("n", F.count("*").over(own)).where("n > 1")
    left = some.where(F.col("i") < probed).withColumn("j", F.expr("(i + greatest(n div 2, 1)) % n"))
    right = some.select("leaf", F.col("i").alias("j"), F.col("ordinal").alias("partner"), F.col("sketch").alias("other"))
    return left.join(right, ["leaf", "j"]).select("leaf", "ordinal", "partner", (1 - S.jaccard(F.col("sketch"), F.col("other"))).alias("distance"))


def lsh_density(summaries: DataFrame, bands: int = DENSITY_BANDS) -> DataFrame:
    """ordinal, density: relatives in the same lineage that share a band, summed over bands. Bucket
    sizes are counted first and joined back, so no bucket is gathered."""
    keys = summaries.select("leaf", "ordinal", F.posexplode(F.array(*(S.band(F.col("sketch"), b) for b in range(bands)))).alias("band", "key")).where("key is not null")
    sizes = keys.groupBy("leaf", "band", "key").agg((F.count("*") - 1).alias("near"))
    near = keys.join(sizes, ["leaf", "band", "key"]).groupBy("ordinal").agg(F.sum("near").alias("density"))
    return summaries.select("ordinal").join(near, "ordinal", "left").select("ordinal", F.coalesce("density", F.lit(0)).alias("density"))


def median_words(rows: DataFrame) -> DataFrame:
    """leaf, median: the upper median of words, off the counts of values."""
    steps = rows.groupBy("leaf", "words").agg(F.count("*").alias("c"))
    own = Window.partitionBy("leaf")
    run = steps.withColumn("upto", F.sum("c").over(own.orderBy("words"))).withColumn("n", F.sum("c").over(own))
    return run.where("upto > n div 2").groupBy("leaf").agg(F.min("words").alias("median"))


def preference(policy: Policy) -> list[Column]:
    return [policy.demoted().cast("int"), F.col("ambiguous"), F.abs(F.col("words") - F.col("median")), F.col("ordinal")]


def eligible(summaries: DataFrame, found: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(rows that a selector may keep, rows restored): hard rejects go, exact copies collapse, and a
    lineage that would be empty gets its best rejects back, copies included. The first holds both."""
    caps = group_caps(found, policy).where("not deliberate").select("leaf", "g", "cap", "class")
    rows = summaries.join(caps, "leaf")
    good = dedup_exact(rows.where(~policy.rejects()))
    empty = caps.select("leaf").join(good.select("leaf").distinct(), "leaf", "left_anti")
    lost = rows.join(empty, "leaf", "left_semi")
    ranked = lost.join(median_words(lost), "leaf").withColumn("place", F.row_number().over(Window.partitionBy("leaf").orderBy(*preference(policy)))).where("place <= cap").drop("place", "median")
    return good.unionByName(ranked), ranked


def _pool(summaries: DataFrame, found: DataFrame, policy: Policy) -> DataFrame:
    """What a selector may keep, written once, as it is read several times."""
    return materialise(eligible(summaries, found, policy)[0], "eligible")


def select_first(summaries: DataFrame, found: DataFrame, policy: Policy) -> DataFrame:
    """Kept rows: the ``cap`` preferred ones of each lineage."""
    rows = _pool(summaries, found, policy)
    place = F.row_number().over(Window.partitionBy("leaf").orderBy(*preference(policy)))
    return rows.join(median_words(rows), "leaf").withColumn("place", place).where("place <= cap").drop("place", "median")


def drop_counts(summaries: DataFrame, found: DataFrame, policy: Policy, kept: DataFrame) -> DataFrame:
    """One row of counters of what a selection dropped, restored rows not counted as rejected."""
    caps = group_caps(found, policy).select("leaf", "deliberate", "class")
    rows = summaries.join(caps, "leaf")
    on = rows.where("not deliberate")
    _, back = eligible(summaries, found, policy)
    reasons = lambda df, tag: df.agg(F.count_if(policy.low_complexity()).alias(f"{tag}low"), F.count_if(policy.ambiguous()).alias(f"{tag}amb"), F.count_if(policy.oversize()).alias(f"{tag}over"), F.count("*").alias(f"{tag}n"))
    good = on.where(~policy.rejects())
    alone = dedup_exact(good)
    totals = reasons(on, "a_").crossJoin(reasons(back, "r_")).crossJoin(rows.agg(F.count_if("deliberate").alias("deliberate")))  # one row each
    totals = totals.crossJoin(good.agg(F.count("*").alias("good"))).crossJoin(alone.agg(F.count("*").alias("alone")))
    pool = alone.groupBy("leaf", "class").agg(F.count("*").alias("n")).unionByName(back.groupBy("leaf", "class").agg(F.count("*").alias("n")))
    left = pool.join(kept.groupBy("leaf").agg(F.count("*").alias("k")), "leaf", "left").withColumn("cut", F.col("n") - F.coalesce("k", F.lit(0)))
    cuts = left.agg(F.coalesce(F.sum(F.when(F.col("class").isNotNull(), F.col("cut"))), F.lit(0)).alias("over_shallow_cap"), F.coalesce(F.sum(F.when(F.col("class").isNull(), F.col("cut"))), F.lit(0)).alias("over_cap"))
    return totals.crossJoin(cuts).select(
        "deliberate", (F.col("a_low") - F.col("r_low")).alias("low_complexity"), (F.col("a_amb") - F.col("r_amb")).alias("ambiguous"), (F.col("a_over") - F.col("r_over")).alias("oversize"),
        (F.col("good") - F.col("alone")).alias("duplicates"), F.col("r_n").alias("restored"), "over_shallow_cap", "over_cap",
    )


def invariants(found: DataFrame, policy: Policy, kept: DataFrame) -> DataFrame:
    """groups_missing, names_missing: lineages and named nodes that a selection lost (but on purpose)."""
    caps = group_caps(found, policy)
    lost = caps.where("not deliberate").join(kept.select("leaf").distinct(), "leaf", "left_anti")
    paths = lambda df: df.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(GENUS + 1)), lambda r: F.array_join(F.slice("lineage", F.lit(1), r), "\x1f"))).alias("rank", "path"), "lineage").where(F.col("lineage")[F.col("rank")] != "").select("rank", "path").distinct()
    gone = paths(caps.where("not deliberate")).join(paths(kept), ["rank", "path"], "left_anti")
    return lost.agg(F.count("*").alias("groups_missing")).crossJoin(gone.agg(F.count("*").alias("names_missing")))


def hazard_after(kept: DataFrame, policy: Policy) -> DataFrame:
    return kept.agg(F.count("*").alias("records"), F.count_if(F.col("words") / F.lit(float(S.WORD_SPACE)) >= 0.05).alias("saturating"), F.count_if("organellar").alias("organellar"), F.count_if(policy.demoted()).alias("over_demote"))


def missing(found: DataFrame, policy: Policy, kept: DataFrame, most: int = 32) -> list[str]:
    """The first lineages, but those left out on purpose, that a selection lost."""
    caps = group_caps(found, policy).where("not deliberate")
    lost = caps.join(kept.select("leaf").distinct(), "leaf", "left_anti").orderBy("g").limit(most)
    return [r.name for r in lost.select(F.array_join("lineage", ",").alias("name")).collect()]


def plan(survey_: DataFrame, found: DataFrame, policy: Policy) -> dict:
    """All parts of the plan, for a report: each is an aggregate of a bounded number of rows."""
    one = lambda df: (df.first() or {}) and df.first().asDict()
    tops: dict[str, list] = {}
    for r in occupancy_domains(survey_).orderBy("class", "place").collect():
        tops.setdefault(r["class"], []).append([r.domain, r.records])
    classes = {r["class"]: r for r in occupancy_classes(survey_).collect()}
    shallow = shallow_classes(found).where("class is not null").groupBy("class").agg(F.count("*").alias("lineages"), F.sum("records").alias("records"))
    spread = diversity(survey_, found).agg(F.count("*").alias("pairs"), F.avg("distance").alias("mean_distance"), F.avg((F.col("distance") >= policy.ceiling).cast("int")).alias("at_ceiling"))
    return {
        "totals": one(plan_totals(survey_, policy)) | one(survey_.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bases"))),
        "lineages": found.count(), "lengths": one(percentiles(survey_)), "duplicates": one(duplicate_audit(survey_)),
        "cap_curve": {r.cap: r.records for r in cap_curve(found).orderBy("cap").collect()},
        "occupancy": [{"class": name, "records": classes[name].records, "bases": classes[name].bases, "domains": tops.get(name, [])} for name, _ in CLASSES if name in classes],
        "shallow": {r["class"]: {"lineages": r.lineages, "records": r.records} for r in shallow.collect()},
        "diversity": one(spread), "truncation": one(truncation_artifact(survey_)), "max_length": policy.max_length, "cap": policy.cap,
    }


def share(part: float, whole: float) -> float:
    """In percent; of nothing: 0."""
    return 100.0 * part / whole if whole else 0.0


def render(p: dict) -> str:
    """The plan as text."""
    t, n = p["totals"], p["totals"]["records"]
    out = [f"records {n:,}, bases {t['bases']:,}, lineages {p['lineages']:,}"]
    if p["lengths"] and n:
        out.append("length  " + "  ".join(f"{k} {v:,.1f}" if k == "mean" else f"{k} {v:,}" for k, v in p["lengths"].items()))
    for name in ("organellar", "demoted", "low_complexity", "ambiguous"):
        out.append(f"{name.replace('_', ' ')} {t[name]:,} ({share(t[name], n):.2f}%)")
    out.append(f"duplicates {p['duplicates']['duplicates']:,}, of conflicting lineage {p['duplicates']['conflicting']:,}")
    out += [f"shallow, {k}: {v['records']:,} records in {v['lineages']:,} lineages" for k, v in sorted(p["shallow"].items())]
    out += [f"words {c['class']}: {c['records']:,} records, {c['bases']:,} bases" for c in p["occupancy"]]
    if p["diversity"].get("pairs"):
        out.append(f"diversity: {p['diversity']['pairs']:,} pairs, mean distance {p['diversity']['mean_distance']:.3f}, {100 * p['diversity']['at_ceiling']:.1f}% at the ceiling")
    out.append("cap      records kept")
    out += [f"{'>' if cap == p['cap'] else ' '} {cap:>6,} {kept:>14,} ({share(kept, n):.1f}%)" for cap, kept in p["cap_curve"].items()]
    return "\n".join(out) + "\n"


#: A share that grows by more than this factor is concentrated by the selection.
CONCENTRATED = 1.2


def hazard(p: dict, after: dict | None = None) -> str | None:
    """A warning of references that hold so many words that they match anything; None without any. With
    hazard_after of a selection, also the shares before and after it."""
    t, n = p["totals"], p["totals"]["records"]
    floors = dict(CLASSES)
    notable = sum(c["records"] for c in p["occupancy"] if floors[c["class"]] >= 0.05)
    if not notable:
        return None
    out = [f"warning: {notable:,} references hold 5% or more of all {S.WORD_SPACE:,} words and match any query by chance"]
    for c in p["occupancy"]:
        if floors[c["class"]] >= 0.02:
            out.append(f"  {c['class']:<8} {c['records']:>10,} records, {32 * floors[c['class']]:.1f} of 32 draws by chance; " + ", ".join(f"{d or '-'} ({k:,})" for d, k in c["domains"]))
    if t["organellar"]:
        out.append(f"  organellar or spike-in: {t['organellar']:,} records, {share(t['organellar'], n):.2f}% of records, {share(t['organellar_bases'], t['bases']):.2f}% of bases, mean length {t['organellar_bases'] // t['organellar']:,}")
    if p["truncation"]:
        out.append(f"  {p['truncation']['records']:,} records of exactly {p['truncation']['length']:,} letters: cut off upstream")
    if after:
        shares = [(share(notable, n), share(after["saturating"], after["records"])), (share(t["organellar"], n), share(after["organellar"], after["records"]))]
        out.append(f"  after selection: {after['saturating']:,} of {after['records']:,} ({shares[0][1]:.3f}%, before {shares[0][0]:.3f}%), organellar {after['organellar']:,} ({shares[1][1]:.3f}%, before {shares[1][0]:.3f}%)")
        if any(now > CONCENTRATED * before for before, now in shares):
            out.append("  note: the selection raised their share: each sits in a lineage of its own, which a cap never trims")
    out.append("  kept: no maximal length is set" if p["max_length"] is None else f"  records over {p['max_length']:,} letters are dropped")
    return "\n".join(out) + "\n"


# -- selectors that pick one record after another --------------------------------------------


def _over_cap(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaf, ordinal of lineages within their cap, rows of the others)."""
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("__n"))
    sized = rows.join(sizes, "leaf")
    return sized.where("__n <= cap").select("leaf", "ordinal"), sized.where("__n > cap").drop("__n")


def _greedy(rows: DataFrame, policy: Policy, pick) -> DataFrame:
    """Applies pick(pdf) -> kept positions to each lineage. A lineage's sketches (33 numbers a record)
    are held by one task; that is the selectors' nature, as each choice depends on all before it."""
    ready = rows.join(median_words(rows), "leaf").join(lsh_density(rows), "ordinal").select("leaf", "g", "cap", "ordinal", "ambiguous", "words", "median", "density", "sketch", policy.demoted().alias("demoted"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal", ignore_index=True)
        return pdf.loc[pick(pdf), ["leaf", "ordinal"]]

    return ready.groupBy("leaf").applyInPandas(run, "leaf string, ordinal long")


def _preferred(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(pdf["demoted"].astype(int), pdf["ambiguous"], (pdf["words"] - pdf["median"]).abs(), pdf["ordinal"], strict=True))


_NONE = 1 << 17  # no hash is as large


def padded(sketches: list) -> np.ndarray:
    """Sketches as rows of SKETCH numbers."""
    out = np.full((len(sketches), S.SKETCH), _NONE, np.int64)
    for i, s in enumerate(sketches):
        out[i, : len(s)] = s
    return out


def alike(one: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Similarity (see sequences.jaccard) of a padded sketch to each of others, in single precision."""
    both = np.sort(np.concatenate([np.broadcast_to(one, rows.shape), rows], axis=1), axis=1)
    valid = both < _NONE
    first = valid & np.concatenate([np.ones((len(rows), 1), bool), both[:, 1:] != both[:, :-1]], axis=1)
    twice = np.concatenate([both[:, 1:] == both[:, :-1], np.zeros((len(rows), 1), bool)], axis=1) & first
    among = first & (np.cumsum(first, axis=1) <= S.SKETCH)
    return (twice & among).sum(axis=1).astype(np.float32) / np.maximum(1, among.sum(axis=1)).astype(np.float32)


def select_maxmin(summaries: DataFrame, found: DataFrame, policy: Policy) -> DataFrame:
    """leaf, ordinal: greedy farthest points of lineages over their cap, seeded by the densest."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        cap, n = int(pdf["cap"][0]), len(pdf)
        liked = np.empty(n, np.int64)  # the place in the order of preference
        liked[sorted(range(n), key=_preferred(pdf).__getitem__)] = np.arange(n)
        sound, density, sketches = (~pdf["demoted"]).to_numpy(int), pdf["density"].to_numpy(), padded(pdf["sketch"].tolist())
        far, left, chosen = np.full(n, np.inf, np.float32), np.ones(n, bool), []
        worth = np.zeros(n, np.float32)
        while True:
            now = int(np.lexsort((-liked, density, worth, sound, left))[-1])
            chosen.append(now)
            left[now] = False
            if len(chosen) >= cap or not left.any():
                return sorted(chosen)
            far = np.minimum(far, np.float32(1) - alike(sketches[now], sketches))
            worth = np.minimum(far, np.float32(policy.ceiling))

    within, over = _over_cap(_pool(summaries, found, policy))
    return within.unionByName(_greedy(over, policy, pick))


def select_cover(summaries: DataFrame, found: DataFrame, policy: Policy) -> DataFrame:
    """leaf, ordinal: one record for each neighbourhood of shared bands, densest first, up to the cap."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        cap, like = int(pdf["cap"][0]), _preferred(pdf)
        order = sorted(range(len(pdf)), key=lambda i: (bool(pdf["demoted"][i]), -pdf["density"][i], like[i]))
        claimed: list[set] = [set() for _ in range(policy.cover_bands)]
        kept: list[int] = []
        for i in order:
            s = list(pdf["sketch"][i])
            keys = [tuple(s[S.BAND * b : S.BAND * (b + 1)]) if len(s) >= S.BAND * (b + 1) else None for b in range(policy.cover_bands)]
            if keys[0] is not None and any(k is not None and k in c for k, c in zip(keys, claimed, strict=True)):
                continue
            for k, c in zip(keys, claimed, strict=True):
                if k is not None:
                    c.add(k)
            kept.append(i)
            if len(kept) >= cap:
                break
        return sorted(kept)

    return _greedy(_pool(summaries, found, policy), policy, pick)


def select_random(summaries: DataFrame, found: DataFrame, policy: Policy, seed: int = 1, domain: bytes = b"cladeforge/curate/group\0") -> DataFrame:
    """leaf, ordinal: a seeded shuffle of lineages over their cap, cut at the cap."""
    digest = blake3(repr((policy, "random", seed)).encode())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.sort(pdf["ordinal"].to_numpy())
        stream = SplitMix(np.frombuffer(blake3(domain + digest + int(pdf["g"].iloc[0]).to_bytes(4, "little"))[:8], "<u8"))
        for i in range(len(order) - 1, 0, -1):
            j = int(stream.bounded(i + 1)[0])
            order[i], order[j] = order[j], order[i]
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[0], "ordinal": order[: int(pdf["cap"].iloc[0])]})

    within, over = _over_cap(_pool(summaries, found, policy))
    drawn = over.select("leaf", "g", "cap", "ordinal").groupBy("leaf").applyInPandas(run, "leaf string, ordinal long")  # ordinals only
    return within.unionByName(drawn)


def emit(reads: DataFrame, kept: DataFrame) -> DataFrame:
    """The input's rows of the kept ordinals, raw, for writing in order."""
    return reads.join(kept.select("ordinal"), "ordinal", "left_semi")
