"""Command line: index, classify, curate, inspect. ``python -m cladeforge COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import time
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge import __version__
from cladeforge.functions import taxonomy
from cladeforge.operators import classify, curate, index, logistic, scoring
from cladeforge.sources import fastx
from cladeforge.sources.shared import fresh_path, materialise

SELECTORS = {"first": curate.select_first, "random": curate.select_random, "maxmin": curate.select_maxmin, "cover": curate.select_cover}


def _read(spark: SparkSession, path: str, references: bool = False) -> DataFrame:
    """ordinal, label, seq of files; ``-`` is standard input, copied to the shared folder first."""
    spark.dataSource.register(fastx.FastxSource)
    if path == "-":
        path = fresh_path(spark, "stdin")
        where, name = fastx.store(path)
        with where.open_output_stream(name) as out:
            shutil.copyfileobj(sys.stdin.buffer, out)
    rows = spark.read.format("fastx").option("references", str(references).lower()).load(path)
    return fastx.numbered(rows, path).select("ordinal", "label", "seq")


def _apart(output: str, *inputs: str) -> None:
    """Refuses an output that is one of the inputs."""
    real = lambda p: p if "://" in p else os.path.realpath(p)
    if any(real(output) == real(x) for i in inputs for x in i.split(",")):
        raise SystemExit(f"output {output} is an input")


def _names(ix: index.Index) -> DataFrame:
    """ref_id, lineage of an index, as names."""
    parts = ix.refs.select("ref_id", F.posexplode("lineage").alias("rank", "node_id")).join(ix.nodes.select("node_id", "name"), "node_id")
    return parts.groupBy("ref_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("lineage"))  # seven entries


def run_index(spark: SparkSession, a: argparse.Namespace) -> None:
    _apart(a.output, a.reference)
    reads = _read(spark, a.reference, True)
    built = index.build(reads)
    index.save(built, a.output)
    odd = index.records(reads).agg(F.sum("unknown")).first()[0]
    if odd:
        print(f"warning: {odd} unknown letters were read as N", file=sys.stderr)


def run_classify(spark: SparkSession, a: argparse.Namespace) -> None:
    _apart(a.output, a.reads, a.db)
    began = time.time()
    ix = index.load(spark, a.db)
    config = classify.Config(**{f.name: getattr(a, f.name) for f in fields(classify.Config) if hasattr(a, f.name)})
    params = None
    if config.scorer == "protax":
        if not a.protax_params:
            raise SystemExit("--scorer protax needs --protax-params")
        with open(a.protax_params, encoding="utf-8") as f:
            params = logistic.parse_params(f.read())
    queries = materialise(index.records(_read(spark, a.reads)).withColumnRenamed("ordinal", "query"), "queries")
    if config.emit_features:
        fastx.write_features(classify.features(queries, ix, config), a.output)
    else:
        won = materialise(classify.winners(queries, ix, config), "winners")
        found = materialise(classify.calls(queries, ix, _names(ix), config, params, won), "calls")
        votes = scoring.tallies(won, _names(ix)) if config.emit_informative else None
        lines = scoring.predictions(queries, found, config.cutoff, informative=votes)
        lines.orderBy("query").select("line").write.text(a.output)
    size = queries.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases")).first()
    took = time.time() - began
    print(f"reads={size.reads} bases={size.bases} wall_s={took:.3f} reads_per_s={size.reads / took:.2f} bases_per_s={size.bases / took:.2f}", file=sys.stderr)
    if a.profile and not config.emit_features:
        held = scoring.tallies(won, _names(ix)).agg(F.count_if(F.col("abstained") > 0).alias("contested")).first()
        weights = classify.weight_table(ix, config)
        heavy = weights.where(F.col("weight") > 1).count() if weights is not None else 0
        print(json.dumps({"classified": found.select("query").distinct().count(), "contested": held.contested, "reverse": won.where("strand = 1").select("query").distinct().count(), "weights": config.weights, "words_informative": heavy}), file=sys.stderr)


def _surveyed(spark: SparkSession, a: argparse.Namespace, reads: DataFrame) -> DataFrame:
    """The survey; of a cache, if it is of the same files, sizes, times and version."""
    if not a.survey_cache:
        return materialise(curate.survey(index.records(reads, sketches=True)), "survey")
    infos = [(f, fastx.store(f)[0].get_file_info(fastx.store(f)[1])) for f in fastx.listed(a.reference)]
    key = json.dumps([curate.SURVEY_VERSION, *([f, i.size, i.mtime_ns] for f, i in infos)])
    where, name = fastx.store(a.survey_cache)
    if where.get_file_info(f"{name}/key").type.name == "NotFound":
        curate.survey(index.records(reads, sketches=True)).write.parquet(f"{a.survey_cache}/survey")
        spark.createDataFrame([(key,)], "key string").write.parquet(f"{a.survey_cache}/key")
    elif spark.read.parquet(f"{a.survey_cache}/key").first().key != key:
        raise SystemExit(f"{a.survey_cache} is of other input or another version: delete it")
    return spark.read.parquet(f"{a.survey_cache}/survey")


def run_curate(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.reference == "-":
        raise SystemExit("curate reads its input twice: give a file")
    if a.output:
        _apart(a.output, a.reference)
    began = time.time()
    reads = _read(spark, a.reference, True)
    covered, orphan, unplaced = a.shallow_cap
    policy = curate.Policy(
        cap=a.cap, demote_length=a.demote_length, max_length=a.max_length, max_ambiguity=a.max_ambiguity, min_words=a.min_words, ceiling=a.ceiling, cover_bands=a.cover_bands,
        shallow_covered=covered, shallow_orphan=orphan, shallow_unplaced=unplaced, shallow_ratio=a.shallow_ratio, drop_shallow=a.drop_shallow, drop_organellar=a.drop_organellar,
    )
    survey = _surveyed(spark, a, reads)
    if a.oversize_list:
        curate.oversize_list(survey, policy).write.csv(a.oversize_list, sep="\t")
    found = materialise(curate.groups(survey), "groups")
    one = lambda df: df.first().asDict()
    plan = curate.plan(survey, found, policy)
    if a.plan:
        print(curate.render(plan), end="")
        print(curate.hazard(plan) or "", end="", file=sys.stderr)
        return
    select = SELECTORS[a.select]
    picked = select(survey, found, policy, a.seed) if a.select == "random" else select(survey, found, policy)
    kept = materialise(survey.join(picked.select("ordinal"), "ordinal", "left_semi"), "kept")
    lost = one(curate.invariants(found, policy, kept))
    if any(lost.values()):
        raise SystemExit(f"the selection lost lineages: {lost}, {curate.missing(found, policy, kept)}")
    after = one(curate.hazard_after(kept, policy))
    fastx.write_fasta(curate.emit(reads, kept), a.output)
    written = index.records(_read(spark, a.output, True)).agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("bases"), F.bit_xor(F.xxhash64("label", "seq")).alias("content")).first().asDict()
    if written["records"] != after["records"]:
        raise SystemExit(f"{written['records']} records written, {after['records']} selected")
    manifest = {
        "version": __version__, "survey_version": curate.SURVEY_VERSION, "policy": asdict(policy), "select": a.select, "seed": a.seed, "input": a.reference, "output": a.output, "written": written,
        "dropped": one(curate.drop_counts(survey, found, policy, kept)), "invariants": lost, "after": after, "plan": plan, "hazard": curate.hazard(plan, after), "wall_s": round(time.time() - began, 3),
    }
    with open(a.report or f"{a.output.rstrip('/')}.curation.json", "w", encoding="utf-8") as f:
        f.write(json.dumps(manifest, indent=2, default=str))
    print(manifest["hazard"] or "", end="", file=sys.stderr)


def run_inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    ix = index.load(spark, a.db)
    census = ix.refs.select(F.posexplode("lineage").alias("rank", "node_id")).join(ix.nodes.select("node_id", "name"), "node_id").groupBy("rank").agg(F.count_if(F.col("name") != "").alias("n"))
    out = {"meta": ix.meta.first().asDict(), "named": {taxonomy.RANKS[r["rank"]]: r.n for r in census.orderBy("rank").collect()}}
    if a.verify:
        out["mismatches"] = {r.part: r.mismatches for r in index.verify(ix).collect()}
    print(json.dumps(out, indent=2))


def _three(text: str) -> tuple[int, ...]:
    values = tuple(int(x) for x in text.split(","))
    if len(values) != 3 or min(values) < 1:
        raise argparse.ArgumentTypeError("three positive numbers: covered,orphan,unplaced")
    return values


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladeforge")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("reference")
    c.add_argument("-o", "--output", required=True)
    c = sub.add_parser("classify")
    c.add_argument("reads")
    c.add_argument("--db", required=True)
    c.add_argument("-o", "--output", required=True)
    d = classify.Config()
    for name in ("seed", "cutoff", "candidates", "risk", "weight_share", "min_informative", "floor"):
        c.add_argument("--" + name.replace("_", "-"), type=type(getattr(d, name)), default=getattr(d, name))
    for name in ("strand", "weights", "support", "scorer", "holdout", "hash"):
        c.add_argument("--" + name, default=getattr(d, name))
    for name in ("exact", "emit-informative", "emit-features", "profile"):
        c.add_argument("--" + name, action="store_true")
    c.add_argument("--protax-params")
    c = sub.add_parser("curate")
    c.add_argument("reference")
    c.add_argument("-o", "--output")
    c.add_argument("--plan", action="store_true")
    c.add_argument("--report")
    c.add_argument("--select", choices=SELECTORS, default="random")
    c.add_argument("--seed", type=int, default=1)
    d = curate.Policy()
    for name in ("cap", "demote_length", "max_ambiguity", "min_words", "ceiling", "cover_bands", "shallow_ratio"):
        c.add_argument("--" + name.replace("_", "-"), type=type(getattr(d, name)), default=getattr(d, name))
    c.add_argument("--max-length", type=int)
    c.add_argument("--shallow-cap", type=_three, default=(d.shallow_covered, d.shallow_orphan, d.shallow_unplaced))
    c.add_argument("--oversize-list")
    c.add_argument("--survey-cache")
    c.add_argument("--drop-shallow", action="store_true")
    c.add_argument("--drop-organellar", action="store_true")
    c = sub.add_parser("inspect")
    c.add_argument("db")
    c.add_argument("--verify", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "curate" and a.plan == bool(a.output):
        raise SystemExit("curate needs either --plan or --output")
    spark = spark or SparkSession.builder.appName("cladeforge").getOrCreate()
    {"index": run_index, "classify": run_classify, "curate": run_curate, "inspect": run_inspect}[a.command](spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
