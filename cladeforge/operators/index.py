"""The reference index: taxonomy nodes, references, the inverted word index and its statistics.

All of it is DataFrames with a fixed schema, written and opened as Parquet (``save`` / ``load``).
Records are rows (ordinal, label, seq); what is built per record stays in the row until words are
exploded into postings, so the only shuffles are the aggregations by word and by node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from cladeforge.functions import sequences as S
from cladeforge.functions import taxonomy as T
from cladeforge.functions import words as W
from cladeforge.sources.shared import materialise

FORMAT_VERSION = 2
#: Leaves whose words a task holds at once (64 KB each); bytes of a set of words as one bit a code.
HELD_LEAVES, SET_BYTES = 512, S.WORD_SPACE // 8


def records(reads: DataFrame, sketches: bool = False) -> DataFrame:
    """reads(ordinal, label, seq) with seq normalised, its unknown bytes, words (codes, ascending) and
    lineage; with ``sketches`` also the sketch of its words.

    The words of whole sequences come from NumPy: linear in the sequence and some ten times faster
    than the same as higher-order functions, which the optimizer may also copy into filters, where
    the normalisation is then repeated for each word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [W.normal(s) for s in part.column("seq").to_pylist()]
                words = [W.codes(s) for s, _ in found]
                columns = [part.column("ordinal"), part.column("label"), pa.array([s.tobytes().decode() for s, _ in found]), pa.array([n for _, n in found], pa.int32()), W.lists(words)]
                yield pa.RecordBatch.from_arrays([*columns, *([W.lists(list(map(W.sketch, words)))] if sketches else [])], names)

    names = ["ordinal", "label", "seq", "unknown", "words", *(["sketch"] if sketches else [])]
    rows = reads.select(F.col("ordinal").cast("long").alias("ordinal"), "label", F.coalesce("seq", F.lit("")).alias("seq"))
    schema = "ordinal long, label string, seq string, unknown int, words array<int>" + (", sketch array<int>" if sketches else "")
    return rows.mapInArrow(run, schema).withColumn("tax", T.parse(F.col("label")))


def worded(rows: DataFrame) -> DataFrame:
    """rows with the words of their sequence in place of it: nothing is joined, so nothing is moved."""
    keep = [c for c in rows.columns if c not in ("seq", "words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), W.lists([W.codes(W.normal(s)[0]) for s in part.column("seq").to_pylist()])], [*keep, "words"])

    return rows.select(*keep, F.coalesce("seq", F.lit("")).alias("seq")).mapInArrow(run, rows.select(*keep).schema.add("words", ArrayType(IntegerType())))


def reverse_strand(rows: DataFrame) -> DataFrame:
    """The rows with the words of the other strand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("words")
            turned = W.reversed_lists(b.column(at))
            yield b.set_column(at, pa.field("words", turned.type), turned)

    return rows.mapInArrow(run, rows.schema)


def prefix(lineage: Column, rank: int) -> Column:
    return F.array_join(F.slice(lineage, 1, rank + 1), "\x1f")


def prefixes(lineage: Column) -> Column:
    """The seven path prefixes of a lineage."""
    return F.array(*(prefix(lineage, r) for r in range(T.LEVELS)))


def nodes(lineages: DataFrame) -> DataFrame:
    """node_id, parent, rank, name, path of lineages(ordinal, lineage).

    Nodes are numbered by first sight: by the smallest ordinal that has the path, then by rank; the
    root is 0. Numbering needs an order over all nodes; there are few of them next to the records,
    as they are grouped before.
    """
    first = lineages.select("ordinal", F.posexplode(prefixes(F.col("lineage"))).alias("rank", "path"), "lineage").groupBy("rank", "path").agg(F.min("ordinal").alias("first"), F.first(F.col("lineage")[F.col("rank")]).alias("name"))
    numbered = first.withColumn("node_id", F.row_number().over(Window.orderBy("first", "rank")))
    up = numbered.select(F.col("node_id").alias("parent"), F.col("path").alias("up"), (F.col("rank") + 1).alias("rank"))
    above = F.when(F.col("rank") > 0, F.expr("substring(path, 1, length(path) - length(name) - 1)"))
    return numbered.withColumn("up", above).join(up, ["rank", "up"], "left").select("node_id", F.coalesce("parent", F.lit(0)).alias("parent"), "rank", "name", "path")


def references(recs: DataFrame, tree: DataFrame) -> DataFrame:
    """ref_id, leaf, lineage (node ids), vocabulary, words, seq of parsed records."""
    parts = recs.select(F.col("ordinal").alias("ref_id"), "seq", "words", F.size("words").alias("vocabulary"), F.posexplode(prefixes(F.col("tax.lineage"))).alias("rank", "path"))
    ids = parts.select("ref_id", "rank", "path").join(tree.select("path", "rank", "node_id"), ["path", "rank"]).groupBy("ref_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("lineage"))  # seven entries
    own = recs.select(F.col("ordinal").alias("ref_id"), "seq", "words", F.size("words").alias("vocabulary"))
    return own.join(ids, "ref_id").withColumn("leaf", F.col("lineage")[T.LEVELS - 1])


def postings(refs: DataFrame) -> DataFrame:
    """word, ref_id: the inverted index."""
    return refs.select(F.explode("words").alias("word"), "ref_id")


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("word").agg(F.count("*").alias("df"))


def taxon_frequency(post: DataFrame, refs: DataFrame) -> DataFrame:
    """word, genera, families: different leaves and different parents of leaves; unnamed ones count."""
    taxa = refs.select("ref_id", "leaf", F.col("lineage")[T.LEVELS - 2].alias("family"))
    # distinct pairs first: the two counts then need no expansion of every posting
    pairs = post.join(taxa, "ref_id").groupBy("word", "leaf").agg(F.first("family").alias("family"))
    return pairs.groupBy("word").agg(F.count("*").alias("genera"), F.count_distinct("family").alias("families"))


def _packed(own: np.ndarray) -> bytes:
    """A set of words, given as a flag a code: a bit a code, or the codes where these are shorter."""
    some = np.flatnonzero(own)
    return some.astype("<u2").tobytes() if 2 * len(some) < SET_BYTES else np.packbits(own).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    """What picks the words of a packed set out of an array over all codes."""
    return np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool) if len(data) == SET_BYTES else np.frombuffer(data, "<u2")


def taxon_counts(refs: DataFrame) -> DataFrame:
    """The same as taxon_frequency from refs(leaf, lineage, words), without moving a row a posting: tasks
    unite the words of each leaf, and what is moved are these sets (8 KB or less) and counts of words."""

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys = list(zip(*held, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int32()), pa.array(map(_packed, held.values()), pa.binary())], ["family", "leaf", "words"])

        for b in batches:
            words = b.column("words")
            ends, flat = words.offsets.to_numpy(), words.values.to_numpy()
            for i, key in enumerate(zip(b.column("family").to_pylist(), b.column("leaf").to_pylist(), strict=True)):
                if key not in held:
                    if len(held) == HELD_LEAVES:
                        yield out()
                        held.clear()
                    held[key] = np.zeros(S.WORD_SPACE, bool)
                held[key][flat[ends[i] : ends[i + 1]]] = True
        yield out()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of family and leaf."""
        genera, families = np.zeros((2, S.WORD_SPACE), np.int64)
        leaf_words, family_words, last = np.zeros(S.WORD_SPACE, bool), np.zeros(S.WORD_SPACE, bool), (None, None)
        for b in batches:
            for *key, data in zip(*(b.column(c).to_pylist() for c in ("family", "leaf", "words")), strict=True):
                if tuple(key) != last:
                    genera += leaf_words
                    leaf_words[:] = False
                if key[0] != last[0]:
                    families += family_words
                    family_words[:] = False
                last, own = tuple(key), _unpacked(data)
                leaf_words[own] = True
                family_words[own] = True
        genera += leaf_words
        families += family_words
        some = np.flatnonzero(genera)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(genera[some]), pa.array(families[some])], ["word", "genera", "families"])

    taxa = refs.select(F.col("lineage")[T.LEVELS - 2].cast("int").alias("family"), F.col("leaf").cast("int").alias("leaf"), "words")
    sets = taxa.mapInArrow(united, "family int, leaf int, words binary").repartition("family").sortWithinPartitions("family", "leaf")
    return sets.mapInArrow(counted, "word int, genera long, families long").groupBy("word").agg(F.sum("genera").alias("genera"), F.sum("families").alias("families"))


def word_stats(refs: DataFrame) -> DataFrame:
    """word, df, genera, families of refs(ref_id, leaf, lineage, words)."""
    return document_frequency(postings(refs)).join(taxon_counts(refs), "word")


def node_stats(tree: DataFrame, refs: DataFrame) -> DataFrame:
    """node_id, references, children (named), genera (rank-6 nodes, named or not) of each subtree."""
    under = refs.select(F.explode("lineage").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("references"))
    under = under.unionByName(refs.agg(F.count("*").alias("references")).select(F.lit(0).alias("node_id"), "references"))
    named = tree.where("name <> ''").groupBy(F.col("parent").alias("node_id")).agg(F.count("*").alias("children"))
    lineages = refs.select("lineage").distinct()
    genera = lineages.select(F.explode("lineage").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("genera"))
    genera = genera.unionByName(lineages.agg(F.count("*").alias("genera")).select(F.lit(0).alias("node_id"), "genera"))
    return under.join(named, "node_id", "left").join(genera, "node_id", "left").select("node_id", "references", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("genera", F.lit(0)).alias("genera"))


def rank_census(recs: DataFrame) -> DataFrame:
    """rank, named: records with a name at the rank."""
    pairs = recs.select(F.posexplode("tax.lineage").alias("rank", "name"))
    return pairs.groupBy("rank").agg(F.count_if(F.col("name") != "").alias("named"))


def word_weights(frequency: DataFrame, share: int = 25, light: int = 1, heavy: int = 4) -> DataFrame:
    """word, weight of frequency(word, n): heavy up to the share-th percentile of the words that occur.

    The percentile is read off the counts of counts, so only as many rows are ordered as there are
    different frequencies.
    """
    if not 1 <= share <= 99:
        raise ValueError("share must be a percentage in 1..99")
    steps = frequency.groupBy("n").agg(F.count("*").alias("words"))
    run = steps.withColumn("upto", F.sum("words").over(Window.orderBy("n"))).withColumn("total", F.sum("words").over(Window.partitionBy()))
    place = F.least(F.expr(f"total * {share} div 100"), F.col("total") - 1)
    cut = run.where(F.col("upto") > place).agg(F.min("n").alias("cut"))
    return frequency.crossJoin(F.broadcast(cut)).select("word", F.when(F.col("n") <= F.col("cut"), heavy).otherwise(light).alias("weight"))  # one row


def locate(lineages: DataFrame, tree: DataFrame) -> DataFrame:
    """query, nodes: the node at each rank of lineages(query, lineage), -1 from the first miss on."""
    parts = lineages.select("query", F.posexplode(prefixes(F.col("lineage"))).alias("rank", "path"))
    found = parts.join(tree.select("rank", "path", "node_id"), ["rank", "path"], "left")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("node_id", F.lit(-1)).alias("n")))), lambda x: x["n"])
    return found.groupBy("query").agg(ids.alias("nodes"))


@dataclass
class Index:
    nodes: DataFrame
    refs: DataFrame
    postings: DataFrame
    word_stats: DataFrame
    node_stats: DataFrame
    meta: DataFrame


def build(reads: DataFrame) -> Index:
    """An index of reads(ordinal, label, seq). A label without a valid lineage is an error."""
    recs = records(reads)
    tax = reads.select(F.col("ordinal").cast("long").alias("ordinal"), T.parse(F.col("label")).alias("tax"))
    bad = tax.where("tax.error is not null").select("ordinal", "tax.error").orderBy("ordinal").head()
    if bad:
        raise ValueError(f"record {bad.ordinal}: {bad.error}")
    tree = nodes(tax.select("ordinal", "tax.lineage"))
    refs = references(recs, tree)
    post = postings(refs)
    stats = word_stats(refs)
    meta = refs.agg(F.lit(FORMAT_VERSION).alias("format"), F.lit(S.K).alias("k"), F.count("*").alias("references"), F.sum(F.length("seq")).alias("bases"), F.bit_xor(F.xxhash64("ref_id", "seq")).alias("content"))
    return Index(tree, refs, post, stats, node_stats(tree, refs), meta)


def save(index: Index, path: str) -> None:
    """Parquet; postings clustered and sorted by word, so a word reads few row groups."""
    for f in fields(Index):
        df = getattr(index, f.name)
        if f.name == "postings":
            df = df.repartitionByRange("word").sortWithinPartitions("word", "ref_id")
        df.write.mode("errorifexists").parquet(f"{path}/{f.name}")


def load(spark: SparkSession, path: str) -> Index:
    index = Index(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(Index)})
    meta = index.meta.first()
    if (meta.format, meta.k) != (FORMAT_VERSION, S.K):
        raise ValueError(f"index format {meta.format}, k {meta.k}: this version reads {FORMAT_VERSION}, {S.K}")
    return index


def digests(post: DataFrame) -> DataFrame:
    """word, df, low, high: how many references, and sums of both halves of a hash of the word and reference."""
    h = F.xxhash64("ref_id", "word")
    return post.groupBy("word").agg(F.count("*").alias("df"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"))


def _differing(stored: DataFrame, right: DataFrame) -> DataFrame:
    """The different rows that are in one of both, or more often."""
    tagged = stored.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(-1)))
    return tagged.groupBy(*stored.columns).agg(F.sum("side").alias("side")).where("side <> 0").drop("side")


def verify(index: Index) -> DataFrame:
    """part, mismatches: rows in which a stored part differs from what the sequences give.

    Postings are many times the sequences, so they aren't moved: words whose postings differ are found by the
    number and a 64-bit digest of these (sums before the shuffle; a difference that leaves both as they are has a chance
    of about 2^-64), and only the postings of these words are compared row by row.
    """
    refs = worded(index.refs)
    post, stored = postings(refs), index.postings.select("word", "ref_id")
    right = materialise(digests(post), "digests")
    odd = materialise(_differing(digests(stored), right).select("word").distinct(), "odd")
    some = lambda rows: rows.join(odd.select(F.col("word").alias("__word")), F.col("word").eqNullSafe(F.col("__word")), "left_semi")
    checks = {
        "postings": (some(stored), some(post)),
        "word_stats": (index.word_stats.select("word", "df", "genera", "families"), right.select("word", "df").join(taxon_counts(refs), "word")),
        "node_stats": (index.node_stats, node_stats(index.nodes, index.refs)),
        "vocabulary": (index.refs.select("ref_id", "vocabulary"), refs.select("ref_id", F.size("words").alias("vocabulary"))),
    }
    out = None
    for name, (found, wanted) in checks.items():
        row = _differing(found, wanted).agg(F.count("*").alias("mismatches")).select(F.lit(name).alias("part"), "mismatches")
        out = row if out is None else out.unionByName(row)
    return out
