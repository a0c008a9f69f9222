"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint of 64 bits is taken from word shingles. Two fingerprints link at ``radius``
(3) or fewer differing bits, and a component is what links reach.

How links are found without comparing all pairs:

1. Equal fingerprints are one node (grouped, with the smallest id), so copies cost nothing.
2. *Partners.* Half the radius, rounded down, is 1. If two fingerprints differ in 1 to 3 bits,
   then of ``blocks`` bit blocks one holds a difference; without that block at most 2 bits
   differ, and the balls of radius 1 around both meet. Every fingerprint emits, for each block
   left out, all variants of the rest within 1 bit; a variant that two different fingerprints
   emit marks both as having a possible partner. Members of a variant are counted, never gathered.
   The number of blocks follows from the number of fingerprints (blocks_for).
3. *Links.* Every fingerprint with a possible partner emits its whole ball of radius 1 (65
   variants). Those that meet there differ in at most 2 bits. For exactly 3 differing bits one
   of the two has an even and one an odd number of set bits; of the three bits two lie in the
   same half word. So fingerprints with an even count also emit all variants with two bits
   flipped inside a half word, as *outer* members. Whoever meets in a variant is at most 3
   from each *inner* member of it (1 + 2), so all members are linked to one inner member: a
   star, not all pairs. A variant has at most 65 inner and 992 outer members, so groups are
   bounded by the method, not by the data. Each link is verified by its bit count.
4. *Components* by contraction: every node takes the smallest neighbour in a mixed order
   (so that chains are short), edges move to the new names, and so on until none is left.
   All steps are joins and grouped minima; nothing is collected.

Edge cases: a null text is an empty one; a text of any length is read whole; a text without words has fingerprint zero and links
like any other; fewer words than a shingle give one shingle of all words. Repeated doc_ids give
one row each; a component's id is its smallest id that isn't null. An empty table gives an empty
result. Other columns are ignored. What keep_one does with null ids is said at survivors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.llm.common import materialise, slices, texts

BITS = 64
SEED = 42


def shingle_hashes(text: str, shingle: int = 3) -> np.ndarray:
    """XXH64 of each shingle of the text, lower-cased in A-Z, words split at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.array([hashed(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: str, shingle: int = 3, block: int = 1 << 14) -> int:
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), block):
        counts += np.unpackbits(h[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def digest() -> F.Column:
    """The text of a row as a key; with doc_id it names a row whose id is null or used again."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 3, digests: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); with ``digests`` also the digest of the text."""
    keys = ["doc_id", "digest"] if digests else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(b.column, keys), pa.array(fp)], [*keys, "fp"])

    more = [digest().alias("digest")] if digests else []
    return texts(docs, *more).mapInArrow(run, f"doc_id long,{' digest string,' if digests else ''} fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _longs(values) -> F.Column:
    """A constant array<long>, kept as text so that the plan stays small."""
    return F.from_json(F.lit("[" + ",".join(str(_signed(v)) for v in values) + "]"), "array<bigint>")


def block_masks(blocks: int) -> list[int]:
    """For each block of bits, the mask of all other bits."""
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << 64) - 1) ^ sum(1 << b for b in range(a, z)) for a, z in zip(cut, cut[1:], strict=False)]


def blocks_for(nodes: int, chance: float = 0.1) -> int:
    """The fewest blocks (3 at least) with which a fingerprint of so many random ones has at most
    ``chance`` partners by accident. Any number of blocks finds all pairs; with few, at some size
    every fingerprint would meet another and step 2 would hold nothing back."""
    for blocks in range(3, BITS // 2):
        bits = BITS - BITS // blocks
        near = 1 + bits + bits * (bits - 1) / 2  # two balls of radius 1 meet within 2 bits
        if blocks * nodes * near / 2.0**bits <= chance:
            return blocks
    return BITS // 2


def with_partners(nodes: DataFrame, blocks: int) -> DataFrame:
    """The fingerprints of nodes(fp) that may have another within 3 bits: no false negatives.

    Variants of different blocks share one column; should two of them be equal by chance, that
    only adds a candidate.
    """
    emitted = None
    for mask in block_masks(blocks):
        flips = [0, *(1 << b for b in range(BITS) if mask >> b & 1)]
        part = nodes.select("fp", F.explode(_longs(flips)).alias("flip")).select(
            "fp", F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.col("flip")).alias("variant")
        )
        emitted = part if emitted is None else emitted.unionAll(part)
    members = F.count(F.lit(1)).over(Window.partitionBy("variant"))
    return emitted.withColumn("members", members).where("members > 1").select("fp").distinct()


def links(candidates: DataFrame) -> DataFrame:
    """Links (a, b) at 1 to 3 bits that connect whatever all such links connect."""
    ball = [0, *(1 << b for b in range(BITS))]
    half = BITS // 2
    outer = [1 << (o + i) | 1 << (o + j) for o in (0, half) for i in range(half) for j in range(i)]
    even = F.bit_count("fp") % 2 == 0
    emitted = candidates.select("fp", F.explode(F.when(even, _longs(ball + outer)).otherwise(_longs(ball))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    inner = F.bit_count(F.col("fp").bitwiseXOR(F.col("variant"))) <= 1
    centre = F.min(F.when(inner, F.col("fp"))).over(Window.partitionBy("variant"))
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre")))
    return emitted.withColumn("centre", centre).where("centre <> fp").where(differ <= 3).select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()


def _least(node: str) -> F.Column:
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b): equal roots are what edges connect."""
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_least("b")).alias("m"))
        parent = materialise(least.select(F.col("a").alias("node"), F.least(_least("a"), "m")["node"].alias("parent")), "parents")
        if labels is None:
            labels = parent.withColumnRenamed("parent", "root")
        else:
            moved = labels.join(parent.withColumnsRenamed({"node": "root", "parent": "next"}), "root", "left")
            labels = materialise(moved.select("node", F.coalesce("next", "root").alias("root")), "labels")
        for side in ("a", "b"):
            edges = edges.join(parent.withColumnRenamed("node", side), side).drop(side).withColumnRenamed("parent", side)
        edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def ball_links(prints: DataFrame, blocks: int | None = None) -> DataFrame:
    """Links (a, b) of different fingerprints prints(fp): steps 2 and 3."""
    blocks = blocks or blocks_for(prints.count())
    return materialise(links(materialise(with_partners(prints, blocks), "candidates")), "links")


def _roots(prints: DataFrame, blocks: int | None) -> DataFrame:
    """fp, first (its smallest doc_id), root (equal for what links reach) of each fingerprint."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(ball_links(nodes.select("fp"), blocks))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return materialise(named, "roots")


def near_duplicates(docs: DataFrame, shingle: int = 3, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id that links reach)."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    named = _roots(prints, blocks)
    ids = materialise(named.groupBy("root").agg(F.min("first").alias("component_id")), "ids")
    by_print = materialise(named.join(ids, "root").select("fp", "component_id"), "components")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Rows that are broadcast at most (some 100 bytes each); more are joined through a shuffle.
BROADCAST_ROWS = 200_000


def few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, marked for a broadcast if there are at most so many."""
    return F.broadcast(rows) if rows.count() <= most else rows


def survivors(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of docs, the first row of each component of rows(doc_id, digest, root), with all columns.

    First is the smallest doc_id (null ids last), then the smallest digest of the text. The row is
    found again by both, so that a null or reused id costs no other text. Rows equal in both: one.
    Texts are not moved while the rows to drop are few: those are taken out by an anti-join.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    shared = rows.groupBy("root").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = rows.join(shared, "root").groupBy("doc_id", "digest").agg(F.bool_or(key == F.col("first")).alias("stays"), F.count("*").alias("n"))
    named = materialise(named.select(F.col("doc_id").alias("__other_id"), F.col("digest").alias("__other_digest"), "stays", "n"), "shared")
    own = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__digest", digest())
    same = F.col("__id").eqNullSafe(F.col("__other_id")) & (F.col("__digest") == F.col("__other_digest"))
    alone = own.join(few(named.where("not stays or n > 1")), same, "left_anti")
    again = own.join(few(named.where("stays and n > 1")), same, "left_semi").dropDuplicates(["__id", "__digest"])
    return alone.unionByName(again).drop("__id", "__digest")


def keep_one(docs: DataFrame, shingle: int = 3, blocks: int | None = None) -> DataFrame:
    """The first document of each component (see survivors), with all its columns."""
    prints = materialise(fingerprints(docs, shingle, digests=True), "fingerprints")
    rows = prints.join(_roots(prints, blocks).select("fp", "root"), "fp")
    return survivors(docs, rows)
