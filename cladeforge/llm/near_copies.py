"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

1. Equal sets are one node (so copies cost nothing); the sets are written once.
   *Balls.* The fingerprints of op 3 (simhash) are linked by meet-in-the-middle ball hashing, as there; its
   links, and texts of one fingerprint, are verified by the exact Jaccard, and components of these are found.
   At 0.8 most pairs differ in more bits than a ball can reach, so what follows looks for the rest, between
   the components that the balls have left.
2. *Candidates.* ``BANDS`` keys a node, each of ``ROWS`` min-hashes of the set. Two sets of Jaccard j
   share no key with probability (1 - j^ROWS)^BANDS: 3e-6 at 0.8, less above.
3. *Stars.* Members of a key are compared with its hub, by the exact Jaccard of the sets, and
   components of these links are found: a large family of near copies costs its size, not its square. The
   hub is the member that meets most others over all its keys: of a family it is the text that the others
   were made from, or the one most like it, and so like most of them.
4. *Leftovers.* Members of a key that are in different components still may be alike. Where a key has
   at most FEW of them they are compared pair by pair, at most FEW rows a member.
5. *Rare shingles.* Keys with more are mostly passages that many texts share. Their nodes get other keys:
   two sets of n shingles or more with the Jaccard share one of the n - ceil(0.8 n) + 1 rarest of each, in
   any order that is the same for all (here: the number of these nodes that hold it). Texts that have
   just a frequent passage in common never meet, nor does a copy with a fifth of its shingles changed;
   and two that meet are compared only if what others hold of both could be enough.
   Stars again, then pairs of what is left: texts that share a rare shingle and aren't alike.
6. Components of all links; of each the first row stays (simhash.survivors).

Edge cases: a text without words is the empty set, and all such texts are copies of each other;
fewer words than a shingle give one shingle of all words; words are those of simhash; texts of any length
are read whole; null and repeated ids, clashing columns and empty tables as in simhash.survivors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.llm import simhash
from cladeforge.llm.common import batch_bytes, materialise, text_slices, texts

SHINGLE = 5
BANDS, ROWS = 24, 4
#: Members of a key, in different components, that are compared pair by pair.
FEW = 8
#: Jaccard at least NUM / DEN, compared in whole numbers.
NUM, DEN = 4, 5
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_MUL = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """The different shingles, ascending."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def band_keys(some: np.ndarray, block: int = 1 << 12) -> list[int]:
    """A signed long for each band; none for the empty set."""
    if not len(some):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(some), block):
        least = np.minimum(least, ((some[None, at : at + block] ^ _XOR) * _MUL).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [simhash._signed(xxhash.xxh64_intdigest(r.tobytes(), k)) for k, r in enumerate(rows)]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest, fp (simhash's), node (hash of the set), n (its size), keys, shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1 << 19):
            each = b.column("text").to_pylist()
            prints = pa.array(np.array([simhash.fingerprint(t) for t in each], np.uint64).view(np.int64))
            sets = [shingle_set(t) for t in each]
            node = [simhash._signed(xxhash.xxh3_64_intdigest(s.tobytes())) for s in sets]
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), prints, pa.array(node, pa.int64()), pa.array(sizes), keys, lists], ["doc_id", "digest", "fp", "node", "n", "keys", "shingles"])

    return texts(docs, simhash.digest().alias("digest")).mapInArrow(run, "doc_id long, digest string, fp long, node long, n long, keys array<long>, shingles array<long>")


def verified(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Of pairs(a, b, ...) those whose sets have the Jaccard."""
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sketched.select("node", "shingles").join(simhash.few(materialise(wanted, "wanted")), "node", "left_semi")
    sets = materialise(sets.groupBy("node").agg(F.first("shingles").alias("s")), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where((NUM + DEN) * shared >= NUM * (F.size("x") + F.size("y"))).select(pairs.columns)


def ball_pairs(sketched: DataFrame) -> DataFrame:
    """a, b, part_a, part_b: nodes whose fingerprints simhash links, and nodes of one fingerprint with its first."""
    owned = materialise(sketched.select("fp", "node").distinct(), "owned")
    prints = materialise(owned.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    linked = simhash.ball_links(prints.select("fp"))
    ends = [prints.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_node")) for side in "ab"]
    near = linked.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("x"), F.col("b_node").alias("y"))
    equal = owned.join(prints, "fp").select(F.col("node").alias("x"), F.col("first").alias("y"))
    pairs = near.unionAll(equal).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.select("a", "b", F.col("a").alias("part_a"), F.col("b").alias("part_b"))


def _sizes_allow(n_a: str, n_b: str, c_a: str, c_b: str) -> F.Column:
    """Whether sets of n shingles, c of which others may hold, can have the Jaccard."""
    return (NUM + DEN) * F.least(c_a, c_b) >= NUM * (F.col(n_a) + F.col(n_b))


def _own():
    return Window.partitionBy("key")


def _shared(keyed: DataFrame) -> DataFrame:
    """keyed(key, node, n, c) of the keys that different nodes have, with the key's ``hub``."""
    met = keyed.withColumn("members", F.count("*").over(_own())).where("members > 1")
    weights = met.groupBy("node").agg(F.sum("members").alias("weight"))
    hub = F.max(F.struct("weight", "node", "n", "c")).over(_own())
    return materialise(met.join(weights, "node").withColumn("hub", hub).select("key", "node", "n", "c", "hub"), "keys")


def _named(rows: DataFrame, parts: DataFrame | None, node: str = "node", part: str = "part") -> DataFrame:
    """rows with the part of a node: a node that parts(node, part) doesn't hold is its own."""
    if parts is None:
        return rows.withColumn(part, F.col(node))
    found = parts.select(F.col("node").alias(node), F.col("part").alias("__part"))
    return rows.join(found, node, "left").withColumn(part, F.coalesce("__part", node)).drop("__part")


def _stars(shared: DataFrame, parts: DataFrame | None) -> DataFrame:
    """a, b, part_a, part_b: every member of a key with its hub, where these are in different parts."""
    each = shared.where("node <> hub.node").where(_sizes_allow("n", "hub.n", "c", "hub.c"))
    each = each.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct()
    named = _named(_named(each, parts, "a", "part_a"), parts, "b", "part_b")
    return materialise(named.where("part_a <> part_b"), "stars")


def _mixed(shared: DataFrame, parts: DataFrame | None) -> DataFrame:
    """key, node, n, c, part, members of the keys with members in different parts."""
    named = _named(shared.select("key", "node", "n", "c"), parts)
    mixed = named.withColumn("mixed", F.min("part").over(_own()) < F.max("part").over(_own())).withColumn("members", F.count("*").over(_own()))
    return materialise(mixed.where("mixed").drop("mixed"), "mixed")


def _pairs(mixed: DataFrame) -> DataFrame:
    """a, b, part_a, part_b: members of a key in different parts."""
    x, y = (mixed.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "c", "part"))) for s in "ab")
    pairs = x.join(y, "key").where("node_a < node_b and part_a <> part_b").where(_sizes_allow("n_a", "n_b", "c_a", "c_b"))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "part_a", "part_b").distinct()


def _merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, part after links(part_a, part_b)."""
    joined = simhash.components(materialise(links.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct(), "links"))
    joined = joined.select(F.col("node").alias("part"), F.col("root").alias("next"))
    known = joined.select(F.col("part").alias("node"), "part")
    every = (known if parts is None else parts.unionByName(known.join(parts, "node", "left_anti"))).join(joined, "part", "left")
    return materialise(every.select("node", F.coalesce("next", "part").alias("part")), "parts")


def rare_keys(sets: DataFrame) -> DataFrame:
    """key, node, n, c of sets(node, shingles): the rarest shingles of each set, as many as leave no room for
    a set alike that has none of them. Those that no other set has take their place but are no keys; of the n, c
    are held by others and no rarer than the key: all that two sets can share if it is the first they share."""
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    held = each.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    met = each.join(held, "key")
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy("held", "key"))
    met = met.withColumn("c", F.count("*").over(own))
    room = F.col("n") - F.expr(f"({NUM} * n + {DEN} - 1) div {DEN}") + 1
    return met.withColumn("place", place + F.col("n") - F.col("c")).where(F.col("place") <= room).select("key", "node", "n", (F.col("n") - F.col("place") + 1).alias("c"))


def roots(sketched: DataFrame) -> DataFrame:
    """node, root of the nodes that have a near copy; roots are equal where links connect."""
    nodes = sketched.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    shared = _shared(nodes.select("node", "n", F.col("n").alias("c"), F.explode("keys").alias("key")))
    parts = _merged(None, verified(ball_pairs(sketched), sketched))
    tried = _stars(shared, parts)
    parts = _merged(parts, verified(tried, sketched))
    mixed = _mixed(shared, parts)
    pairs = _pairs(mixed.where(F.col("members") <= FEW)).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    parts = _merged(parts, verified(pairs, sketched))
    many = materialise(mixed.where(F.col("members") > FEW).select("node").distinct(), "many")
    sets = sketched.select("node", "shingles").join(simhash.few(many), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    rare = _shared(rare_keys(materialise(sets, "sets")))
    parts = _merged(parts, verified(_stars(rare, parts), sketched))
    parts = _merged(parts, verified(_pairs(_mixed(rare, parts)), sketched))
    return parts.withColumnRenamed("part", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of each component (see simhash.survivors), with all its columns."""
    with batch_bytes(docs.sparkSession, 1 << 22):
        sketched = materialise(sketches(docs), "sketches")
    found = materialise(roots(sketched), "roots")
    rows = sketched.select("doc_id", "digest", "node").join(simhash.few(found), "node", "left")
    return simhash.survivors(docs, rows.select("doc_id", "digest", F.coalesce("root", "node").alias("root")))
