"""Exact top-k by inner product: the three-phase uniform threshold algorithm.

Vectors are taken as integers floor(256 * x). Their dimensions, ordered by energy (the sum of squares
over all rows, largest first), are cut into ``LISTS`` lists: a vector's score for a query is the sum of its
partial scores, one in each list. What lists not yet read can add is at most the product of both
vectors' lengths there (Cauchy-Schwarz).

1. *Gather.* The first list gives, for every query and block of vectors, the GATHERED highest partial
   scores; only those vectors are scored exactly. The k-th highest exact score is tau.
2. *Cutoff.* k vectors have tau at least, so a vector whose bound is below tau is not among the k best.
   This safe cutoff is sent back to all blocks.
3. *Resolve.* The first list is read again and what its bound leaves above the cutoff goes on to the second
   list, and so on, each list for the vectors only that the ones before left; those that are left after
   the last have their exact score. The k best of the block, ties to the smaller id, are merged with
   those of the other blocks.

How much the cutoff saves depends on the vectors: much where a few dimensions hold most energy, little where
energy is even (see the README for measured shares).

Physically the vectors are packed, in the narrowest integers that hold all components, into blocks of
about as many rows as there are queries (BLOCK_ROWS at least, BLOCK_BYTES at most) and queries into blocks of
at most QUERY_ROWS; each block of vectors meets each block of queries by an equi-join on the block's
number, so what queries move is about what the table moves. A pair of blocks is a few matrix products of
STEP_ROWS by CHUNK rows. Cutoffs are joined to their query block before it is copied to the blocks of vectors.
Memory is that of a few pairs of blocks. The joins are merge joins by hint: Spark takes a query block's size from its
compressed file and doesn't count the copies, so it would broadcast them, through the driver, far beyond its threshold.
Nothing is broadcast or gathered on the driver but the number of rows, their range and the energy of the dimensions.

Edge cases: rows with null id, null vector, null or non-finite components take no part. Vectors of
another length are read as if zeros followed. Repeated rows are candidates each; a query given twice
is answered once for each of its rows. Fewer than k candidates: all of them. An empty table, or one
without queries, gives no rows. Other columns are ignored. Components beyond 64 bits are taken as the
largest or smallest long. Sums are exact: in 64-bit integers, modulo 2^64 where they are large, so every
score that fits a long is right; with such components nothing is cut off, as bounds could not be trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.llm.common import materialise, slices

K, EVERY, LISTS, GATHERED = 5, 50, 4, 20
BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES, STEP_ROWS, CHUNK = 8_192, 1 << 16, 1 << 24, 8_192, 64
SCALE = 256
_LOW = np.iinfo(np.int64).min + 1  # so that it can be negated


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<long>) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("v"))


def blocks(rows: DataFrame, count: int, name: str, wide: int, kind: np.dtype) -> DataFrame:
    """rows(vec_id, v) dealt by a hash of id and vector into ``count`` blocks, each packed as
    ids (binary), v (binary of ``kind``, wide columns), energy (of each column)."""
    fit = max(1, BLOCK_BYTES // (8 * max(1, wide)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in slices(batches, fit):
            column = b.column("v")
            ends = column.offsets.to_numpy().astype(np.int64)
            m = np.zeros((b.num_rows, wide), kind)
            m[np.arange(wide)[None, :] < np.diff(ends)[:, None]] = column.values.to_numpy()[ends[0] : ends[-1]]
            held.append((b.column("k").to_numpy(), b.column("vec_id").to_numpy(), m))
        for k in np.unique(np.concatenate([np.empty(0, np.int32), *(h[0] for h in held)])):
            ids = np.concatenate([i[own == k] for own, i, _ in held])
            order = np.argsort(ids, kind="stable")
            m = np.concatenate([m[own == k] for own, _, m in held])[order]
            energy = np.zeros(wide)
            for at in range(0, len(m), fit):
                energy += (m[at : at + fit].astype(np.float64) ** 2).sum(axis=0)
            yield pa.RecordBatch.from_pydict({name: pa.array([k], pa.int32()), "ids": pa.array([ids[order].astype(np.int64).tobytes()]), "v": pa.array([m.tobytes()]), "energy": pa.array([energy.tolist()], pa.list_(pa.float64()))})

    number = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(count)).cast("int")
    return rows.select(number.alias("k"), "vec_id", "v").repartition(count, "k").mapInArrow(run, f"{name} int, ids binary, v binary, energy array<double>")


def narrowest(low: int | None, high: int | None) -> np.dtype:
    """The smallest of the kinds of integer that hold both."""
    return next(np.dtype(kind) for kind in (np.int16, np.int32, np.int64) if (low or 0) >= np.iinfo(kind).min and (high or 0) <= np.iinfo(kind).max)


def largest(m: np.ndarray) -> float:
    return float(max(m.max(initial=0), -float(m.min(initial=0))))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in int64; in float64 (fast, exact) while no sum can reach 2^53."""
    if largest(a) * largest(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def cuts(width: int, lists: int = LISTS) -> list[slice]:
    at = [width * i // lists for i in range(lists + 1)]
    return [slice(x, y) for x, y in zip(at, at[1:], strict=False) if y > x] or [slice(0, 0)]


def rests(m: np.ndarray, lists: list[slice]) -> list[np.ndarray]:
    """The rows' length in the dimensions behind each list."""
    squares = m.astype(np.float64) ** 2
    return [np.sqrt(squares[:, c.stop :].sum(axis=1)) for c in lists]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest in each row, ties to the lower index; -1 where the mark is _LOW."""
    n = scores.shape[1]
    k = min(k, n)
    if not k:
        return np.empty((len(scores), 0), np.int64)
    least = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
    out = np.empty((len(scores), k), np.int64)
    for q, s in enumerate(scores):
        some = np.flatnonzero(s >= least[q])
        out[q] = some[np.lexsort((some, -s[some]))[:k]]
    return np.where(np.take_along_axis(scores, out, axis=1) == _LOW, -1, out)


def gather(q: np.ndarray, v: np.ndarray, same: np.ndarray, lists: list[slice], k: int) -> np.ndarray:
    """The k highest exact scores of each query (fewer: _LOW) among the GATHERED first of the first list."""
    head = np.where(same, _LOW, products(q[:, lists[0]], v[:, lists[0]]))
    found = best(head, max(k, GATHERED))
    out = np.full((len(q), k), _LOW, np.int64)
    for j, hit in enumerate(found):
        exact = np.sort(products(q[j : j + 1], v[hit[hit >= 0]])[0])[::-1][:k]
        out[j, : len(exact)] = exact
    return out


def resolve(q: np.ndarray, v: np.ndarray, tau: np.ndarray, lists: list[slice]) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows of v that may reach tau (_LOW: none known) for some query, their exact scores, and how
    many products of two components it took."""
    left, total, work = np.arange(len(v)), np.zeros((len(q), len(v)), np.int64), 0
    cut = largest(q) * largest(v) * max(1, q.shape[1]) < 1 << 62 and (tau > _LOW).all()
    for c, q_rest, v_rest in zip(lists, rests(q, lists), rests(v, lists), strict=True):
        total = total + products(q[:, c], v[left, c])
        work += len(q) * len(left) * (c.stop - c.start)
        if cut and c is not lists[-1]:
            bound = total + q_rest[:, None] * v_rest[None, left] * (1 + 1e-9) + 1
            some = np.flatnonzero((bound >= tau[:, None]).any(axis=0))
            left, total = left[some], total[:, some]
    return left, total, work


def resolve_all(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, tau: np.ndarray, lists: list[slice], k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of a whole block (ids ascending) for each query; fewer: the score _LOW."""
    top_ids, top_scores = np.empty((len(q), 0), np.int64), np.empty((len(q), 0), np.int64)
    for at in range(0, len(v), step):
        left, total, _ = resolve(q, v[at : at + step], tau, lists)
        some = ids[at + left]
        scores = np.where(own[:, None] == some[None, :], _LOW, total)
        found = best(scores, k)
        top_ids = np.hstack([top_ids, some[found] if len(some) else found])
        top_scores = np.hstack([top_scores, np.where(found < 0, _LOW, np.take_along_axis(scores, found, axis=1))])
        keep = best(top_scores, k)  # ties to what came first, the smaller id
        top_ids, top_scores = np.take_along_axis(top_ids, keep, axis=1), np.where(keep < 0, _LOW, np.take_along_axis(top_scores, keep, axis=1))
    return top_ids, top_scores


def top(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each row of queries (default: the
    vectors whose id is divisible by EVERY), the query's own id left out."""
    rows = usable(vectors)
    asked = usable(queries) if queries is not None else rows.where(F.col("vec_id") % EVERY == 0)
    facts = F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))
    (n, longest, low, high), (m, asked_longest, asked_low, asked_high) = rows.agg(*facts).first(), asked.agg(*facts).first()
    wide = max(longest or 0, asked_longest or 0)
    kind = narrowest(min(low or 0, asked_low or 0), max(high or 0, asked_high or 0))
    fit = max(1, BLOCK_BYTES // (kind.itemsize * max(1, wide)))
    row_blocks, query_blocks, step = max(1, -(-n // min(max(BLOCK_ROWS, m), fit))), max(1, -(-m // min(QUERY_ROWS, fit))), STEP_ROWS
    r = materialise(blocks(rows, row_blocks, "rb", wide, kind), "rows")
    q = materialise(blocks(asked, query_blocks, "qb", wide, kind), "queries").select("qb", F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
    energy = {e["pos"]: e["e"] for e in r.select(F.posexplode("energy").alias("pos", "e")).groupBy("pos").agg(F.sum("e").alias("e")).collect()}  # a row a dimension
    order = np.array(sorted(range(wide), key=lambda d: (-energy.get(d, 0.0), d)), np.int64)
    parts = cuts(wide, lists)
    r = r.drop("energy")

    def pairs(asking: DataFrame) -> DataFrame:
        """Every block of queries with every block of rows: an equi-join on the number of the block of rows."""
        return asking.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).join(r.hint("merge"), "rb")

    def matrix(b: pa.RecordBatch, i: int, ids: str, v: str) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(b.column(ids)[i].as_buffer(), np.int64)
        return own, np.frombuffer(b.column(v)[i].as_buffer(), kind).reshape(len(own), wide)[:, order]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            (ids, v), (q_ids, qv) = matrix(b, 0, "ids", "v"), matrix(b, 0, "q_ids", "q_v")
            for at in range(0, len(q_ids), CHUNK):
                own = q_ids[at : at + CHUNK]
                seen = np.full((len(own), k), _LOW, np.int64)
                for a in range(0, len(ids), step):
                    more = gather(qv[at : at + CHUNK], v[a : a + step], own[:, None] == ids[None, a : a + step], parts, k)
                    seen = np.sort(np.hstack([seen, more]), axis=1)[:, ::-1][:, :k]
                j, place = np.nonzero(seen > _LOW)
                # the seat is the row's place in its block: repeated ids stay apart
                yield pa.RecordBatch.from_pydict({"qb": pa.array([b.column("qb")[0].as_py()] * len(j), pa.int32()), "seat": pa.array(at + j, pa.int32()), "score": pa.array(seen[j, place])})

    seen = pairs(q).mapInArrow(gathered, "qb int, seat int, score long")
    place = F.row_number().over(Window.partitionBy("qb", "seat").orderBy(F.desc("score")))
    kth = seen.withColumn("place", place).where(F.col("place") == k).select("qb", F.struct("seat", F.col("score").alias("tau")).alias("c"))
    cutoffs = materialise(kth.groupBy("qb").agg(F.collect_list("c").alias("cutoffs")), "cutoffs")  # QUERY_ROWS entries at most

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            (ids, v), (q_ids, qv) = matrix(b, 0, "ids", "v"), matrix(b, 0, "q_ids", "q_v")
            tau, known = np.full(len(q_ids), _LOW, np.int64), b.column("cutoffs")[0].values
            if known is not None:
                tau[known.field("seat").to_numpy()] = known.field("tau").to_numpy()
            for at in range(0, len(q_ids), CHUNK):
                own = q_ids[at : at + CHUNK]
                some, scores = resolve_all(qv[at : at + CHUNK], own, v, ids, tau[at : at + CHUNK], parts, k, step)
                j, place = np.nonzero(scores > _LOW)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(own[j]), "qb": pa.array([b.column("qb")[0].as_py()] * len(j), pa.int32()), "seat": pa.array(at + j, pa.int32()),
                    "vec_id": pa.array(some[j, place]), "score": pa.array(scores[j, place]),
                })

    local = pairs(q.join(cutoffs.hint("merge"), "qb", "left")).mapInArrow(resolved, "query_id long, qb int, seat int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qb", "seat").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
