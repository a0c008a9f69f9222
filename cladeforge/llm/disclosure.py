"""Personal data, and the terms that disclose it.

Base spans (email, ip, card, phone) are protected entities. A *term* is a run of letters. Over
the corpus, for an entity e and a term t that stands within ``WINDOW`` words of it (a sentence or two):

    PMI(e; t) = ln( N * n(e, t) / (n(e) * n(t)) )     IC(e) = ln( N / n(e) )

n(.) counts documents (N all of them), n(e, t) those where t stands near e. PMI / IC is the share
of the entity's information that t discloses: 1 when t is met only with e. A term is sanitised
wherever it stands if for some entity the share is at least ``GENERALISE``; from ``REMOVE`` on it is
removed, below that it is replaced by the entity's kind.

Chance and copies are no evidence. The ``AROUND`` words on both sides of the entity are its surroundings;
they are named by the smallest hash of their pairs of adjacent words, which copies and most near
copies share. A term needs ``EVIDENCE`` different surroundings, or as many as the entity has documents
but two at least; and half of n(e, t) or more must be different surroundings, so that a family of near
copies, some of which change a word by the entity, doesn't count as many witnesses.

Three passes over the texts, no text is moved: (1) base spans and their neighbouring terms; (2)
document counts of the terms that have enough evidence; (3) base spans again and occurrences of
disclosing terms. Term sets reach tasks as a bit filter of ``BITS_PER_TERM`` bits a term (at most
FILTER_MOST; past that it passes more, and only costs); what passes is settled by exact joins. Only
texts in which something passed travel on; of the others the report writes base spans and a digest, so
pass 3 is made once (``sanitise`` makes it again for the texts themselves). Where no term has enough evidence,
passes 2 and part of 3 have nothing to do. Each pass is linear in a text, however many spans it holds.

Edge cases: null text is empty; repeated rows give a row each; null ids are kept; other columns are
ignored; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm import spans
from cladeforge.llm.common import materialise, slices, texts

WINDOW, AROUND = 24, 12
EVIDENCE = 3
GENERALISE, REMOVE = 0.8, 0.95
MIN_TERM = 3
BITS_PER_TERM, FILTER_LEAST, FILTER_MOST, FILTER_HASHES = 16, 1 << 16, 1 << 26, 3
MEMO_TOKENS, MEMO_CHARS = 100_000, 64  # of a generation; the longest token remembered
_WORD = re.compile(r"[^\W\d_]+")


def entity_key(kind: str, text: str) -> str:
    value = text.casefold() if kind in ("email", "ip") else re.sub("[^0-9]", "", text)
    return f"{kind}:{value}"


def surroundings(left: list[str], right: list[str]) -> int:
    """A name for the words before and after an entity that like surroundings mostly share."""
    words = [*left, "|", *right]
    return min(xxhash.xxh64_intdigest(f"{a} {b}".encode()) for a, b in zip(words, words[1:] or [""], strict=False)) >> 1


def neighbours(text: str) -> Iterator[tuple[str, str, int]]:
    """(entity, term, surroundings) once for each entity and term of the text; ('', entity, 0) for
    each entity."""
    found = spans.pii(text)
    if not found:
        return
    words, starts = [], []
    for m in spans.outside(_WORD, text, found):
        words.append(m[0].casefold())
        starts.append(m.start())
    seen = set()
    for kind, a, b in found:
        entity = entity_key(kind, text[a:b])
        before, after = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
        around = surroundings(words[max(0, before - AROUND) : before], words[after : after + AROUND])
        if (entity,) not in seen:
            seen.add((entity,))
            yield "", entity, 0
        for term in {w for w in words[max(0, before - WINDOW) : before] + words[after : after + WINDOW] if len(w) >= MIN_TERM}:
            if (entity, term) not in seen:
                seen.add((entity, term))
                yield entity, term, around


def enough(n_et: F.Column, different: F.Column, n_e: F.Column) -> F.Column:
    """Whether so many different surroundings are evidence."""
    return (different >= F.greatest(F.lit(2), F.least(F.lit(EVIDENCE), n_e))) & (2 * different >= n_et)


def evidence(docs: DataFrame) -> DataFrame:
    """(entity, term, n_et, n_e) with enough evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t in b.column("text").to_pylist():
                rows += neighbours(t)
                if len(rows) >= 1 << 16:
                    yield _met(rows)
                    rows = []
            if rows:
                yield _met(rows)

    met = texts(docs).mapInArrow(run, "entity string, term string, around long").groupBy("entity", "term", "around").agg(F.count("*").alias("n"))
    met = materialise(met.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("different")), "neighbours")
    entities = met.where("entity = ''").select(F.col("term").alias("entity"), F.col("n_et").alias("n_e"))
    some = met.where("entity <> '' and different >= 2").join(entities.where("n_e >= 2"), "entity")
    return materialise(some.where(enough(F.col("n_et"), F.col("different"), F.col("n_e"))).drop("different"), "evidence")


def _met(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    e, t, a = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"entity": pa.array(e), "term": pa.array(t), "around": pa.array(a, pa.int64())})


def _slots(term: str, bits: int) -> Iterator[int]:
    h = xxhash.xxh3_64_intdigest(term.encode())
    yield h % bits
    for k in range(1, FILTER_HASHES):
        yield (h + k * (h >> 32 | 1)) % bits


def term_filter(terms: DataFrame) -> bytes:
    """A bit filter of different terms(term), sized by their number; b'' for none."""
    count = terms.count()
    if not count:
        return b""
    size = min(FILTER_MOST, max(FILTER_LEAST, 1 << (BITS_PER_TERM * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = sorted({s for t in b.column("term").to_pylist() for s in _slots(t, size)})
            yield pa.RecordBatch.from_pydict({"word": pa.array([s >> 5 for s in at], pa.int64()), "bit": pa.array([1 << (s & 31) for s in at], pa.int64())})

    words = terms.select("term").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # size / 32 rows at most
    out = np.zeros(size // 32, "<u4")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out.tobytes()


class Filter:
    """The terms that may be members, of a word or of a text.

    A text is cut at white space, which no term holds, and a token is taken apart when it is new: most
    of a text is tokens met before. They are remembered in two generations of bounded size, so that tokens that
    come again stay, and rare ones (most of the different tokens of a corpus) don't push them out.
    """

    def __init__(self, bits: bytes):
        self.bits, self.size = bits, 8 * len(bits)
        self.young: dict[str, str | tuple[str, ...]] = {}  # the term that may be a member, '' for none, or several
        self.old: dict[str, str | tuple[str, ...]] = {}

    def __call__(self, word: str) -> str:
        """The word's term if it may be a member, or ''."""
        term = word.casefold()
        if len(term) < MIN_TERM:
            return ""
        for s in _slots(term, self.size):
            if not self.bits[s >> 3] >> (s & 7) & 1:
                return ""
        return term

    def terms(self, text: str) -> set[str]:
        """The different terms of a text that may be members."""
        tokens = set(text.split())
        found = set(map(self.young.get, tokens))
        if None in found:
            found.remove(None)
            young = self.young
            found.update([self._learn(t) for t in tokens if t not in young])
        found.discard("")
        for several in [t for t in found if type(t) is tuple]:
            found.remove(several)
            found.update(several)
        return found

    def _learn(self, token: str) -> str | tuple[str, ...]:
        known = self.old.get(token)
        if known is None:
            if token.isalpha():
                known = self(token)
            else:
                passed = {t for w in set(_WORD.findall(token)) if (t := self(w))}
                known = tuple(passed) if len(passed) > 1 else "".join(passed)
        if len(token) <= MEMO_CHARS:
            if len(self.young) >= MEMO_TOKENS:
                self.young, self.old = {}, self.young
            self.young[token] = known
        return known


def document_counts(docs: DataFrame, bits: bytes) -> DataFrame:
    """term, n_t for every term that passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = Filter(bits)
        for b in batches:
            n: Counter[str] = Counter()
            for part in slices([b]):
                for text in part.column("text").to_pylist():
                    n.update(passes.terms(text))
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(n), pa.string()), "n": pa.array(n.values(), pa.int64())})

    return texts(docs).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_terms(docs: DataFrame) -> tuple[DataFrame, bytes]:
    """term, kind, share for each term over the threshold (its strongest entity), and their filter."""
    pairs = evidence(docs)
    bits = term_filter(pairs.select("term").distinct())
    if not bits:
        return pairs.select("term", F.lit("").alias("kind"), F.lit(0.0).alias("share")), b""
    n = docs.count()
    ic = F.log(F.lit(float(n)) / F.col("n_e"))
    pmi = F.log(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    share = F.when(ic > 0, pmi / ic).otherwise(0.0)
    scored = pairs.join(document_counts(docs, bits), "term").withColumn("share", share).where(F.col("share") >= GENERALISE)
    strongest = F.max(F.struct("share", "entity")).alias("top")
    terms = materialise(scored.groupBy("term").agg(strongest).select("term", F.split("top.entity", ":")[0].alias("kind"), "top.share"), "terms")
    return terms, term_filter(terms)


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, hits array<struct<term:string,start:long,end:long>>, digest binary, text string"
_HITS = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, digests: bool = False) -> DataFrame:
    """A row per document: counts and digest of base spans, ``base`` (joined), ``terms``, an array of
    (start, end, kind, share) for the disclosing terms that don't overlap base spans, and the text.

    With ``digests`` the texts are scanned once: a document in which nothing passed the filter has its
    sanitised text's SHA-256 in ``digest`` instead of the text. Else ``digest`` is null."""
    terms, bits = disclosing_terms(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = Filter(bits) if bits else None
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = spans.pii(text)
                n = Counter(k for k, _, _ in found)
                hits = []
                if passes and (some := passes.terms(text)):
                    hits = [{"term": t, "start": m.start(), "end": m.end()} for m in spans.outside(_WORD, text, found) if (t := m[0].casefold()) in some]
                base = spans.joined(found)
                done = digests and not hits
                rows.append((doc_id, *(n[k] for k in spans.PII_KINDS), spans.digest(found), base, hits, _sha256(cleaned(text, base, [])) if done else None, None if done else text))
            names = ["doc_id", *(f"n_{k}" for k in spans.PII_KINDS), "base_sha256", "base", "hits", "digest", "text"]
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), _HITS, pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    found = texts(docs).mapInArrow(run, _FOUND)
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:string,share:double>>)")
    if not bits:
        return found.withColumn("terms", empty).drop("hits")
    found = found.withColumn("row", F.when(F.size("hits") > 0, F.monotonically_increasing_id()))
    # rows with hits are few, and are written with their texts; the others are written too where they hold no text, else scanned again
    if digests:
        found = materialise(found, "found")
    hit = found.where(F.size("hits") > 0) if digests else materialise(found.where(F.size("hits") > 0), "hits")
    sure = hit.select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(terms, "term")
    sure = sure.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "share"))).alias("terms"))  # of one text
    some = hit.join(sure, "row", "left").withColumn("terms", F.coalesce("terms", empty))
    return found.where(F.size("hits") == 0).withColumn("terms", empty).unionByName(some).drop("row", "hits")


def span_list(base: str, terms: str) -> F.Column:
    """Base spans and terms as kind:start:end, by start, then kind in the order of the kinds."""
    order = F.array(*(F.lit(k) for k in (*spans.PII_KINDS, "term")))
    own = F.transform(F.filter(F.split(base, ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("start"), F.array_position(order, F.split(s, ":")[0]).alias("k"), s.alias("s")))
    more = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), F.lit(len(spans.PII_KINDS) + 1).cast("long").alias("k"), F.concat_ws(":", F.lit("term"), t["start"], t["end"]).alias("s")))
    return F.array_join(F.transform(F.array_sort(F.concat(own, more)), lambda s: s["s"]), ",")


def cleaned(text: str, base: str, terms: list[dict]) -> str:
    """The text with base spans replaced by their kind, and terms by the kind that they disclose or,
    from REMOVE on, by nothing."""
    own = [(f"[{k}]", int(a), int(z)) for k, a, z in (s.split(":") for s in base.split(",") if s)]
    own += [("" if t["share"] >= REMOVE else f"[near {t['kind']}]", t["start"], t["end"]) for t in terms]
    return spans.replaced(text, own) if own else text


def _sha256(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def _cleaned(b: pa.RecordBatch) -> list[str]:
    return [cleaned(*r) for r in zip(*(b.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True)]


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns; also how many terms are generalised and removed, and the sanitised
    text's SHA-256."""
    spans_ = F.when(F.size("terms") == 0, F.col("base")).otherwise(span_list("base", "terms"))
    removed = F.size(F.filter("terms", lambda t: t["share"] >= REMOVE)).cast("long")
    kept = ["doc_id", *(f"n_{k}" for k in spans.PII_KINDS), "base_sha256", "spans", "n_generalised", "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            some = b.filter(pc.is_null(b.column("digest")))
            rest = map(_sha256, _cleaned(some))
            digests = [(next(rest) if d is None else d).hex() for d in b.column("digest").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(digests, pa.string())], [*kept, "sanitised_sha256"])

    rows = find(docs, digests=True).withColumns({"spans": spans_, "n_removed": removed, "n_generalised": F.size("terms").cast("long") - removed})
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_generalised long, n_removed long, sanitised_sha256 string"
    return rows.select(*kept, "digest", "text", "base", "terms").mapInArrow(run, schema)


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text: the sanitised texts (see cleaned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_cleaned(b), pa.string())], ["doc_id", "text"])

    return find(docs).select("doc_id", "text", "base", "terms").mapInArrow(run, "doc_id long, text string")
