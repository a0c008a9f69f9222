"""The queries once more, in DuckDB SQL over the supplied tables, written from their definitions."""

from __future__ import annotations

import re
from math import comb

from cladeforge.plans import derived as D
from cladeforge.plans.derived import CANDIDATES as K
from cladeforge.plans.derived import POLICY as P
from cladeforge.plans.queries import PARAMS, SPLITMIX_BOUNDS, SPLITMIX_SEEDS

_WORDS = "list_sort(list_distinct(list_filter(list_transform(range(1, length(seq) - 6), lambda i: substr(seq, i, 8)), lambda w: regexp_full_match(w, '[ACGT]+'))))"


def _normal(raw: str) -> str:
    return f"regexp_replace(translate(upper({raw}), 'U', 'T'), '[^ACGTRYSWKMBDHVN]', 'N', 'g')"


def _reads(id_: str, table: str, label: str) -> str:
    return f"SELECT {id_} AS ordinal, {label} AS label, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{D.LETTERS}', '{D.BASES}') AS raw FROM {table}"


def _lineage(source: str, keep: str) -> str:
    parts = ", ".join(f"regexp_extract(tax, '(^|,){r}:([^,]*)', 2)" for r in "dkpcofg")
    return f"SELECT {keep}, [{parts}] AS lineage FROM (SELECT *, regexp_extract(label, ';tax=([^;]*)', 1) AS tax FROM {source} WHERE label LIKE '%;tax=%')"


_PERMUTE = """SELECT word, code, xor(e, e >> 9) AS hash FROM (SELECT *, (d * 57781) & 65535 AS e FROM (SELECT *, xor(c, c >> 7) AS d FROM (
  SELECT *, (b * 34997) & 65535 AS c FROM (SELECT *, xor(code, code >> 8) AS b FROM (
  SELECT word, CAST(list_sum(list_transform(range(0, 8), lambda i: CAST(instr('ACGT', substr(word, CAST(i AS BIGINT) + 1, 1)) - 1 AS BIGINT) << CAST(14 - 2 * i AS BIGINT))) AS BIGINT) AS code FROM words_all)))))"""

_PREFER = f"CASE WHEN length > {P.demote_length} THEN 1 ELSE 0 END, ambiguous, abs(words - median), ordinal"
_OVER = f"length > {P.demote_length}"
_LOW, _AMB, _BIG = f"words < {P.min_words}", f"(length > 0 AND ambiguous / CAST(length AS DOUBLE) > {P.max_ambiguity})", f"length > {P.max_length}"
_REJECT = f"({_LOW} OR {_AMB} OR {_BIG})"
_CLASS = "CASE WHEN words / 65536.0 >= 0.20 THEN '>=20%' WHEN words / 65536.0 >= 0.10 THEN '10-20%' WHEN words / 65536.0 >= 0.05 THEN '5-10%' WHEN words / 65536.0 >= 0.02 THEN '2-5%' ELSE '<2%' END"
_TAIL = " + ".join(f"{comb(32, k)}.0 * pow(p, {k}) * pow(1 - p, {32 - k})" for k in range(32, 3, -1))
_SIM = "CASE WHEN own = 0 OR v >= 65536 THEN 0.0 ELSE greatest(0.0, pow(greatest(0.0, least(1.0, (count / CAST(own AS DOUBLE) - v / 65536.0) / (1 - v / 65536.0))), 0.125) - 0.7) END"


def _jaccard(a: str, b: str) -> str:
    u = f"list_slice(list_sort(list_distinct(list_concat({a}, {b}))), 1, 32)"
    return f"CASE WHEN len({u}) = 0 THEN 0.0 ELSE len(list_filter({u}, lambda x: list_contains({a}, x) AND list_contains({b}, x))) / CAST(len({u}) AS DOUBLE) END"


def _gap(a: str, b: str, refs: str, n: str) -> str:
    return f"CASE WHEN {refs} <= 1 THEN 0.0 ELSE (1 - pow(CAST({refs} AS DOUBLE), -0.2)) * greatest(0.0, {a} - CASE WHEN {n} >= 2 THEN {b} ELSE 0.0 END) END"


def _beta(i: int) -> str:
    return "CASE rank " + " ".join(f"WHEN {r} THEN {v[i]}" for r, v in enumerate(PARAMS.values())) + " END"


def _mixed(source: str, step: str) -> str:
    """source(s, ...) with ``mixed``, what the stream of seed s gives after so many steps."""
    wrap = "% 18446744073709551616 AS UBIGINT)"
    return f"""(SELECT *, CAST((CAST(s AS UHUGEINT) + CAST(11400714819323198485 AS UHUGEINT) * CAST({step} AS UHUGEINT)) {wrap} AS z0, CAST(CAST(xor(z0, z0 >> 30) AS UHUGEINT) * 13787848793156543929 {wrap} AS z1,
      CAST(CAST(xor(z1, z1 >> 27) AS UHUGEINT) * 10723151780598845931 {wrap} AS z2, xor(z2, z2 >> 31) AS mixed FROM {source})"""


def _consensus() -> dict[str, str]:
    """Rank by rank: the names' votes, the choice, and the winners that are left."""
    order = "ORDER BY name = '', votes DESC, name"
    out = {"line0": "SELECT query, lineage, n FROM (SELECT *, sum(n) OVER (PARTITION BY query) AS whole FROM (SELECT query, lineage, count(*) AS n FROM picked JOIN lin ON ordinal = ref_id GROUP BY ALL)) WHERE whole >= 50"}
    for r in range(7):
        out[f"vote{r}"] = f"SELECT query, lineage[{r + 1}] AS name, CAST(sum(n) AS BIGINT) AS votes FROM line{r} GROUP BY ALL"
        out[f"best{r}"] = f"SELECT query, {r} AS rank, first(name {order}) AS name, first(votes {order}) AS votes, CAST(coalesce(sum(votes) FILTER (name <> ''), 0) AS BIGINT) AS informative, coalesce(sum(votes) FILTER (name = ''), 0) AS blank FROM vote{r} GROUP BY query"
        out[f"line{r + 1}"] = f"SELECT a.* FROM line{r} a JOIN best{r} b ON b.query = a.query AND b.name = a.lineage[{r + 1}]"
    out["chosen"] = " UNION ALL ".join(f"SELECT * FROM best{r}" for r in range(7))
    out["calls"] = "SELECT query, rank, name, votes, informative FROM chosen WHERE name <> ''"
    return out


def _walk() -> dict[str, str]:
    """Rank by rank down the probabilities, through an unnamed child where none is named."""
    out = {"place0": "SELECT DISTINCT query, 0 AS parent, CAST(1.0 AS DOUBLE) AS reached FROM child"}
    for r in range(7):
        at = f"ON s.query = p.query AND s.rank = {r} AND s.parent = p.parent WHERE p.reached >= 0.001"
        out[f"named{r}"] = f"SELECT query, {r} AS rank, node, probability, novel FROM (SELECT p.query, s.node, p.reached * s.probability AS probability, p.reached * s.novel AS novel, row_number() OVER (PARTITION BY p.query ORDER BY s.probability DESC, s.first DESC) AS k FROM place{r} p JOIN chance s {at}) WHERE k = 1"
        out[f"blank{r}"] = f"SELECT p.query, s.node, p.reached FROM place{r} p JOIN nameless s {at} AND p.query NOT IN (SELECT query FROM named{r})"
        out[f"place{r + 1}"] = f"SELECT query, node AS parent, probability AS reached FROM named{r} UNION ALL SELECT query, node, reached FROM blank{r}"
    out["walked"] = " UNION ALL ".join(f"SELECT * FROM named{r}" for r in range(7))
    return out


CTES = {
    "raw": _reads("doc_id", "documents", D.REFERENCE_LABEL),
    "qraw": _reads("item_id", "benchmark", D.QUERY_LABEL),
    "rec": f"SELECT ordinal, label, {_normal('raw')} AS seq, length(raw) - length(regexp_replace(upper(raw), '[^ACGTRYSWKMBDHVNU]', '', 'g')) AS unknown FROM raw",
    "qrec": f"SELECT ordinal AS query, label, {_normal('raw')} AS seq FROM qraw",
    "vocab": f"SELECT ordinal, label, seq, {_WORDS} AS words FROM rec",
    "qvocab": f"SELECT query, label, seq, {_WORDS} AS words FROM qrec",
    "lin": _lineage("raw", "ordinal"),
    "qlin": _lineage("qraw", "ordinal AS query"),
    "post": "SELECT unnest(words) AS word, ordinal AS ref_id FROM vocab WHERE ordinal IN (SELECT ordinal FROM lin)",
    "low": "SELECT ordinal, words FROM vocab WHERE ordinal IN (SELECT ordinal FROM lin) ORDER BY len(words), ordinal LIMIT 1 OFFSET 1",
    "words_all": "SELECT DISTINCT word FROM post",
    "hashes": _PERMUTE,
    "prefixed": "SELECT ordinal, CAST(r AS INTEGER) AS rank, lineage[r + 1] AS name, array_to_string(lineage[1:r + 1], '|') AS path, CASE WHEN r > 0 THEN array_to_string(lineage[1:r], '|') END AS up FROM lin, range(0, 7) t(r)",
    "node0": "SELECT *, row_number() OVER (ORDER BY first, rank) AS node_id FROM (SELECT rank, path, min(name) AS name, min(up) AS up, min(ordinal) AS first FROM prefixed GROUP BY rank, path)",
    "node": "SELECT a.node_id, coalesce(b.node_id, 0) AS parent, a.rank, a.name, a.path FROM node0 a LEFT JOIN node0 b ON b.rank = a.rank - 1 AND b.path = a.up",
    "member": "SELECT p.ordinal AS ref_id, p.rank, n.node_id, n.parent FROM prefixed p JOIN node n ON n.rank = p.rank AND n.path = p.path",
    "df": "SELECT word, count(*) AS df FROM post GROUP BY word",
    "leafs": "SELECT a.ref_id, a.node_id AS leaf, a.parent AS family FROM member a WHERE rank = 6",
    "stats": """SELECT n.node_id, n.refs AS "references", coalesce(c.kids, 0) AS children, coalesce(g.genera, 0) AS genera FROM (
        SELECT node_id, count(*) AS refs FROM member GROUP BY 1 UNION ALL SELECT 0, count(*) FROM lin) n
      LEFT JOIN (SELECT parent AS node_id, count(*) AS kids FROM node WHERE name <> '' GROUP BY 1) c USING (node_id)
      LEFT JOIN (SELECT m.node_id, count(DISTINCT l.leaf) AS genera FROM member m JOIN leafs l USING (ref_id) GROUP BY 1 UNION ALL SELECT 0, count(DISTINCT leaf) FROM leafs) g USING (node_id)""",
    "weight": "SELECT word, CASE WHEN df <= (SELECT list_sort(list(df))[least(count(*) * 25 // 100, count(*) - 1) + 1] FROM df) THEN 4 ELSE 1 END AS weight FROM df",
    "counts": "SELECT query, ref_id, count(*) AS count FROM (SELECT query, unnest(words) AS word FROM qvocab) JOIN post USING (word) GROUP BY ALL",
    "cand": f"SELECT * FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY count DESC) AS rank FROM counts) WHERE rank <= {K}",
    "hist": "SELECT query, count, count(*) AS refs FROM counts GROUP BY ALL UNION ALL SELECT * FROM (SELECT q.query, 0 AS count, (SELECT count(*) FROM lin) - count(c.ref_id) AS refs FROM qvocab q LEFT JOIN counts c USING (query) GROUP BY q.query) WHERE refs > 0",
    "located": "SELECT q.query, r AS rank, coalesce((SELECT n.node_id FROM node n WHERE n.rank = r AND n.path = array_to_string(q.lineage[1:r + 1], '|')), -1) AS node FROM qlin q, range(0, 7) t(r)",
    "qkey": "SELECT query, words, len(words) AS n, sha256('query:1:1:' || seq) AS key FROM qvocab WHERE len(words) >= 32",
    "streams": "SELECT query, words, n, boot, role, CAST('0x' || substr(sha256(key || ':0:' || role || ':' || boot), 1, 16) AS UBIGINT) AS s FROM qkey, range(0, 100) t(boot), range(0, 2) u(role)",
    "drawn": f"SELECT query, CAST(boot AS INTEGER) AS boot, words[CAST(mixed % n AS BIGINT) + 1] AS word, CAST(count(*) AS INTEGER) AS mult FROM {_mixed('streams, range(0, 32) d(i)', 'i + 1')} WHERE role = 0 GROUP BY ALL",
    "scored": "SELECT query, boot, ref_id, sum(mult) AS score FROM drawn JOIN post USING (word) GROUP BY ALL",
    "weighed": "SELECT query, boot, ref_id, sum(mult * weight) AS score FROM drawn JOIN post USING (word) JOIN weight USING (word) GROUP BY ALL",
    "top": "SELECT query, boot, CAST(score AS BIGINT) AS score, list(ref_id ORDER BY ref_id) AS ties FROM scored JOIN (SELECT query, boot, max(score) AS score FROM scored GROUP BY ALL) USING (query, boot, score) GROUP BY ALL",
    "picked": f"SELECT t.query, t.boot, t.score, t.ties[CAST(m.mixed % len(t.ties) AS BIGINT) + 1] AS ref_id FROM top t JOIN {_mixed('streams', '1')} m ON m.query = t.query AND m.boot = t.boot AND m.role = 1 WHERE t.score >= 2",
    **_consensus(),
    "supported": "SELECT *, min(own) OVER w AS confidence, min(votes / 100.0) OVER w AS raw FROM (SELECT *, CAST(CASE WHEN informative < 50 THEN votes / 100.0 ELSE votes / CAST(informative AS DOUBLE) END AS DOUBLE) AS own FROM calls) WINDOW w AS (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING)",
    "wide": "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY count DESC) AS rank FROM counts) WHERE rank <= 2048",
    "sized": "SELECT c.query, c.ref_id, c.count, len(q.words) AS own, len(v.words) AS v FROM counts c JOIN qvocab q USING (query) JOIN vocab v ON v.ordinal = c.ref_id",
    "alike": f"SELECT query, ref_id, {_SIM} AS similarity FROM sized",
    "sim": "SELECT a.* FROM alike a JOIN wide USING (query, ref_id)",
    "winner": "SELECT query, ref_id FROM (SELECT *, count(*) OVER (PARTITION BY query) AS whole FROM picked) WHERE whole >= 50",
    "child": "SELECT query, rank, parent, node_id AS node, max(similarity) AS s1, coalesce(list_sort(list(similarity), 'DESC')[2], 0.0) AS s2, count(*) AS scored, min(ref_id) AS first FROM sim JOIN member USING (ref_id) WHERE query IN (SELECT query FROM winner) GROUP BY ALL",
    "vote": "SELECT query, node_id AS node, count(*) AS votes FROM winner JOIN member USING (ref_id) GROUP BY ALL",
    "des0": f"""SELECT c.query, c.rank, c.parent, c.node, c.first, n.name, c.s1, {_gap('c.s1', 'c.s2', 's."references"', 'c.scored')} AS gap,
        coalesce(v.votes, 0) / CAST((SELECT count(*) FROM winner w WHERE w.query = c.query) AS DOUBLE) AS vote, ln(CAST(greatest(s.genera, 1) AS DOUBLE)) AS genera
      FROM child c JOIN node n ON n.node_id = c.node JOIN stats s ON s.node_id = c.node LEFT JOIN vote v ON v.query = c.query AND v.node = c.node""",
    "des": """SELECT a.*, coalesce((SELECT max(b.s1) FROM des0 b WHERE b.query = a.query AND b.parent = a.parent AND b.rank = a.rank AND b.name = ''), 0.0) AS sentinel,
        greatest(0, k.children - (SELECT count(*) FROM des0 b WHERE b.query = a.query AND b.parent = a.parent AND b.rank = a.rank AND b.name <> '')) AS absent
      FROM des0 a JOIN stats k ON k.node_id = a.parent WHERE a.name <> ''""",
    "soft": f"""SELECT *, {_beta(0)} + {_beta(1)} * s1 + {_beta(2)} * gap + {_beta(3)} * vote + {_beta(4)} * genera + {_beta(5)} * sentinel AS z, {_beta(6)} + {_beta(5)} * sentinel AS away FROM des""",
    "chance": "SELECT query, rank, parent, node, first, exp(z) / (sum(exp(z)) OVER w + 1 + absent * exp(away)) AS probability, (1 + absent * exp(away)) / (sum(exp(z)) OVER w + 1 + absent * exp(away)) AS novel FROM soft WINDOW w AS (PARTITION BY query, rank, parent)",
    "nameless": "SELECT DISTINCT c.query, c.rank, c.parent, c.node FROM child c JOIN node n ON n.node_id = c.node WHERE n.name = ''",
    **_walk(),
    "steps": """SELECT l.query, r.label, l.rank, l.node AS target, CASE WHEN l.rank = 0 THEN 0 ELSE u.node END AS parent FROM located l JOIN qlin q USING (query) JOIN qraw r ON r.ordinal = l.query
      LEFT JOIN located u ON u.query = l.query AND u.rank = l.rank - 1 WHERE l.node >= 0 AND q.lineage[l.rank + 1] <> ''""",
    "met": "SELECT query, rank, parent, count(*) FILTER (name <> '') AS matched, coalesce(max(s1) FILTER (name = ''), 0.0) AS sentinel FROM des0 GROUP BY ALL",
    "summ": f"""SELECT v.ordinal, v.label, l.lineage, array_to_string(l.lineage, '|') AS leaf, array_to_string(l.lineage[1:5], '|') AS order_path, length(seq) AS length, len(words) AS words,
        length(seq) - length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS ambiguous, seq, l.lineage[6] = '' AND l.lineage[7] = '' AS shallow, l.lineage[1] LIKE '\\_%' ESCAPE '\\' OR l.lineage[1] LIKE 'Unispike%' AS organellar
      FROM vocab v JOIN lin l USING (ordinal)""",
    "sketches": "SELECT ref_id AS ordinal, list_slice(list_sort(list(hash)), 1, 32) AS sketch FROM post JOIN hashes USING (word) GROUP BY 1 UNION ALL SELECT ordinal, [] FROM summ WHERE words = 0",
    "grp": "SELECT *, row_number() OVER (ORDER BY first) - 1 AS g FROM (SELECT leaf, count(*) AS records, min(ordinal) AS first, any_value(lineage) AS lineage, any_value(order_path) AS order_path FROM summ GROUP BY leaf)",
    "cover": "SELECT order_path, CAST(sum(records) AS BIGINT) AS annotated FROM grp WHERE lineage[7] <> '' GROUP BY 1",
    "classed": """SELECT grp.*, annotated, CASE WHEN lineage[6] <> '' OR lineage[7] <> '' THEN NULL WHEN lineage[5] = '' THEN 'unplaced' WHEN annotated IS NOT NULL THEN 'covered' ELSE 'orphan' END AS class
      FROM grp LEFT JOIN cover USING (order_path)""",
    "caps": f"""SELECT *, CASE WHEN class IS NULL THEN {P.cap} WHEN class = 'unplaced' THEN {P.shallow_unplaced} WHEN class = 'orphan' THEN {P.shallow_orphan}
      ELSE greatest(1, least({P.shallow_covered}, CAST(ceil(annotated * {P.shallow_ratio}) AS BIGINT))) END AS cap FROM classed""",
    "own": "SELECT s.*, c.g, c.cap, c.class FROM summ s JOIN caps c USING (leaf)",
    "good": f"SELECT * EXCLUDE (copy) FROM (SELECT *, row_number() OVER (PARTITION BY leaf, seq ORDER BY ordinal) AS copy FROM own WHERE NOT {_REJECT}) WHERE copy = 1",
    "lost": "SELECT * FROM own WHERE leaf NOT IN (SELECT leaf FROM good)",
    "back": f"SELECT * EXCLUDE (median, place) FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY {_PREFER}) AS place FROM (SELECT *, list_sort(list(words) OVER (PARTITION BY leaf))[count(*) OVER (PARTITION BY leaf) // 2 + 1] AS median FROM lost)) WHERE place <= cap",
    "pool": "SELECT * FROM good UNION ALL BY NAME SELECT * FROM back",
    "first_kept": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY {_PREFER}) AS place FROM (SELECT *, list_sort(list(words) OVER (PARTITION BY leaf))[count(*) OVER (PARTITION BY leaf) // 2 + 1] AS median FROM pool)) WHERE place <= cap",
    "bands": "SELECT ordinal, leaf, b, array_to_string(sketch[4 * b + 1:4 * b + 4], ',') AS key FROM sketches JOIN summ USING (ordinal), range(0, 4) t(b) WHERE len(sketch) >= 4 * (b + 1)",
    "probe": "SELECT * FROM (SELECT s.leaf, s.ordinal, k.sketch, row_number() OVER (PARTITION BY s.leaf ORDER BY s.ordinal) - 1 AS i FROM summ s JOIN sketches k USING (ordinal) WHERE s.leaf IN (SELECT leaf FROM grp ORDER BY records DESC, g LIMIT 500)) WHERE i < 128",
}


def sql(final: str) -> str:
    """The query with the named parts that it needs, in order."""
    needed, todo = set(), [final]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {parts}\n{final}" if parts else final


def _paths(source: str) -> str:
    return f"SELECT DISTINCT r AS rank, array_to_string(lineage[1:r + 1], '|') AS path FROM {source}, range(0, 7) t(r) WHERE lineage[r + 1] <> ''"


_SPLITMIX = f"""
SELECT seed, bound, CAST(z3 % bound AS BIGINT) AS value FROM (SELECT *, xor(z2, z2 >> 31) AS z3 FROM (SELECT *, CAST(CAST(xor(z1, z1 >> 27) AS UHUGEINT) * 10723151780598845931 % 18446744073709551616 AS UBIGINT) AS z2 FROM (
  SELECT *, CAST(CAST(xor(z0, z0 >> 30) AS UHUGEINT) * 13787848793156543929 % 18446744073709551616 AS UBIGINT) AS z1 FROM (
  SELECT seed, bound, CAST((CAST(seed AS UHUGEINT) + 11400714819323198485) % 18446744073709551616 AS UBIGINT) AS z0
  FROM unnest({list(SPLITMIX_SEEDS)}) s(seed), unnest({list(SPLITMIX_BOUNDS)}) b(bound)))))"""

ORACLES = {
    name: sql(text)
    for name, text in {
        "normalize_sequence": "SELECT ordinal, unknown, md5(seq) AS seq_md5 FROM rec",
        "unique_words": "SELECT ordinal, len(words) AS n, md5(array_to_string(words, ',')) AS words_md5 FROM vocab",
        "reverse_complement": "SELECT ordinal, md5(reverse(translate(seq, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD'))) AS seq_md5 FROM rec",
        "revcomp_vocabulary": "SELECT ordinal, md5(array_to_string(list_sort(list_transform(words, lambda w: reverse(translate(w, 'ACGT', 'TGCA')))), ',')) AS words_md5 FROM vocab",
        "parse_taxonomy": "SELECT r.ordinal, l.ordinal IS NOT NULL AS ok, array_to_string(l.lineage, '|') AS lineage FROM raw r LEFT JOIN lin l USING (ordinal)",
        "permute_word": "SELECT * FROM hashes",
        "minhash_sketch": "SELECT ordinal, array_to_string(sketch, ',') AS sketch FROM sketches",
        "taxonomy_nodes": "SELECT node_id, parent, rank, name FROM node",
        "locate_lineage": "SELECT query, string_agg(CAST(node AS VARCHAR), ',' ORDER BY rank) AS nodes FROM located GROUP BY query",
        "rank_census": "SELECT rank, count(*) FILTER (name <> '') AS named FROM prefixed GROUP BY rank",
        "document_frequency": "SELECT * FROM df",
        "taxon_frequency": "SELECT word, count(DISTINCT leaf) AS genera, count(DISTINCT family) AS families FROM post JOIN leafs USING (ref_id) GROUP BY word",
        "node_stats": "SELECT * FROM stats",
        "word_weights": "SELECT * FROM weight",
        "index_verify": """SELECT 'postings' AS part, CAST((SELECT len(words) FROM low) AS BIGINT) AS mismatches UNION ALL SELECT 'word_stats', (SELECT len(words) FROM low) UNION ALL SELECT 'node_stats', 1 UNION ALL SELECT 'vocabulary', 2""",
        "rank_counts": "SELECT * FROM counts",
        "candidate_select": "SELECT * FROM cand",
        "count_histogram": "SELECT * FROM hist",
        "holdout_self": "SELECT c.* FROM counts c JOIN qvocab q USING (query) JOIN vocab v ON v.ordinal = c.ref_id WHERE NOT (c.count = len(q.words) AND c.count = len(v.words))",
        "holdout_genus": "SELECT c.* FROM counts c JOIN leafs l USING (ref_id) WHERE NOT EXISTS (SELECT 1 FROM located x WHERE x.query = c.query AND x.rank = 6 AND x.node = l.leaf)",
        "risk_bound": f"""SELECT query, round(sum(refs * CASE WHEN p <= 0 THEN 0.0 WHEN p >= 1 THEN 1.0 ELSE least(1.0, {_TAIL}) END), 6) AS risk
          FROM (SELECT h.query, h.refs, h.count / CAST(len(q.words) AS DOUBLE) AS p FROM hist h JOIN qvocab q USING (query) JOIN (SELECT query, min(count) AS threshold FROM cand GROUP BY 1) t USING (query) WHERE h.count < t.threshold AND len(q.words) > 0) GROUP BY query""",
        "splitmix_bounded": _SPLITMIX,
        "best_strand": """SELECT query, max, winners, strand FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY max DESC, winners DESC, strand) AS place FROM (
          SELECT query, strand, max(count) AS max, count(*) FILTER (count >= 32) AS winners FROM (SELECT query, strand, ref_id, count(*) AS count FROM (
            SELECT query, 0 AS strand, unnest(words) AS word FROM qvocab UNION ALL SELECT query, 1, reverse(translate(unnest(words), 'ACGT', 'TGCA')) FROM qvocab) JOIN post USING (word) GROUP BY ALL) GROUP BY ALL)) WHERE place = 1""",
        "protax_similarity": "SELECT query, ref_id, round(similarity, 6) AS similarity FROM sim",
        "protax_gap": f"SELECT query, round({_gap('a', 'b', 'n', 'n')}, 6) AS gap FROM (SELECT query, max(similarity) AS a, coalesce(list_sort(list(similarity), 'DESC')[2], 0.0) AS b, count(*) AS n FROM sim GROUP BY query)",
        "protax_design": "SELECT query, rank, parent, node, round(s1, 6) AS s1, round(gap, 6) AS gap, round(vote, 6) AS vote, round(genera, 6) AS genera, round(sentinel, 6) AS sentinel, absent FROM des",
        "protax_softmax": "SELECT query, rank, node, round(probability, 6) AS probability, round(novel, 6) AS novel FROM chance",
        "protax_resolve": "SELECT query, rank, node, round(probability, 6) AS probability, round(novel, 6) AS novel FROM walked",
        "training_rows": """SELECT t.label AS query, substr('dkpcofg', CAST(t.rank AS BIGINT) + 1, 1) AS rank, 'present' AS kind, CAST(d.node AS BIGINT) AS node, printf('%.6f', s1) AS s1, printf('%.6f', gap) AS gap, printf('%.4f', vote) AS vote, printf('%.6f', genera) AS genera,
            printf('%.6f', sentinel) AS sentinel, 1 AS multiplicity, CAST(d.node = t.target AS INTEGER) AS truth FROM des d JOIN steps t ON t.query = d.query AND t.rank = d.rank AND t.parent = d.parent
          UNION ALL SELECT t.label, substr('dkpcofg', CAST(t.rank AS BIGINT) + 1, 1), 'absent', 0, '0', '0', '0', '0', printf('%.6f', m.sentinel), k.children - m.matched, CAST(NOT EXISTS (SELECT 1 FROM des0 x WHERE x.query = t.query AND x.node = t.target) AS INTEGER)
          FROM steps t JOIN met m ON m.query = t.query AND m.rank = t.rank AND m.parent = t.parent JOIN stats k ON k.node_id = t.parent WHERE k.children > m.matched""",
        "bootstrap_draws": "SELECT * FROM drawn",
        "replicate_scores": "SELECT query, boot, count(*) AS refs, CAST(sum(score) AS BIGINT) AS total, CAST(max(score) AS BIGINT) AS most, CAST(sum(score * (ref_id % 1009)) AS BIGINT) AS mixed FROM weighed GROUP BY ALL",
        "candidate_scores": "SELECT query, ref_id, count(*) AS boots, CAST(sum(score) AS BIGINT) AS total, CAST(sum(score * boot) AS BIGINT) AS mixed FROM scored JOIN cand USING (query, ref_id) GROUP BY ALL",
        "replicate_tops": "SELECT query, boot, score, array_to_string(ties, ',') AS ties FROM top",
        "tie_pick": "SELECT * FROM picked",
        "consensus_calls": "SELECT * FROM calls",
        "consensus_tallies": "SELECT query, 7 AS voted, count(*) FILTER (name <> '' AND blank > 0 AND blank >= votes) AS abstained, string_agg(CAST(informative AS VARCHAR), ',' ORDER BY rank) AS informative FROM chosen GROUP BY query HAVING count(*) FILTER (name <> '') > 0",
        "confidence_adjusted": "SELECT query, rank, round(confidence, 6) AS confidence FROM supported",
        "prediction_tsv": """SELECT q.query, concat(q.label, chr(9), s.every, chr(9), CASE WHEN s.every IS NULL THEN '' ELSE '+' END, chr(9), s.sure) AS line FROM qvocab q LEFT JOIN (
          SELECT query, string_agg(printf('%s:%s(%.2f)', code, name, CAST(raw AS DOUBLE)), ',' ORDER BY rank) AS every, string_agg(concat(code, ':', name), ',' ORDER BY rank) FILTER (raw >= 0.8) AS sure FROM (SELECT *, substr('dkpcofg', CAST(rank AS BIGINT) + 1, 1) AS code FROM supported) GROUP BY query) s USING (query)""",
        "minimum_vocabulary": "SELECT ordinal, len(words) AS words FROM vocab WHERE len(words) < 32",
        "reference_lineages": "SELECT ref_id, max(node_id) FILTER (rank = 6) AS leaf, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY rank) AS lineage FROM member GROUP BY ref_id",
        "outside_winners": """SELECT a.query, a.ref_id, round(similarity, 6) AS similarity, CASE WHEN r.rank <= 3 THEN 0 ELSE 1 END AS outside FROM alike a JOIN (SELECT *, rank() OVER (PARTITION BY query ORDER BY count DESC) AS rank FROM counts) r USING (query, ref_id)
          WHERE r.rank <= 3 OR EXISTS (SELECT 1 FROM picked p WHERE p.query = a.query AND p.ref_id = a.ref_id)""",
        "survey_summary": "SELECT ordinal, leaf AS lineage, length, words, ambiguous, sha256(seq) AS digest, shallow, organellar FROM summ",
        "policy_flags": f"SELECT ordinal, {_OVER} AS demoted, {_BIG} AS oversize, {_LOW} AS low_complexity, {_AMB} AS is_ambiguous, {_REJECT} AS rejected FROM summ",
        "oversize_list": f"SELECT label, length FROM summ WHERE {_OVER}",
        "dedup_exact": "SELECT min(ordinal) AS ordinal FROM summ GROUP BY leaf, seq",
        "duplicate_audit": "SELECT CAST(coalesce(sum(n - k), 0) AS BIGINT) AS duplicates, count(*) FILTER (k > 1) AS conflicting FROM (SELECT seq, count(*) AS n, count(DISTINCT leaf) AS k FROM summ GROUP BY seq)",
        "length_percentiles": "SELECT l[1] AS min, " + ", ".join(f"l[least(CAST(floor(n * {q}) AS BIGINT), n - 1) + 1] AS {name}" for name, q in {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}.items()) + ", l[n] AS max, round(m, 6) AS mean FROM (SELECT list_sort(list(length)) AS l, count(*) AS n, avg(length) AS m FROM summ)",
        "cap_curve": "SELECT cap, CAST(sum(least(records, cap)) AS BIGINT) AS records FROM grp, unnest([1, 2, 3, 5, 10, 20, 25, 50, 100, 250, 500, 1000, 2500]) t(cap) GROUP BY cap",
        "occupancy_classes": f"SELECT {_CLASS} AS class, count(*) AS records, CAST(sum(length) AS BIGINT) AS bases FROM summ GROUP BY 1",
        "occupancy_domains": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY records DESC, domain) AS place FROM (SELECT {_CLASS} AS class, lineage[1] AS domain, count(*) AS records FROM summ GROUP BY ALL)) WHERE place <= 3",
        "truncation_artifact": "SELECT * FROM (SELECT length, count(*) AS records FROM summ WHERE length > 4096 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) WHERE records >= 100",
        "plan_totals": f"SELECT count(*) AS records, count(*) FILTER (organellar) AS organellar, CAST(coalesce(sum(length) FILTER (organellar), 0) AS BIGINT) AS organellar_bases, count(*) FILTER ({_OVER}) AS demoted, CAST(coalesce(sum(length) FILTER ({_OVER}), 0) AS BIGINT) AS demoted_bases, count(*) FILTER ({_LOW}) AS low_complexity, count(*) FILTER ({_AMB}) AS ambiguous FROM summ",
        "order_coverage": "SELECT * FROM cover",
        "shallow_classes": "SELECT class, count(*) AS lineages, CAST(sum(records) AS BIGINT) AS records FROM classed WHERE class IS NOT NULL GROUP BY class",
        "group_caps": "SELECT g, records, class, cap FROM caps",
        "restored_groups": "SELECT g, ordinal FROM back",
        "select_first": "SELECT g, ordinal FROM first_kept",
        "drop_counts": f"""SELECT 0 AS deliberate, (SELECT count(*) FROM own WHERE {_LOW}) - (SELECT count(*) FROM back WHERE {_LOW}) AS low_complexity, (SELECT count(*) FROM own WHERE {_AMB}) - (SELECT count(*) FROM back WHERE {_AMB}) AS ambiguous,
          (SELECT count(*) FROM own WHERE {_BIG}) - (SELECT count(*) FROM back WHERE {_BIG}) AS oversize, (SELECT count(*) FROM own WHERE NOT {_REJECT}) - (SELECT count(*) FROM good) AS duplicates, (SELECT count(*) FROM back) AS restored,
          (SELECT count(*) FROM pool WHERE class IS NOT NULL) - (SELECT count(*) FROM first_kept WHERE class IS NOT NULL) AS over_shallow_cap, (SELECT count(*) FROM pool WHERE class IS NULL) - (SELECT count(*) FROM first_kept WHERE class IS NULL) AS over_cap""",
        "curation_invariants": f"SELECT (SELECT count(*) FROM grp WHERE leaf NOT IN (SELECT leaf FROM first_kept)) AS groups_missing, (SELECT count(*) FROM ({_paths('grp')} EXCEPT {_paths('first_kept')})) AS names_missing",
        "hazard_after": f"SELECT count(*) AS records, count(*) FILTER (words / 65536.0 >= 0.05) AS saturating, count(*) FILTER (organellar) AS organellar, count(*) FILTER ({_OVER}) AS over_demote FROM first_kept",
        "diversity_probe": f"""SELECT a.ordinal, b.ordinal AS partner, round(1 - ({_jaccard('a.sketch', 'b.sketch')}), 6) AS distance FROM (SELECT *, count(*) OVER (PARTITION BY leaf) AS n FROM probe) a JOIN probe b ON b.leaf = a.leaf AND b.i = (a.i + greatest(a.n // 2, 1)) % a.n
          WHERE a.n > 1 AND a.i < 64""",
        "sketch_jaccard": f"SELECT s.ordinal, g.first AS other, round({_jaccard('a.sketch', 'b.sketch')}, 6) AS jaccard FROM summ s JOIN grp g USING (leaf) JOIN sketches a ON a.ordinal = s.ordinal JOIN sketches b ON b.ordinal = g.first",
        "lsh_density": "SELECT s.ordinal, CAST(coalesce(d.density, 0) AS BIGINT) AS density FROM summ s LEFT JOIN (SELECT ordinal, sum(n - 1) AS density FROM (SELECT *, count(*) OVER (PARTITION BY leaf, b, key) AS n FROM bands) GROUP BY 1) d USING (ordinal)",
    }.items()
}
