"""DuckDB SQL for the operators' queries, where SQL can express them."""

_SPACED = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ALNUM = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id
"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.p, g.n, w.item_id FROM grams g JOIN win w ON g.g = w.g AND g.n = w.n),
places AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ROTATION = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS seq FROM t),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
k AS (SELECT o.*, s.perspective, CASE WHEN o.role = 'system' THEN 'system' WHEN o.role = s.perspective THEN 'assistant' ELSE 'user' END AS kind
  FROM o JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT conv_id, perspective, seq, seq // 512 AS block, kind = 'assistant' AS trained,
  '<|' || CASE WHEN kind = 'user' THEN 'user ' || role ELSE kind END || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece,
  5 + length(CASE WHEN kind = 'user' THEN 'user ' || role ELSE kind END) AS body FROM k),
q AS (SELECT *, length(piece) AS n, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, perspective, block ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT conv_id, perspective, CAST(block AS BIGINT) AS block, count(*) AS n_turns, string_agg(piece, '' ORDER BY seq) AS text,
  coalesce(string_agg(CASE WHEN trained THEN CAST(CAST(before + body AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(before + n - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY seq), '') AS spans,
  CAST(coalesce(sum(CASE WHEN trained THEN n - 1 - body END), 0) AS BIGINT) AS n_trained
FROM q GROUP BY conv_id, perspective, block
"""

_BITS = "lpad(bin(CAST(instr('0123456789abcdef', {}) - 1 AS INTEGER)), 4, '0')"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT sha, array_to_string(list_transform(range(1, 41), lambda i: {_BITS.format("sha[i]")}), '') AS bits FROM (SELECT DISTINCT sha FROM p)),
d AS (SELECT sha, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
  1 + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER) + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER)]), '') AS digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM m JOIN d USING (sha)
"""

#: Entry b + 1 of the table is what byte b does to a CRC-32; crc32 is a list_reduce over the bytes of ASCII text.
_CRC_TABLE = "(SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295)"

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', '{n}', 'text'))})"


def _tree(name: str, nodes: str) -> str:
    """Levels (g, k, i, n, h) of the binary trees over `nodes` (g, i from 0, n, h), until one node is left in each group."""
    return f"""{name} AS (SELECT g, 0 AS k, i, n, h FROM {nodes} UNION ALL
  SELECT g, any_value(k) + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, i // 2)"""


def _beside(name: str) -> str:
    """A path's entries of a tree: the level, the side on which the sibling is, and the sibling, if any."""
    return f"(SELECT a.g, a.i AS leaf, b.k, CASE WHEN (a.i >> b.k) % 2 = 1 THEN 'L' ELSE 'R' END AS side, coalesce(c.h, '') AS h FROM {name} a JOIN {name} b ON a.g = b.g AND a.k = 0 AND b.i = a.i >> b.k AND b.n > 1 LEFT JOIN {name} c ON c.g = b.g AND c.k = b.k AND c.i = xor(b.i, 1))"


MANIFEST = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN n_chars IS NOT NULL AND {_CRC.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_LEAF.format(n="(CAST(n_chars AS HUGEINT) + 1)")} END AS tampered FROM documents, {_CRC_TABLE}),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM d),
{_tree("t", "l")},
s AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS lang FROM t WHERE n = 1),
{_tree("u", "s")},
p AS (SELECT g, leaf, list(side || h ORDER BY k) AS path FROM {_beside("t")} GROUP BY ALL),
q AS (SELECT leaf, list(side || h ORDER BY k) AS path FROM {_beside("u")} GROUP BY ALL),
w AS (SELECT l.doc_id, l.leaf, coalesce(l.tampered, l.leaf) AS given, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path
  FROM l JOIN s ON s.lang = l.g LEFT JOIN p ON p.g = l.g AND p.leaf = l.i LEFT JOIN q ON q.leaf = s.i),
f AS (SELECT *, list_reduce(list_prepend(given, path), lambda h, x: CASE WHEN x[1] = 'L' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda x: x[2:])), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""


def _lattice() -> str:
    """Rows (q, edits, initial, kept, q2, cost) of what may be inserted before a row and done with it, from state to state."""
    then, out = {0: 2, 1: 2, 2: 3, 3: 2}, []
    for q in range(4):
        for k in range(3):
            at = q
            for _ in range(k):
                at = then[at]
            out += [(q, "I" * k + "D", "*", 0, at, 5 * k + 2), (q, "I" * k + "R", "*", 1, then[at], 5 * k + 1), (q, "I" * k + "K", "ua"[then[at] - 2], 1, then[at], 5 * k)]
            out += [(q, "I" * k + "K", "s", 1, 1, 5 * k)] * (at == 0)
            out += [(q, "I" * k, "$", 0, at, 5 * k)]
    return f"(SELECT * FROM (VALUES {', '.join(map(str, out))}) m(q, e, needs, stays, q2, w))"


_SPACE = r"[\x20\x09-\x0D]"
REPAIR = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, {_CRC.format("key")} % 20 AS kind FROM c, {_CRC_TABLE}),
h AS (SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '') AS g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h),
x AS MATERIALIZED (SELECT *, role[1] AS c, CASE WHEN regexp_replace(text, '{_SPACE}', '', 'g') = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
  WHEN right(regexp_replace(text, '{_SPACE}', '', 'g'), 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS f, lag(role[1]) OVER (PARTITION BY g ORDER BY i) || role[1] AS two FROM o),
m AS MATERIALIZED {_lattice()},
dp AS (SELECT DISTINCT g, 0 AS i, 0 AS q, {{'cost': 0, 'audit': ''}} AS best FROM x UNION ALL
  SELECT g, any_value(i) + 1, q2, min({{'cost': best.cost + w + CASE WHEN stays = 1 AND f = 't' THEN 5 ELSE 0 END, 'audit': best.audit || e}}) FROM (SELECT dp.*, x.c, x.f FROM dp JOIN x ON x.g = dp.g AND x.i = dp.i) d JOIN m ON m.q = d.q AND (needs = '*' OR needs = c) AND (stays = 0 OR f IN ('k', 't')) WHERE needs <> '$' GROUP BY g, q2),
a AS (SELECT dp.g, min({{'cost': best.cost + w, 'audit': best.audit || e}}) AS best FROM dp JOIN (SELECT DISTINCT g, n FROM x) z ON z.g = dp.g AND z.n = dp.i JOIN m ON m.q = dp.q AND needs = '$' AND (q2 = 3 OR q2 = 0) GROUP BY 1),
l AS (SELECT g, unnest(string_split(best.audit, '')) AS e, generate_subscripts(string_split(best.audit, ''), 1) AS p FROM a WHERE best.audit <> ''),
r AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER w - 1 AS i, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER w - 1 AS j, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY g) % 2 AS s FROM l WINDOW w AS (PARTITION BY g ORDER BY p)),
t AS (SELECT r.g, sha256(string_agg(CASE WHEN e = 'K' THEN x.role WHEN (j - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE x.text END, chr(10) ORDER BY p)) AS sha FROM r LEFT JOIN x ON x.g = r.g AND x.i = r.i WHERE e <> 'D' GROUP BY 1),
y AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 'b') AS blank, count_if(f = 'd') AS duplicate, count_if(f = 't') AS truncated, count_if(two NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY 1)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '') AS g FROM conversations) v LEFT JOIN y USING (g) LEFT JOIN a USING (g) LEFT JOIN t USING (g)
"""

ORACLES = {
    "op2_ngram_jaccard": JACCARD,
    "op3_topk_threshold": TOPK,
    "op4_decontamination": DECONTAMINATION,
    "op5_perspective_rotation": ROTATION,
    "op7_warc_round_trip": WARC,
    "op11_merkle_manifest": MANIFEST,
    "op12_conversation_repair": REPAIR,
}
