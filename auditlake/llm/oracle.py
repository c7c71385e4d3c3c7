"""SQL that the training-data queries are checked against, where SQL can express them.

Tokenizers (1, 5, 9), fitted models (3, 7, 13), bin packing (6) and HTML to text (10) are not written in SQL.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_BLANK_WORDS = r"[^\x20\x09-\x0D]+"
_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

#: A string of 100 bytes that starts earlier as well covers its bytes. What is left is joined as hex text, as bytes can't be aggregated.
_SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, x, octet_length(x) AS n FROM (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents)),
s AS (SELECT doc_id, pos, hash(x[pos + 1:pos + 100]) AS h FROM (SELECT doc_id, unnest(range(0, n - 99)) AS pos, x FROM d WHERE n >= 100)),
twice AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
w AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM (SELECT s.doc_id, s.pos, d.x[s.pos + 1:s.pos + 100] AS win FROM s JOIN twice USING (h) JOIN d USING (doc_id))),
c AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM w WHERE k > 1),
runs AS (SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
spans AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 100 AS z FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS free FROM spans),
heads AS (SELECT e.doc_id, string_agg(hex(d.x[e.free + 1:e.a]), '' ORDER BY a) AS kept FROM edges e JOIN d USING (doc_id) GROUP BY e.doc_id),
sums AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS z FROM spans GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN d.x ELSE unhex(heads.kept || hex(d.x[z + 1:])) END) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN heads USING (doc_id)
"""

_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words('text', _ITEM_WORDS)} AS w FROM documents),
i AS (SELECT item_id, {_words('text', _ITEM_WORDS)} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda k: array_to_string(w[k:k + least(len(w), 10) - 1], ' '))) AS win FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT dw.doc_id, dw.pos, dw.size, iw.item_id FROM (SELECT doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS win FROM dw) dw JOIN iw USING (size, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _BLANK_WORDS)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, ways.y FROM reach r JOIN ways ON ways.x = r.b),
least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN least_id USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: CRC-32 bit by bit, the lowest bit of each byte first.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: list_transform(range(0, 8), lambda k: (ord(substr(c::VARCHAR, i, 1)) >> k) & 1)))),
  lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"""

_PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
lens AS (SELECT c, count(*) AS n FROM t GROUP BY c),
k AS (SELECT l.c, l.c - l.c % 5 AS base, {_CRC.replace('c::VARCHAR', 'l.c::VARCHAR')} % 9 AS h, least({_CRC.replace('c::VARCHAR', 'l.c::VARCHAR')} % 9, coalesce(b.n, 0)) AS taken FROM lens l LEFT JOIN lens b ON b.c = l.c - l.c % 5),
r AS (SELECT k.c, t.pos + 1 AS d, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.pos < k.h
  UNION ALL SELECT k.c, t.pos - k.h + k.taken + 1, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.pos >= k.h),
p AS (SELECT c, d, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d)) AS node, strlen(text) AS bytes FROM r UNION ALL SELECT c, 0, '', 0 FROM k),
q AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS at_end FROM p),
nodes AS (SELECT node, min(c) AS conv_id, min(d) AS depth, min(up) AS up, count(*) AS n_convs, max(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE at_end) AS ends FROM q GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT a.node AS top, b.node FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT top AS node, sum((n_convs - 1) * bytes)::BIGINT AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves FROM below JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT nodes.conv_id, nodes.depth, above.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, sums.leaves AS n_leaves, sums.saved AS saved_tokens, sha256(coalesce(nodes.ends, '')) AS ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes above ON above.node = nodes.up
"""

_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_words('text', _TERMS)} AS ts FROM documents),
w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS of FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS of FROM c GROUP BY ALL),
f AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(sums.of, 0) + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 5)) // (v.of + 5 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN sums ON sums.lang = g.lang AND sums.source = g.source),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(apart.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM f WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLE: dict[str, str] = {
    "op2_suffix_dedup": _SUFFIX_DEDUP,
    "op4_decontamination": _DECONTAMINATION,
    "op8_near_duplicates": _NEAR_DUPLICATES,
    "op11_prefix_trie": _PREFIX_TRIE,
    "op12_source_divergence": _DIVERGENCE,
}
