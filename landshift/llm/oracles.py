"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Iterable

from landshift.llm import licenses

#: Words of a text: stretches without space, tab, line feed, vertical tab, form feed or return.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Runs of digits, letters a to z and characters beyond ASCII, A-Z lower-cased.
PLAIN = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def values(rows: Iterable[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


OP2 = f"""
WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents), i AS (SELECT item_id, {PLAIN} AS w FROM benchmark),
ds AS (SELECT doc_id, k - 1 AS pos, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
sh AS (SELECT DISTINCT item_id, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM i WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS size FROM sh GROUP BY item_id),
short AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS s FROM i WHERE len(w) BETWEEN 1 AND 4),
runs AS (SELECT doc_id, n, k - 1 AS pos, array_to_string(w[k:k+n-1], ' ') AS s FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM short) WHERE len(w) >= n))
SELECT doc_id, item_id, count(DISTINCT s) / CAST(any_value(size) AS DOUBLE) AS containment, min(pos) AS first_word
FROM ds JOIN sh USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(DISTINCT s) >= 0.8 * any_value(size) - 1e-9
UNION ALL SELECT doc_id, item_id, 1e0 AS containment, min(pos) AS first_word FROM runs JOIN short USING (n, s) GROUP BY doc_id, item_id
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k+12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS pos FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
g AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)))) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+2], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {PLAIN} AS w, coalesce(text, '') AS text FROM documents),
p(phrase, label) AS (VALUES {values(licenses.PHRASES.items())}),
pw AS (SELECT phrase, label, string_split(phrase, ' ') AS q FROM p),
hits AS (SELECT doc_id, k - 1 AS pos, label FROM (SELECT d.*, pw.*, unnest(range(1, len(w) - len(q) + 2)) AS k FROM d, pw WHERE len(w) >= len(q) AND list_contains(w, q[2])) WHERE w[k:k+len(q)-1] = q),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS bl FROM hits GROUP BY doc_id),
t(id, label, template) AS (VALUES {values((str(k), *x) for k, x in enumerate(licenses.TEMPLATES))}),
ts AS (SELECT id, label, list_distinct(string_split(template, ' ')) AS tw, ceil(len(string_split(template, ' ')) / 0.9e0 - 1e-9) AS span FROM t),
tw AS (SELECT id, label, len(tw) AS n, CAST(span AS BIGINT) AS span, unnest(tw) AS word FROM ts),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
win AS (SELECT doc_id, label, n, count(DISTINCT word) OVER (PARTITION BY doc_id, id ORDER BY pos RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING) AS hits FROM placed JOIN tw USING (word)),
met AS (SELECT doc_id, label, hits / CAST(n AS DOUBLE) AS c FROM win WHERE hits >= ceil(0.9e0 * n - 1e-9)),
m AS (SELECT doc_id, max(c) AS c, list(DISTINCT label) AS ml FROM met GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1e0 ELSE coalesce(m.c, 0e0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: crc32 of a decimal number: the table of its 256 steps, then a byte at a time.
CRC = """steps AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step)"""
CRC_OF = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, step[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295)"

OP12 = rf"""
WITH {CRC},
own AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT own.*, CAST({CRC_OF} % 4 AS BIGINT) AS h FROM own, steps),
c AS (SELECT h.conv_id, list_concat(CASE WHEN h.h > 0 THEN coalesce(b.t, [])[1:h.h] ELSE [] END, h.t[h.h + 1:]) AS t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, len(t) AS n, CASE WHEN d > 0 THEN t[1:d] ELSE [] END AS node, CASE WHEN d > 1 THEN t[1:d - 1] ELSE [] END AS above,
  CASE WHEN d > 0 THEN len(regexp_extract_all(t[d].text, '[^ \t\n\x0B\f\r]+')) ELSE 0 END AS words FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM c)),
nodes AS (SELECT node, any_value(above) AS above, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY node, d),
kids AS (SELECT above, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above, d),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.above = nodes.node AND kids.d = nodes.d),
sub AS (SELECT a.node, a.d, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
  FROM (SELECT node, d, CASE WHEN k > 0 THEN node[1:k] ELSE [] END AS top, k FROM (SELECT node, d, unnest(range(d + 1)) AS k FROM nodes)) u JOIN full_ f ON f.node = u.node AND f.d = u.d JOIN nodes a ON a.node = u.top AND a.d = u.k GROUP BY a.node, a.d)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sub ON sub.node = f.node AND sub.d = f.d LEFT JOIN nodes up ON f.d > 0 AND up.node = f.above AND up.d = f.d - 1
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS k FROM documents),
u AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM u SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM cells JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(c) AS c FROM cells GROUP BY lang, term) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
both_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {
    "op2_decontamination": OP2,
    "op5_substring_dedup": OP5,
    "op8_near_dedup": OP8,
    "op9_license_scans": OP9,
    "op12_prefix_trie": OP12,
    "op13_divergence": OP13,
}
