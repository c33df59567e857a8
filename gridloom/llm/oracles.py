"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

import string

from .replytrees import CONTROL, END, TEXT, TURN


def low(x: str) -> str:
    """A-Z in lower case, nothing else."""
    return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


#: Words of documents and items, windows of ten words or of a whole shorter item, and the documents' windows of the same lengths.
DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({low("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({low("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0) t),
k AS (SELECT DISTINCT n FROM v),
o AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS x FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, k WHERE len(ws) >= n) t),
m AS (SELECT doc_id, o.n, i, item FROM o JOIN v ON o.x = v.x AND o.n = v.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) t GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)"""

#: Every 200-byte window of every document by its bytes.
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i : i + 199] AS x FROM (SELECT *, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200) t),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(x), substr(hex(x), 1, 32)) AS n FROM w) t WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
c AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM s GROUP BY doc_id, run),
t AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM c GROUP BY doc_id),
p AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM c UNION ALL SELECT d.doc_id, 1, min(a) FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT p.doc_id, string_agg(hex(b[p.a : coalesce(p.z, octet_length(b) + 1) - 1]), '' ORDER BY p.a) AS kept FROM p JOIN d USING (doc_id) WHERE p.a <= coalesce(p.z, octet_length(b) + 1) - 1 GROUP BY p.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(kept), ''::BLOB)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""

#: All pairs of documents with a common shingle, and what links reach.
JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS x FROM s),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * i >= 75 * (u.n + v.n - i)),
r(id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n"""


def _escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


#: Turns in order, their texts, and the length of the template round them.
CHATS = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(TURN) + len(TEXT) + len(END)}) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM t"""
