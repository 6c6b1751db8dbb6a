"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: The mix, with the same keys: sources filled up in the order of the level at which they are full, documents in the order of
#: their keys up to the budget, and the later document that comes nearest to what is left.
MIX = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '~null') AS sk, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS tie FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(tie, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / least(1.0::DOUBLE, 0.25::DOUBLE + size / 400.0::DOUBLE) AS key FROM d),
s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY sk) - 1 AS r FROM d GROUP BY sk),
w AS (SELECT *, CAST(r % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / w AS level FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS caps, coalesce(sum(w) OVER p, 0) AS ws, sum(source_size) OVER () AS words, sum(w) OVER () AS weight FROM l
  WINDOW p AS (ORDER BY level, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, caps + cap + level * (weight - ws - w) <= words AS isfull FROM f),
h AS (SELECT *, (words - coalesce(sum(CASE WHEN isfull THEN cap END) OVER (), 0)) / nullif(weight - coalesce(sum(CASE WHEN isfull THEN w END) OVER (), 0), 0) AS share FROM g),
t AS (SELECT sk, source_size, CASE WHEN isfull THEN cap ELSE w * coalesce(share, 0) END AS target FROM h),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
b AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS budget, sum(size) OVER (PARTITION BY k.sk ORDER BY key, tie) AS upto FROM k JOIN e ON k.sk = e.sk),
c AS (SELECT *, source_size > 0 AND upto <= budget AS inside FROM b),
q AS (SELECT *, budget - coalesce(max(CASE WHEN inside THEN upto END) OVER (PARTITION BY sk), 0) AS gap FROM c),
x AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY CASE WHEN NOT inside AND size > 0 AND abs(size - gap) < gap THEN 0 ELSE 1 END, abs(size - gap), key, tie) AS place FROM q),
y AS (SELECT *, epochs + CAST(inside OR (place = 1 AND NOT inside AND size > 0 AND abs(size - gap) < gap) AS BIGINT) AS copies FROM x)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM y
"""

#: Line dedup: a line goes if the same or one within an edit came before it. Of two lines within an edit one half is equal, so
#: that only those are compared; levenshtein() counts bytes, hence only sieves.
LINES = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents),
p AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS raw FROM a),
l AS (SELECT doc_id, pos, raw, trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line FROM p),
d AS (SELECT line, min(doc_id * 1000000000::HUGEINT + pos) AS first FROM l WHERE line <> '' GROUP BY line),
u AS (SELECT line, first, length(line) AS n FROM d WHERE line <> ''),
h AS (SELECT line, first, n, m, part, CASE WHEN part = 0 THEN substring(line, 1, m // 2) ELSE substring(line, n - (m - m // 2) + 1) END AS half
  FROM u, (SELECT unnest([0, 1]) AS part), (SELECT unnest([0, 1]) AS less), LATERAL (SELECT n - less AS m)),
pair AS (SELECT DISTINCT x.line, CASE WHEN x.n <= y.n THEN x.line ELSE y.line END AS s, CASE WHEN x.n <= y.n THEN y.line ELSE x.line END AS t, x.n = y.n AS same
  FROM h x JOIN h y ON x.m = y.m AND x.part = y.part AND x.half = y.half AND y.first < x.first AND abs(x.n - y.n) <= 1),
apart AS (SELECT *, coalesce(list_position(list_transform(range(1, length(s) + 1), lambda i: s[i] <> t[i]), true), length(s) + 1) AS f FROM pair WHERE abs(strlen(s) - strlen(t)) <= 4 AND levenshtein(s, t) <= 4),
near AS (SELECT DISTINCT line FROM apart WHERE CASE WHEN same THEN substring(s, f + 1) = substring(t, f + 1) ELSE substring(s, f) = substring(t, f + 1) END),
g AS (SELECT l.doc_id, l.pos, l.raw, l.line, l.line <> '' AND (near.line IS NOT NULL OR l.doc_id * 1000000000::HUGEINT + l.pos > d.first) AS gone FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line)
SELECT a.doc_id, CASE WHEN a.text IS NOT NULL THEN coalesce(string_agg(CASE WHEN NOT coalesce(gone, false) THEN raw END, chr(10) ORDER BY pos), '') END AS text,
  CAST(count(CASE WHEN line <> '' THEN 1 END) AS INTEGER) AS n_lines, CAST(count(CASE WHEN gone THEN 1 END) AS INTEGER) AS n_removed
FROM a LEFT JOIN g ON a.doc_id = g.doc_id GROUP BY a.doc_id, a.text
"""

#: Near duplicates: weighted Jaccard of five-word shingles over all pairs that share one, equal texts, and classes by reach.
NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
c AS (SELECT doc_id, sh, count(*) AS n FROM g GROUP BY 1, 2),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS n FROM c x JOIN c y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
k AS (SELECT b.a, b.b FROM b JOIN t x ON x.doc_id = b.a JOIN t y ON y.doc_id = b.b WHERE b.n >= 0.8 * (x.n + y.n - b.n)
  UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text AND x.doc_id < y.doc_id),
l AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM r GROUP BY a
"""

SQL: dict[str, str] = {"op3_near_duplicates": NEAR, "op1_mix_sources": MIX, "op10_line_dedup": LINES}
