"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

#: Lines one edit apart share a line with one character, or one word, replaced, inserted or removed.
LINE_DEDUP = """WITH RECURSIVE raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
l AS (SELECT doc_id, pos, trim(raw) AS line FROM raw WHERE regexp_matches(trim(raw), '[^ \\t\\n\\x0B\\f\\r]')),
u AS (SELECT DISTINCT line FROM l WHERE length(line) >= 16),
w AS (SELECT line, string_split(line, ' ') AS w FROM (SELECT DISTINCT line FROM l) WHERE len(string_split(line, ' ')) >= 10),
k AS (
  SELECT line, hash(0, left(line, j), substr(line, j + 2)) AS key FROM (SELECT line, unnest(range(length(line))) AS j FROM u)
  UNION ALL SELECT line, hash(1, left(line, j), substr(line, j + 1)) FROM (SELECT line, unnest(range(length(line) + 1)) AS j FROM u)
  UNION ALL SELECT line, hash(1, left(line, j), substr(line, j + 2)) FROM (SELECT line, unnest(range(length(line))) AS j FROM u)
  UNION ALL SELECT line, hash(2, w[1:j], w[j + 2:]) FROM (SELECT line, w, unnest(range(len(w))) AS j FROM w)
  UNION ALL SELECT line, hash(3, w[1:j], w[j + 1:]) FROM (SELECT line, w, unnest(range(len(w) + 1)) AS j FROM w)
  UNION ALL SELECT line, hash(3, w[1:j], w[j + 2:]) FROM (SELECT line, w, unnest(range(len(w))) AS j FROM w)),
head AS (SELECT key, min(line) AS a FROM k GROUP BY 1 HAVING min(line) <> max(line)),
link AS (SELECT DISTINCT a, line AS b FROM k JOIN head USING (key) WHERE a <> line),
pair AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS line, a AS other FROM pair UNION SELECT r.line, b.b FROM reach r JOIN pair b ON b.a = r.other),
class AS (SELECT line, min(other) AS root FROM reach GROUP BY 1),
placed AS (SELECT doc_id, pos, coalesce(root, line) AS root FROM l LEFT JOIN class USING (line)),
gone AS (SELECT doc_id, pos FROM placed QUALIFY row_number() OVER (PARTITION BY root ORDER BY doc_id, pos) > 1),
kept AS (SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(raw, chr(10) ORDER BY pos) FILTER (g.pos IS NULL) AS text
  FROM raw LEFT JOIN gone g USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, CAST(coalesce(n_removed, 0) AS INT) AS n_removed,
  CASE WHEN n_removed > 0 THEN coalesce(k.text, '') ELSE d.text END AS text FROM documents d LEFT JOIN kept k USING (doc_id)"""

#: Windows are compared by their hexadecimal bytes.
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS k FROM (SELECT doc_id, h, unnest(range(CAST(n AS BIGINT) - 199)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS e FROM g GROUP BY 1, 2),
cut AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head, max(e) AS last, sum(e - a) AS removed, count(*) AS spans
  FROM cut JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Terms, impacts and scores by joins of integers.
LEXICAL_SEARCH = """WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2, 3),
size AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
q AS (SELECT k, item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT row_number() OVER () AS k, item_id, text FROM benchmark)) GROUP BY 1, 2, 3),
impact AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words))) AS impact
  FROM tf JOIN size USING (r) JOIN w USING (term) CROSS JOIN total WHERE term IN (SELECT term FROM q)),
score AS (SELECT k, item_id, r, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN impact USING (term) GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) <= 10"""

#: Islands of equal words q apart; every run has five words and more beyond its period, so that only places
#: with five equal words meet. crc32 is folded bit by bit: each digit is followed by the shifts of its eight bits.
PERIODIC_RUNS = """WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), CAST([] AS VARCHAR[])) AS w,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d),
o AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE w END AS w FROM e),
wd AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM o),
p AS (SELECT doc_id, n, i, hash(word, lead(word) OVER b, lead(word, 2) OVER b, lead(word, 3) OVER b, lead(word, 4) OVER b) AS five FROM wd WINDOW b AS (PARTITION BY doc_id ORDER BY i) QUALIFY i < n - 4),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.five = y.five AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g, i FROM same),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM island GROUP BY doc_id, q, g HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY 1, 2, 3),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    min_by({'s': start, 'l': length, 'p': period}, (-length, start, period)) AS top FROM run GROUP BY 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(start + period, start + length)))) AS gone FROM run GROUP BY 1),
text AS (SELECT doc_id, array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ') AS text FROM o LEFT JOIN gone USING (doc_id))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length, CAST(top.p AS BIGINT) AS period,
  CAST(1000 * top.l // top.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(text) AS collapsed_sha256
FROM text LEFT JOIN listed USING (doc_id)"""

ORACLES = {
    "op4_line_dedup": LINE_DEDUP,
    "op8_suffix_dedup": SUFFIX_DEDUP,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_periodic_runs": PERIODIC_RUNS,
}
