"""SQL (DuckDB) for the rows of the operators that SQL can express."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"'[^\x20\x09-\x0D]+'"
TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(list_slice(w, k + 1, k + 35), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS k FROM d WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
kept AS (SELECT e.doc_id, count(g.p) AS n, string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), {WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, k + 1, k + 5), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
walk AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a = w.b),
least AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, l.component_id FROM d LEFT JOIN n USING (doc_id) JOIN least l ON l.a = d.doc_id
"""

BENCHMARK = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), {TERM}) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), {TERM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, array_to_string(list_slice(w, k + 1, k + 10), ' ') AS s, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k + 1, k + n), ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, k, n, item FROM dw JOIN iw USING (s, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id),
-- proximity: all words of a window within 15 words, looked for around each occurrence of its rarest word
c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
ws AS (SELECT s, list_distinct(string_split(s, ' ')) AS need FROM (SELECT DISTINCT s FROM iw)),
piv AS (SELECT s, any_value(need) AS need, arg_min(word, (coalesce(c.n, 0), word)) AS word FROM (SELECT s, need, unnest(need) AS word FROM ws) LEFT JOIN c USING (word) GROUP BY s),
pos AS (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
cand AS (SELECT doc_id, s, need, p - greatest(1, p - 14) AS before, list_slice(w, greatest(1, p - 14), p + 14) AS around FROM pos JOIN piv USING (word)),
close AS (SELECT DISTINCT doc_id, s FROM cand WHERE list_has_all(around, need)
          AND len(list_filter(range(before + 1), lambda a: list_has_all(list_slice(around, a + 1, a + 15), need))) > 0),
nt AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near FROM (SELECT DISTINCT doc_id, item FROM close JOIN iw USING (s)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, CAST(coalesce(nt.n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(nt.near, '')) AS near_sha256
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nt USING (doc_id)
"""

SUFFIX = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
win AS (SELECT doc_id, k, md5(substr(x, 2 * k + 1, 800)) AS s FROM (SELECT doc_id, x, unnest(range(n - 399)) AS k FROM n WHERE n >= 400)),
rep AS (SELECT doc_id, k FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
-- runs of removed bytes: a window starts a run if none of the 400 starts before it, or of the one right before, repeats
marked AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 400 THEN 0 ELSE 1 END AS first FROM rep),
runs AS (SELECT doc_id, min(k) AS a, max(k) + 400 AS b FROM (SELECT doc_id, k, sum(first) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM marked) GROUP BY doc_id, r),
edges AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS t, max(b) AS last FROM edges JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.t, '') || substr(n.x, 2 * coalesce(k.last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN kept k USING (doc_id)
"""

#: CRC-32 of a string's bytes by the table of its polynomial, made here; the sums are per distinct word.
IMPORTANCE = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), {TERM}) AS w FROM documents),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), {TERM})) AS word FROM benchmark) GROUP BY word),
words AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
crc AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
        lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM words, tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN crc USING (word) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS BIGINT) AS g FROM s FULL JOIN t USING (bucket), total),
weight AS (SELECT r, sum(n * g) AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN weight USING (r)),
all_rows AS (SELECT doc_id, r, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
place AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM all_rows WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM all_rows LEFT JOIN place USING (r)
"""

NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.alike AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.a, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10
"""
