"""The queries that SQL can express, as DuckDB SQL, written on its own."""

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
), f AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '{WORD}')) AS n FROM l WHERE regexp_matches(line, '{WORD}')
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM f
), w AS (
  SELECT a.doc_id, a.pos AS first, max(b.pos) AS last, string_agg(b.line, chr(10) ORDER BY b.pos) AS content
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - b.n < a.upto - a.n + 50
  GROUP BY a.doc_id, a.pos, a.upto, a.n HAVING max(b.upto) - (a.upto - a.n) >= 50
  UNION
  SELECT a.doc_id, min(b.pos), a.pos, string_agg(b.line, chr(10) ORDER BY b.pos)
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos <= a.pos AND b.upto > a.upto - 50
  GROUP BY a.doc_id, a.pos HAVING sum(b.n) >= 50
), o AS (
  SELECT *, first_value(doc_id) OVER k AS d0, first_value(first) OVER k AS f0, first_value(last) OVER k AS l0
  FROM w WINDOW k AS (PARTITION BY content ORDER BY doc_id, first)
), s AS (
  SELECT doc_id, CASE WHEN doc_id = d0 THEN greatest(first, l0 + 1) ELSE first END AS a, last AS b
  FROM o WHERE NOT (doc_id = d0 AND first = f0)
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM s JOIN l ON l.doc_id = s.doc_id AND l.pos BETWEEN s.a AND s.b
), r AS (
  SELECT l.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(g.pos::VARCHAR, ',' ORDER BY g.pos), '') AS removed_lines,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT doc_id, n_removed, removed_lines, length(kept) AS chars_left, md5(kept) AS text_md5 FROM r
"""

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(r - 1) % 3 + 1] AS weight,
    [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][(r - 1) % 3 + 1] AS tilt, (source_size * 2)::DOUBLE AS cap FROM s
), f AS (
  SELECT *, cap / weight AS level,
    greatest(0.0::DOUBLE, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill
  FROM w
), t AS (
  SELECT *, least(cap, coalesce((SELECT fill FROM f WHERE fill <= level ORDER BY level, r LIMIT 1) * weight, cap)) AS target FROM f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, floor(target + 0.5) - b)) AS one, greatest(0, least(size, floor(target + 0.5) - b - source_size)) AS two FROM p
)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
  CASE WHEN one > 0 THEN least(1.0::DOUBLE, 2 * (b / target) / (1 + tilt + sqrt(greatest(0.0::DOUBLE, (1 + tilt) * (1 + tilt) - 4 * tilt * (b / target))))) END AS position
FROM q
"""

QUALITY_RULES = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), l AS (
  SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d
), f AS (
  SELECT doc_id, source, line, len(regexp_extract_all(line, '{WORD}')) AS n,
    {LOWER.format("array_to_string(regexp_extract_all(line, '" + WORD + "'), ' ')")} AS norm
  FROM l WHERE regexp_matches(line, '{WORD}')
), hosts AS (
  SELECT source, count(DISTINCT t) AS n_of FROM d GROUP BY source
), bad AS (
  SELECT f.source, f.norm FROM f JOIN d USING (doc_id) JOIN hosts h ON h.source = f.source
  GROUP BY f.source, f.norm, h.n_of
  HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) * 100.0 > h.n_of * 0.2
), lost AS (
  SELECT f.doc_id, sum(f.n) AS lost FROM f JOIN bad USING (source, norm) GROUP BY f.doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY doc_id
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(w) - coalesce(lost.lost, 0)::BIGINT AS left_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100.0 * left_words >= 50.0 * n_words AS kept
FROM m
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = f"""regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{TERM}')"""

RESAMPLE = f"""
WITH k AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents
), f AS (SELECT r, unnest(w) AS f FROM d), g AS (SELECT unnest({TERMS}) AS f FROM benchmark
), v AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce(list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT f FROM f UNION SELECT f FROM g), k
), s AS (SELECT bucket, count(*) AS s FROM f JOIN v USING (f) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM g JOIN v USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), w AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN v USING (f) JOIN gain USING (bucket) GROUP BY r
), z AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)
), o AS (
  SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST) AS place FROM z
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= (SELECT count(*) FROM z WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM o
"""

SEARCH = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
n AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
p AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term
), t AS (
  SELECT term, floor(1000 * ln((2 * any_value(n.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, n GROUP BY term
), m AS (SELECT r, doc_id, 10 + (90 * len(w) * n.n) // n.l AS m FROM d, n WHERE len(w) > 0),
s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY item_id, r
), o AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""

ORACLE = {
    "op5_line_dedup": LINE_DEDUP,
    "op6_exact_dedup": EXACT_DEDUP,
    "op7_mixing": MIXING,
    "op10_quality_rules": QUALITY_RULES,
    "op12_importance_resampling": RESAMPLE,
    "op13_ranked_search": SEARCH,
}
