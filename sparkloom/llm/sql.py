"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

NEAR = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, hash(sh) AS sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w
    )
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), l AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r AS (
    SELECT a AS doc_id, a AS seen FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen
), c AS (
    SELECT doc_id, min(seen) AS c FROM r GROUP BY 1
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(c.c, w.doc_id), w.doc_id) AS component_id, coalesce(c.c, w.doc_id) >= w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

WARC = f"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), b AS (
    SELECT *, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', h[i]) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM p
)
SELECT page_id, n AS payload_bytes,
    list_reduce(list_transform(range(0, 32), lambda i: substr('{BASE32}', 1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), lambda x, y: x || y) AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id < top THEN top END AS refers_to
FROM b
"""

RULES = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), hit AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), cover AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, range(0, 8) t(k) GROUP BY 1
), x AS (
    SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
        len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
        len(list_filter(w, lambda y: ends_with(y, '!'))) AS marks, len(list_distinct(w)) AS distinct_words,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same
    FROM d LEFT JOIN cover c USING (doc_id)
), y AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT 10 * n_symbols > n_words AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND NOT 2 * upper > letters
    AND NOT 10 * marks > 3 * n_words AND NOT 10 * n_dup_lines > 3 * n_lines AND NOT 10 * same > 2 * n_words
    AND NOT (n_words >= 50 AND n_words <= 2000 AND 10 * distinct_words < n_words) AS kept
FROM y
"""

REPEATS = """
WITH d AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
    SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)
), s AS (
    SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), g AS (
    SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s
), r AS (
    SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, g
), q AS (
    SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM r
), c AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
    FROM q JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

URLS = r"""
WITH u AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
    SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), q AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
        list_distinct(list_filter(regexp_split_to_array(host || '/' || path, '[^\p{L}\p{N}]+'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '\p{N}+'))) AS tokens FROM p
), v AS (
    SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS known FROM q
), t AS (
    SELECT page_id, coalesce(known = 'block', false) AS bad, unnest(tokens) AS t FROM v
), m AS (
    SELECT ceil(0.005 * count(DISTINCT page_id)) AS least FROM t
), one AS (
    SELECT t AS a, '' AS b, '' AS c FROM t GROUP BY 1 HAVING count(*) FILTER (bad) >= (SELECT least FROM m) AND count(*) FILTER (bad) >= 0.9 * count(*)
), two AS (
    SELECT x.t AS a, y.t AS b, '' AS c FROM t x JOIN t y ON x.page_id = y.page_id AND x.t < y.t GROUP BY 1, 2
    HAVING count(*) FILTER (x.bad) >= (SELECT least FROM m) AND count(*) FILTER (x.bad) >= 0.9 * count(*)
), three AS (
    SELECT x.t AS a, y.t AS b, z.t AS c FROM t x JOIN t y ON x.page_id = y.page_id AND x.t < y.t JOIN t z ON z.page_id = y.page_id AND y.t < z.t GROUP BY 1, 2, 3
    HAVING count(*) FILTER (x.bad) >= (SELECT least FROM m) AND count(*) FILTER (x.bad) >= 0.9 * count(*)
), rules AS (
    SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three
)
SELECT page_id, host, path, rule, CASE WHEN known IS NOT NULL THEN known
    WHEN EXISTS (SELECT 1 FROM rules WHERE list_contains(tokens, a) AND (b = '' OR list_contains(tokens, b)) AND (c = '' OR list_contains(tokens, c))) THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""

ORACLES: dict[str, str] = {"op1_near_dedup": NEAR, "op5_warc": WARC, "op6_quality_rules": RULES, "op7_suffix_dedup": REPEATS, "op8_url_filters": URLS}
