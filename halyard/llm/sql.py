"""DuckDB SQL of the corpus queries that SQL can express.

Near duplicates, pseudonyms, packing and the pipeline have none; tests/llm
holds them against brute-force versions.
"""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_SPACE = r"'[\x20\x09-\x0D]+'"


def _unit(seed: str, value: str) -> str:
    return f"('0x' || substr(md5('{seed}/' || coalesce(CAST({value} AS VARCHAR), '')), 1, 13))::BIGINT"


OP1 = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size,
         {_unit('mix', 'doc_id')} AS k
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT) AS w
  FROM base GROUP BY source),
running AS (
  SELECT source, s, w, 3 * s AS cap, row_number() OVER o AS r,
         CAST(coalesce(sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cap_before,
         CAST(coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_before,
         CAST((SELECT sum(s) FROM sizes) AS BIGINT) AS total, CAST((SELECT sum(w) FROM sizes) AS BIGINT) AS ws
  FROM sizes WINDOW o AS (ORDER BY CAST(3 * s AS DOUBLE) / w, source IS NULL, source)),
levels AS (SELECT *, CAST(total - cap_before AS DOUBLE) / (ws - w_before) AS level FROM running),
ends AS (SELECT min(r) AS r FROM levels WHERE level * w < cap),
plan AS (
  SELECT source, s, CASE WHEN (SELECT r FROM ends) IS NULL OR r < (SELECT r FROM ends) THEN CAST(cap AS DOUBLE)
         ELSE (SELECT level FROM levels WHERE r = (SELECT r FROM ends)) * w END AS target
  FROM levels),
parts AS (
  SELECT *, least(CAST(floor(CASE WHEN s > 0 THEN target / s ELSE 0 END) AS BIGINT), 3) AS whole,
         CASE WHEN s > 0 THEN target / s ELSE 0 END AS ratio FROM plan),
ranked AS (
  SELECT b.doc_id, b.source, b.size, p.s, p.target, p.whole, p.target - p.whole * p.s AS budget, ratio - whole AS p,
         CASE WHEN ratio - whole > 0 THEN
           (((k + 0.5) / 4503599627370496.0) / (1 - (k + 0.5) / 4503599627370496.0))
           / ((ratio - whole) / (1 - (ratio - whole))) END AS q
  FROM base b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source),
cand AS (
  SELECT doc_id, source, size, budget, row_number() OVER (PARTITION BY source ORDER BY q, doc_id) AS n
  FROM ranked WHERE q IS NOT NULL AND size > 0),
walk AS (
  SELECT source, budget, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS words, CAST(NULL AS BIGINT) AS doc_id, FALSE AS picked
  FROM (SELECT DISTINCT source, budget FROM ranked)
  UNION ALL
  SELECT w.source, w.budget, c.n, w.words + CASE WHEN w.words + c.size <= w.budget THEN c.size ELSE 0 END, c.doc_id,
         w.words + c.size <= w.budget
  FROM walk w JOIN cand c ON c.source IS NOT DISTINCT FROM w.source AND c.n = w.n + 1),
lacks AS (SELECT source, budget - max(words) AS lack FROM walk GROUP BY source, budget),
drawn AS (
  SELECT r.*, l.lack, EXISTS (SELECT 1 FROM walk w WHERE w.picked AND w.doc_id = r.doc_id) AS picked
  FROM ranked r JOIN lacks l ON l.source IS NOT DISTINCT FROM r.source),
fits AS (
  SELECT *, NOT picked AND q IS NOT NULL AND abs(lack - size) < abs(lack) AND row_number() OVER (PARTITION BY source
         ORDER BY picked OR q IS NULL, abs(lack - size), q, doc_id) = 1 AS fit FROM drawn)
SELECT doc_id, size, s AS source_size, target,
       CAST((whole + CASE WHEN picked OR fit THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM fits
"""

_KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type")

OP2 = r"""
WITH base AS (
  SELECT page_id AS k, url, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || CAST(page_id % 97 AS VARCHAR) AS day,
         sha1(coalesce(html, '')) AS sum, CAST(length(coalesce(html, '')) AS BIGINT) AS n FROM pages),
recs AS (
  SELECT k * 4 AS record_id, url, k * 10 AS ts, 1 AS full_, tag AS etag, day AS modified, sum, n,
         CAST(NULL AS VARCHAR) AS cache, CAST(NULL AS VARCHAR) AS seen FROM base
  UNION ALL SELECT k * 4 + 1, CASE WHEN contains(url, '#') THEN url ELSE url || '#again' END, k * 10 + 5, 0,
         CASE k % 4 WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag WHEN 3 THEN '"stale"' END,
         CASE WHEN k % 4 = 2 THEN day END, NULL, NULL, 'max-age=' || CAST(k % 7 AS VARCHAR), CAST(k AS VARCHAR) FROM base
  UNION ALL SELECT k * 4 + 2, url, k * 10 - 5, 0, tag, NULL, NULL, NULL, NULL, 'early' FROM base WHERE k % 5 = 0),
cut AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '#.*$', '') AS rest FROM recs),
canon AS (
  SELECT * EXCLUDE (rest), regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.|:(80|443)$', '', 'g')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
         || CASE WHEN regexp_extract(rest, '\?(.*)$', 1) <> '' THEN '?' || array_to_string(list_sort(list_filter(
              string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '')), '&') ELSE '' END AS canonical_url
  FROM cut),
found AS (
  SELECT v.record_id, v.canonical_url, v.ts, v.etag, v.modified, v.cache, v.seen, v.full_,
         max(r.ts * 10000000000 + r.record_id) AS best
  FROM canon v LEFT JOIN canon r ON r.full_ = 1 AND r.canonical_url = v.canonical_url AND r.ts < v.ts
  WHERE v.full_ = 0 GROUP BY ALL),
checked AS (
  SELECT f.*, r.record_id AS response_id, r.ts AS response_ts, r.sum, r.n, r.etag AS tag,
         CASE WHEN r.record_id IS NULL THEN 'no_response'
              WHEN f.etag IS NOT NULL THEN CASE WHEN regexp_replace(f.etag, '^W/', '') = r.etag THEN 'resolved' ELSE 'mismatch' END
              WHEN f.modified IS NOT NULL THEN CASE WHEN f.modified = r.modified THEN 'resolved' ELSE 'mismatch' END
              ELSE 'no_validator' END AS status
  FROM found f LEFT JOIN canon r ON r.full_ = 1 AND r.record_id = f.best % 10000000000)
SELECT record_id, canonical_url, ts, status, response_id, response_ts,
       CASE WHEN status = 'resolved' THEN sum END AS digest, CASE WHEN status = 'resolved' THEN n END AS n_chars,
       CASE WHEN status = 'resolved' THEN 'cache-control=' || coalesce(cache, 'max-age=60') || ';content-length='
         || CAST(n AS VARCHAR) || ';content-type=text/html;etag=' || tag || ';x-seen=' || seen END AS headers
FROM checked
"""

OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(17 + length(role) + length(text) + length(regexp_replace(text, '[^<\\]', '', 'g'))) AS BIGINT)
         AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP4 = f"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_SPACE}, ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM norm
"""

# CRC-32 is not in DuckDB, so the Spark query's checksum column is recomputed
# in tests/llm; the SQL for op6 lists the other columns of the same rows.
OP6_LAYOUT = f"""
WITH rows_ AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {_unit('shard', 'doc_id')} AS k FROM documents),
cum AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
               sum(size) OVER () AS total FROM rows_),
put AS (SELECT *, CAST(least(23, (CAST(2 * upto - size AS HUGEINT) * 24) // (2 * CAST(total AS HUGEINT))) AS INTEGER) AS shard FROM cum)
SELECT doc_id, size, shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS slot FROM put
"""

OP8 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, {_WORD}) AS w FROM docs),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM spots WHERE i + 2 <= len(w)),
marked AS (
  SELECT DISTINCT doc_id, i + d AS i FROM windows, (VALUES (0), (1), (2)) o(d) WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM marked GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n
  FROM lines WHERE len(regexp_extract_all(line, {_WORD})) > 0 GROUP BY doc_id),
base AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, {_SPACE}, '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM words LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM base
"""

# The pages of the given tables: one article each, with p, h1, b and br.
OP9 = r"""
WITH raw AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h[1-6]|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM raw),
decoded AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'),
         '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM plain),
done AS (SELECT page_id, url, trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM done
"""

SQL: dict[str, str] = {
    "op1_pareto_mix": OP1, "op2_warc_revisits": OP2, "op3_chat_format": OP3, "op4_exact_dedup": OP4,
    "op8_quality_cascade": OP8, "op9_html_suffix_array": OP9}
