"""SQL for the queries that SQL can express."""

from __future__ import annotations

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

URL_FILTER = f"""
WITH parts AS (
  SELECT page_id, url,
         {LOWERED.format("coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path,
         string_split(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)(\\?([^#]*))?', 4), ''), '&') AS given
  FROM pages),
kept AS (SELECT *, list_sort([p FOR p IN given IF p <> '' AND NOT starts_with(p, 'utm_')]) AS asked FROM parts),
forms AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || rtrim(path, '/') ||
                 CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical FROM kept),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM forms),
judged AS (
  SELECT *, rule IS NULL AND canonical IS NOT NULL AND canonical IN
         (SELECT canonical FROM forms WHERE regexp_matches(url, '[?&]utm_') AND canonical IS NOT NULL) AS listed
  FROM ruled)
SELECT page_id, host, path, canonical, rule, listed,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""

CHAT_FORMAT = """
WITH turns AS MATERIALIZED (
  SELECT row_number() OVER () AS n, conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id AS of_conv, speaker AS perspective FROM turns WHERE speaker <> 'system'),
seen AS (
  SELECT *, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS shown_role
  FROM turns JOIN people ON conv_id IS NOT DISTINCT FROM of_conv),
headed AS (
  SELECT *, '<|im_start|>' || shown_role || CASE WHEN shown_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM seen),
rendered AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS rendered FROM headed),
placed AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS place, CAST(sum(length(rendered)) OVER w - length(rendered) AS BIGINT) AS start
  FROM rendered
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, md5(speaker || chr(10) || said), n
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, place, turn, speaker, shown_role, rendered, start, start + length(rendered) AS stop,
       CASE WHEN shown_role = 'assistant' THEN start + length(head) END AS trained_start,
       CASE WHEN shown_role = 'assistant' THEN start + length(rendered) END AS trained_stop
FROM placed"""

MIXING = r"""
WITH sized AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM totals),
weighed AS (SELECT *, [5, 2, 1][turn % 3 + 1] AS weight, 3 * source_size AS cap FROM turns),
ordered AS (
  SELECT *, sum(source_size) OVER () AS size_all, sum(weight) OVER () AS weight_all,
         coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM weighed
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stops AS (SELECT *, (size_all - cap_before) * weight > cap * (weight_all - weight_before) AS stopped FROM ordered),
rest AS (
  SELECT *, size_all - coalesce(sum(cap) FILTER (WHERE stopped) OVER (), 0) AS size_open,
         weight_all - coalesce(sum(weight) FILTER (WHERE stopped) OVER (), 0) AS weight_open
  FROM stops),
targets AS (
  SELECT source, source_size,
         CASE WHEN stopped THEN CAST(cap AS DOUBLE)
              ELSE CAST(size_open AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(weight_open AS DOUBLE) END AS target
  FROM rest),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size, n
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized)
SELECT p.doc_id, p.size, t.source_size, t.target,
       CAST(CASE WHEN t.source_size = 0 THEN 0
                 ELSE CAST(floor(t.target) AS BIGINT) // t.source_size * p.size
                      + greatest(0, least(p.size, CAST(floor(t.target) AS BIGINT) % t.source_size - p.before)) END AS BIGINT) AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source"""

QUALITY_RULES = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
word_list AS (SELECT n, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM docs),
words AS (SELECT n, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM word_list),
windows AS (
  SELECT *, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS three FROM words WINDOW w AS (PARTITION BY n ORDER BY pos)),
counted AS (SELECT *, three IS NOT NULL AND count(*) OVER (PARTITION BY n, three) > 1 AS twice FROM windows),
covered AS (
  SELECT *, twice OR coalesce(lag(twice, 1) OVER w, false) OR coalesce(lag(twice, 2) OVER w, false) AS inside
  FROM counted WINDOW w AS (PARTITION BY n ORDER BY pos)),
by_words AS (SELECT n, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE inside) AS n_repeat_words FROM covered GROUP BY n),
lines AS (SELECT n, unnest(string_split(t, chr(10))) AS line FROM docs),
by_lines AS (
  SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n),
measured AS MATERIALIZED (
  SELECT docs.n, doc_id, lang, source, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN by_words ON docs.n = by_words.n LEFT JOIN by_lines ON docs.n = by_lines.n),
values_ AS MATERIALIZED (
  SELECT n, lang, source, rule, value FROM (
    SELECT *, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS rule,
           unnest([1000 * n_symbols // word_chars, 1000 * n_dup_lines // n_lines, 1000 * n_repeat_words // n_words, 10 * word_chars // n_words]) AS value
    FROM measured WHERE n_words > 0)),
sketched AS MATERIALIZED (
  SELECT *, (((value >> cut) + 1) << cut) - 1 AS bucket, CASE WHEN rule IN ('symbols', 'word_length') THEN 850 ELSE 980 END AS tail
  FROM (SELECT *, greatest(length(bin(value)) - 11, 0) AS cut FROM values_)),
of_groups AS (
  SELECT lang, source, rule, any_value(total) AS total, min(bucket) FILTER (WHERE 1000 * upto >= 500 * total) AS middle,
         min(bucket) FILTER (WHERE 1000 * upto >= tail * total) AS high
  FROM (SELECT *, count(*) OVER (PARTITION BY lang, source, rule) AS total,
               row_number() OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS upto FROM sketched)
  GROUP BY lang, source, rule),
of_langs AS (
  SELECT lang, rule, min(bucket) FILTER (WHERE 1000 * upto >= 500 * total) AS middle, min(bucket) FILTER (WHERE 1000 * upto >= tail * total) AS high
  FROM (SELECT *, count(*) OVER (PARTITION BY lang, rule) AS total, row_number() OVER (PARTITION BY lang, rule ORDER BY bucket) AS upto FROM sketched)
  GROUP BY lang, rule),
pulled AS (
  SELECT g.lang, g.source, g.rule, (total * g.middle + 20 * l.middle) // (total + 20) AS middle, (total * g.high + 20 * l.high) // (total + 20) AS high
  FROM of_groups g JOIN of_langs l ON g.lang IS NOT DISTINCT FROM l.lang AND g.rule = l.rule),
limits AS (SELECT *, high + 3 * greatest(high - middle, 1) AS most FROM pulled),
broken AS (
  SELECT DISTINCT n FROM values_ v JOIN limits l
  ON v.lang IS NOT DISTINCT FROM l.lang AND v.source IS NOT DISTINCT FROM l.source AND v.rule = l.rule WHERE v.value > l.most)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n NOT IN (SELECT n FROM broken) AS kept
FROM measured"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

LINE_DEDUP = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT n, doc_id, string_split(t, chr(10)) AS l FROM docs),
lines AS (SELECT n, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
keyed AS MATERIALIZED (SELECT *, {LOWERED.format(f"trim(line, {BLANKS})")} AS k FROM lines),
repeated AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT n) >= 10),
marked AS (SELECT keyed.*, repeated.k IS NOT NULL AS gone FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY n, doc_id"""
