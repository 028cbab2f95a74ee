"""SQL for operators that are longer to say in SQL than their own modules should hold."""

from __future__ import annotations

#: Base counts, then the choice of cutoffs: exact binomial tails on the grid, the unbroken run of accepted candidates, the most lenient of good gain.
OP4 = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
many AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM win JOIN many USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
sig AS (
  SELECT *, unnest([
    {'s': 'symbols', 'v': coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0)}, {'s': 'lines', 'v': coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0)},
    {'s': 'repeats', 'v': coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0)}, {'s': 'long_words', 'v': coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0)},
    {'s': 'short_words', 'v': -coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0)}], recursive := true) FROM m),
grid AS (
  SELECT s, i, round(CASE s WHEN 'long_words' THEN 80 * pow(0.93::DOUBLE, i) WHEN 'short_words' THEN -0.1::DOUBLE * pow(1.1::DOUBLE, i) ELSE 1 - (i + 1) / 40.0::DOUBLE END, 6) AS cut
  FROM (SELECT unnest(['symbols', 'lines', 'repeats', 'long_words', 'short_words']) AS s), (SELECT unnest(range(40)) AS i)),
held AS (SELECT sig.*, quality = 1 AS good FROM sig JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
beyond AS (
  SELECT lang, grid.s, i, cut, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS bad, count(*) FILTER (good AND v > cut) AS k, count(*) FILTER (NOT good AND v > cut) AS b
  FROM held JOIN grid ON grid.s = held.s GROUP BY ALL),
tested AS (
  SELECT *, k < n AND k <= 0.01::DOUBLE * n AND list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.01::DOUBLE) + (n - j) * ln(0.99::DOUBLE)))) <= 0.05::DOUBLE / (5 * (SELECT count(DISTINCT coalesce(lang, '')) FROM held)) AS ok
  FROM beyond),
run AS (SELECT *, b / greatest(bad, 1)::DOUBLE - 5.0::DOUBLE * k / n AS gain FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, s ORDER BY i) AS still FROM tested) WHERE still),
chosen AS (SELECT lang, s, arg_min(cut, i) AS cut FROM (SELECT *, max(gain) OVER (PARTITION BY lang, s) AS best FROM run) WHERE best >= 0.02::DOUBLE AND gain >= best - 0.02::DOUBLE GROUP BY ALL),
out AS (SELECT DISTINCT doc_id FROM sig JOIN chosen ON sig.s = chosen.s AND sig.lang IS NOT DISTINCT FROM chosen.lang AND v > cut)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND out.doc_id IS NULL AS kept
FROM m LEFT JOIN out USING (doc_id)
"""
#: All pairs that share a shingle, and the components of those that are similar enough.
OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE 'all: ' || array_to_string(w, ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS id, a AS r FROM s UNION SELECT reach.id, s.b FROM reach JOIN s ON s.a = reach.r)
SELECT doc_id, coalesce((SELECT min(r) FROM reach WHERE id = doc_id), doc_id) AS class_id FROM documents
"""
#: The pages at hand mark their content by one element.
OP10 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, string_split_regex(t, '</?(?:p|h1)\b[^>]*(?:>|$)') AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    replace(regexp_replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*(>|$)', '', 'g'), '&quot;', '"'), '&amp;?', chr(1), 'g'), chr(1), '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10)))::BIGINT AS n_chars FROM c
"""
