"""DuckDB SQL for the contracts that SQL can express on whole tables."""

from __future__ import annotations

_SPACE = r"\x20\x09-\x0D"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')"
_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents"

OP5 = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS k FROM places),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM ({_LINES}) WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines FROM w LEFT JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN rep r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
passed AS (SELECT w.doc_id, text, w FROM w JOIN b USING (doc_id) WHERE NOT base_failed),
marks AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^[{_SPACE}]*[-*\u2022]')) AS bullets, count(*) FILTER (WHERE regexp_matches(line, '([.][.][.]|\u2026)[{_SPACE}]*$')) AS ellipses FROM ({_LINES}) WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY doc_id),
four AS (SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM passed)),
top AS (SELECT doc_id, max(n) AS chars FROM (SELECT doc_id, count(*) * (length(k) - 3) AS n FROM four GROUP BY doc_id, k HAVING count(*) > 1) GROUP BY doc_id),
five AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM passed)),
many AS (SELECT doc_id, k FROM five GROUP BY doc_id, k HAVING count(*) > 1),
runs AS (SELECT doc_id, sum(length(w[j])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS j FROM five JOIN many USING (doc_id, k)) JOIN passed USING (doc_id) GROUP BY doc_id),
m AS (SELECT p.doc_id, list_count([1 FOR x IN p.w IF regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]')]) AS letters, list_max([length(x) FOR x IN p.w]) AS longest, contains({_LOWER.format("text")}, 'lorem ipsum') AS lorem, coalesce(bullets, 0) AS bullets, coalesce(ellipses, 0) AS ellipses, coalesce(t.chars, 0) AS top_chars, coalesce(r.chars, 0) AS run_chars
FROM passed p LEFT JOIN marks ON marks.doc_id = p.doc_id LEFT JOIN top t ON t.doc_id = p.doc_id LEFT JOIN runs r ON r.doc_id = p.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
coalesce(NOT base_failed AND 10 * n_symbols <= n_words AND 100 * n_dup_lines <= 60 * n_lines AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND 100 * bullets <= 90 * n_lines AND 100 * ellipses <= 30 * n_lines
AND 100 * letters >= 80 * n_words AND longest <= 1000 AND NOT lorem AND 100 * top_chars <= 16 * word_chars AND 100 * run_chars <= 30 * word_chars, false) AS kept FROM b LEFT JOIN m ON m.doc_id = b.doc_id"""

OP7 = f"""WITH k AS (SELECT doc_id, line, pos, {_LOWER.format(f"regexp_replace(regexp_replace(line, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')")} AS key FROM ({_LINES})),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(b.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad b ON b.key = k.key GROUP BY doc_id"""

OP8 = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS k FROM places),
least_of AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_of USING (k) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE g.p IS NULL) AS t FROM word LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, [{_LOWER.format("x")} FOR x IN {_WORDS}] AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM places),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.size + q.size - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(size, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.x = w.doc_id"""
