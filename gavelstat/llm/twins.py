"""SQL twins of operators whose results SQL can find by brute force on a small data set."""

from __future__ import annotations

from gavelstat.llm import license_scan, text_rules
from gavelstat.llm.dart_minhash import SHINGLE
from gavelstat.llm.debruijn import WORDS
from gavelstat.llm.suffix_buckets import LENGTH

_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: All pairs of texts that share a shingle, compared in whole numbers; classes by reachability.
NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, {_SPLIT} AS w FROM documents),
s AS (SELECT doc_id, sh, count(*) AS c FROM (SELECT doc_id,
  unnest([array_to_string(w[i : i + {SHINGLE - 1}], ' ') FOR i IN generate_series(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)))]) AS sh
  FROM d) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY ALL),
pairs AS (SELECT x, y FROM shared JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 9 * m >= 4 * (a.n + b.n)
  UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.t = b.t AND a.doc_id < b.doc_id),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other)
SELECT doc_id, min(other) AS class_id, count(*) AS class_size, doc_id = min(other) AS kept FROM reached GROUP BY doc_id"""

#: Every window of words by the digest of its text.
WORD_SEQUENCES = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WORDS - 1})) AS i FROM d WHERE len(w) >= {WORDS}),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {WORDS - 1}], ' ')) AS k FROM places),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM windows JOIN firsts USING (k), (SELECT unnest(range(0, {WORDS})) AS o)
  WHERE doc_id > first_doc),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def text_rules_sql() -> str:
    """Counts by lists, limits by sorted cells."""
    ratios = {name: f"{scale} * {part} // greatest({whole}, 1)" for name, (_, (part, whole, scale), _) in text_rules.RATIOS.items()}
    values = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS metric, {v} AS v FROM m WHERE NOT base_failed" for n, v in ratios.items())
    slack = " ".join(f"WHEN '{n}' THEN {least}" for n, (_, _, least) in text_rules.RATIOS.items())
    inside = " AND ".join(f"bool_and(CASE WHEN metric = '{n}' THEN {v} BETWEEN low AND high ELSE true END)" for n, v in ratios.items())
    quartiles = "l[(len(l) + 3) // 4] AS q25, l[(3 * len(l) + 3) // 4] AS q75, len(l) AS n"
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_SPLIT} AS w FROM documents),
places AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
triples AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS k FROM places),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM triples) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
 WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_lines,
  coalesce(lines.n - lines.u, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(repeats.n, 0) > 50 * len(w) AS base_failed
 FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)),
v AS (SELECT lang, source, metric, CASE WHEN v < 256 THEN v ELSE (v >> (length(bin(v)) - 8)) << (length(bin(v)) - 8) END AS c FROM ({values})),
by_source AS (SELECT lang, source, metric, {quartiles} FROM (SELECT lang, source, metric, list_sort(list(c)) AS l FROM v GROUP BY ALL)),
by_lang AS (SELECT lang, metric, {quartiles} FROM (SELECT lang, metric, list_sort(list(c)) AS l FROM v GROUP BY ALL)),
by_all AS (SELECT metric, {quartiles} FROM (SELECT metric, list_sort(list(c)) AS l FROM v GROUP BY ALL)),
chosen AS (SELECT s.lang, s.source, a.metric,
  CASE WHEN x.n >= {text_rules.GROUP_ROWS} THEN x.q25 WHEN y.n >= {text_rules.GROUP_ROWS} THEN y.q25 ELSE a.q25 END AS q25,
  CASE WHEN x.n >= {text_rules.GROUP_ROWS} THEN x.q75 WHEN y.n >= {text_rules.GROUP_ROWS} THEN y.q75 ELSE a.q75 END AS q75
 FROM (SELECT DISTINCT lang, source FROM v) s, by_all a
  LEFT JOIN by_source x ON x.metric = a.metric AND x.lang IS NOT DISTINCT FROM s.lang AND x.source IS NOT DISTINCT FROM s.source
  LEFT JOIN by_lang y ON y.metric = a.metric AND y.lang IS NOT DISTINCT FROM s.lang),
limits AS (SELECT lang, source, metric, q25 - r AS low, q75 + r AS high
 FROM (SELECT *, greatest({text_rules.REACH} * (q75 - q25), CASE metric {slack} END) AS r FROM chosen))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND coalesce({inside}, false) AS kept
FROM m LEFT JOIN limits ON m.lang IS NOT DISTINCT FROM limits.lang AND m.source IS NOT DISTINCT FROM limits.source
GROUP BY doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed"""


#: Every window of bytes, written in hexadecimal digits, by its digest.
BYTE_STRINGS = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH}),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM places),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
steps AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS new FROM later),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b
 FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM steps) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
 UNION ALL SELECT doc_id, max(b), any_value(n) FROM spans JOIN d USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS t FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS c FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""


def license_sql() -> str:
    """Every word run against every template position; diagonals, merged spans and labels as windows."""
    known = license_scan.templates()
    about = ", ".join(
        f"({n}, '{t.label}', {str(t.phrase).lower()}, {t.runs}, {t.needed}, {len(t.words)}, {0 if t.phrase else license_scan.DRIFT})"
        for n, t in enumerate(known)
    )
    runs = ", ".join(
        f"({n}, {i}, {t.run}, '{' '.join(t.words[i : i + t.run])}')" for n, t in enumerate(known) for i in range(t.runs)
    )
    places = " UNION ALL ".join(
        f"""SELECT doc_id, i - 1 AS place, {k} AS run, array_to_string(w[i : i + {k - 1}], ' ') AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM d WHERE len(w) >= {k})"""
        for k in sorted({t.run for t in known})
    )
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '{license_scan.WORD}') AS w FROM documents),
t(template, label, phrase, runs, needed, size, drift) AS (VALUES {about}),
r(template, position, run, x) AS (VALUES {runs}),
g AS (SELECT doc_id, template, place - position AS diagonal, min(place) AS a, max(place + run) AS b, list(position) AS p
 FROM ({places}) JOIN r USING (run, x) GROUP BY ALL),
n AS (SELECT g.*, t.* EXCLUDE template, CASE WHEN diagonal - lag(diagonal) OVER o > drift THEN 1 ELSE 0 END AS new
 FROM g JOIN t USING (template) WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
m AS (SELECT doc_id, template, label, phrase, runs, needed, size, min(a) AS a, max(b) AS b, len(list_distinct(flatten(list(p)))) AS votes
 FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM n)
 GROUP BY doc_id, template, label, phrase, runs, needed, size, part),
v AS (SELECT *, votes >= needed AND b - a <= {license_scan.STRETCH} * size AS ok FROM m),
s AS (SELECT doc_id, count(*) FILTER (ok AND phrase) AS n_base, min(a) FILTER (ok AND phrase) AS first_word,
 max(a) FILTER (ok AND phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok AND phrase) AS base_labels,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS labels, max(votes / runs) AS score FROM v GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
 CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
 coalesce(score, 0.0) AS score FROM d LEFT JOIN s USING (doc_id)"""
