"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import decontam, mixing, quality, search

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {decontam.WINDOW}) AS n, array_to_string(w[i:i + {decontam.WINDOW} - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {decontam.WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, n)) AS p FROM m) GROUP BY 1),
o AS (SELECT doc_id, list_sort(list_distinct(list(item_id))) AS items FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)"""

_CELLS = " UNION ALL ".join(f"SELECT stratum, '{rule}' AS rule, cutoff, count(*) AS n, count(*) FILTER ({rule} > cutoff) AS k FROM good, (SELECT unnest([{', '.join(f'{c}e0' for c in grid)}]) AS cutoff) GROUP BY ALL" for rule, grid in quality.GRIDS.items())
_OVER = " OR ".join(f"coalesce({rule} > (SELECT cutoff FROM cuts c WHERE c.rule = '{rule}' AND c.stratum = s.stratum), false)" for rule in quality.GRIDS)
QUALITY = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8))),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest(range(0, 8)) AS p FROM g WHERE c > 1) GROUP BY 1),
f AS (SELECT doc_id, lang, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS DOUBLE) / greatest(length(regexp_replace(t, '[^A-Za-z]', '', 'g')), 1) AS upper_share FROM w LEFT JOIN r USING (rid)),
s AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS stratum, CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) AS symbols_per_word, CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS dup_line_share, CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1) AS repeat_share,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
good AS (SELECT s.* FROM s JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY 1) l USING (doc_id) WHERE q = 1),
cells AS ({_CELLS}),
p AS (SELECT *, CASE WHEN k >= n * {quality.ALPHA}e0 THEN 1e0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality.ALPHA}e0) + (n - j) * ln(1e0 - {quality.ALPHA}e0)))) END AS p FROM cells),
q AS (SELECT *, min(CASE WHEN p <= {quality.DELTA}e0 / ((SELECT count(DISTINCT stratum) FROM good) * {len(quality.GRIDS)}) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS so_far FROM p),
cuts AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM q WHERE so_far = 1 GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_OVER}) AS kept FROM s"""

MIXING = f"""WITH RECURSIVE r AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + {mixing.OVERHEAD} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mixing' || md5(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT *, CAST(floor(before / {mixing.BLOCK_BYTES}e0) AS BIGINT) AS block FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)),
s AS (SELECT source, sqrt(CAST(sum(size) AS DOUBLE) + 1) AS root FROM r GROUP BY 1),
n AS (SELECT count(*) AS n, sum(root) AS total, greatest({mixing.PERIOD}, 2 * count(*)) AS period FROM s),
i AS (SELECT source, root / total * (period - n.n) AS ideal, floor(root / total * (period - n.n)) AS whole, period, n.n FROM s, n),
w AS (SELECT source, CAST(1 + whole + CASE WHEN row_number() OVER (ORDER BY ideal - whole DESC, source NULLS FIRST) <= period - n - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS weight, period FROM i),
l AS (SELECT list(source ORDER BY source NULLS FIRST) AS src, list(weight ORDER BY source NULLS FIRST) AS w, any_value(period) AS period FROM w),
e AS (SELECT 0 AS t, list_transform((SELECT w FROM l), lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS best, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS slot
  UNION ALL SELECT t + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = best2 THEN 1 ELSE 0 END), best2, done[best2], t FROM (SELECT e.t, done, list_min(list_transform(range(1, len(done) + 1), lambda i: CASE WHEN done[i] < w[i] AND (done[i] * period) // w[i] <= e.t THEN (((done[i] + 1) * period + w[i] - 1) // w[i]) * 1000000 + i END)) % 1000000 AS best2 FROM e, l WHERE e.t < period)),
plan AS (SELECT src[best] AS source, w[best] AS weight, k, slot, period FROM e, l WHERE slot IS NOT NULL),
m AS (SELECT b.doc_id, b.source, weight, block, (block // weight) * period + slot AS slot, before FROM b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source AND b.block % p.weight = p.k)
SELECT doc_id, source, weight, block, slot, row_number() OVER (ORDER BY slot, before, doc_id) - 1 AS position FROM m"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS n_all, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
i AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY t, n_all),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all)))) AS BIGINT) AS score FROM i JOIN p USING (t) JOIN f USING (t), c GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= {search.TOP}"""
