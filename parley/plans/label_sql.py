"""The labelling rules as DuckDB SQL, in the form of plain joins."""

from __future__ import annotations

from parley.functions.scalars import BACKCHANNEL_WORDS

from .fixtures import DUCKDB, TAUS, ctes

NORMAL = r"regexp_replace(regexp_replace(trim(lower(word)), '[^\pL\pN\pM_\s-]', '', 'g'), '[\s-]+', '', 'g')"
LEXICON = ", ".join(f"'{w}'" for w in BACKCHANNEL_WORDS)

SAMPLES = """persp AS (SELECT interaction_id, split, duration_s, file_id_a AS file_id, file_id_b AS other_file_id FROM v_manifest UNION ALL SELECT interaction_id, split, duration_s, file_id_b, file_id_a FROM v_manifest),
grid AS (SELECT *, 2e0 + i * 0.5e0 AS t FROM (SELECT *, unnest(range(0, CAST(floor((duration_s - 1.6e0 - 2e0) / 0.5e0) AS INT) + 1)) AS i FROM persp WHERE duration_s - 1.6e0 > 2e0) g0),
voiced AS (SELECT g.file_id, g.i, v.end_s AS a_end, row_number() OVER (PARTITION BY g.file_id, g.i ORDER BY v.start_s, v.seg_idx) AS r FROM grid g JOIN v_intervals v ON v.file_id = g.file_id AND g.t BETWEEN v.start_s AND v.end_s WHERE g.t <= g.duration_s - 1.6e0),
samples AS (SELECT g.*, a_end FROM grid g JOIN voiced USING (file_id, i) WHERE r = 1)"""

UTTERANCES = f"""st AS (SELECT samples.*, tau_ms, t + tau_ms / 1e3 AS h FROM samples, (SELECT unnest({list(TAUS)}) AS tau_ms)),
u AS (SELECT st.file_id, i, tau_ms, other_file_id, v.seg_idx, greatest(v.start_s, t) AS c_start, least(v.end_s, h) AS c_end FROM st JOIN v_intervals v ON v.file_id = other_file_id AND greatest(v.start_s, t) < least(v.end_s, h)),
flagged AS (SELECT file_id, start_s, CASE WHEN {NORMAL} IN ({LEXICON}) THEN 0 ELSE 1 END AS other FROM v_words),
uw AS (SELECT u.file_id, i, tau_ms, seg_idx, c_start, c_end, (c_end - c_start) * 1e3 AS dur, count(w.start_s) AS n, coalesce(sum(other), 0) AS o FROM u LEFT JOIN flagged w ON w.file_id = u.other_file_id AND w.start_s BETWEEN c_start AND c_end GROUP BY ALL)"""

LABELS = """us AS (SELECT file_id, i, tau_ms, min(CASE WHEN dur >= 700e0 OR n >= 3 OR o > 0 THEN c_start END) AS first_start, bool_or(dur <= 500e0 AND (n <= 2 OR o = 0)) AS bc FROM uw GROUP BY ALL),
flags AS (SELECT st.*, first_start, coalesce(bc, false) AS bc, EXISTS (SELECT 1 FROM v_intervals v WHERE v.file_id = st.file_id AND st.h BETWEEN v.start_s AND v.end_s) AS av, EXISTS (SELECT 1 FROM v_intervals v WHERE v.file_id = st.other_file_id AND st.h BETWEEN v.start_s AND v.end_s) AS bv FROM st LEFT JOIN us USING (file_id, i, tau_ms)),
labels AS (SELECT printf('%s_t_%07d', file_id, CAST(t * 1e3 AS BIGINT)) AS sample_key, interaction_id, file_id, split, CAST(t * 1e3 AS BIGINT) AS t_ms, tau_ms,
  CASE WHEN first_start IS NOT NULL THEN CASE WHEN a_end <= first_start + 0.3e0 THEN 1 WHEN bv THEN 3 WHEN av THEN 4 ELSE 3 END WHEN av AND bc THEN 2 WHEN av THEN 0 ELSE 5 END AS label FROM flags)"""


def with_samples(*more: str) -> str:
    return ctes(["v_manifest", "v_intervals", "v_words", *more], DUCKDB) + ",\n" + SAMPLES


def with_utterances(*more: str) -> str:
    return with_samples(*more) + ",\n" + UTTERANCES


def with_labels(*more: str) -> str:
    return with_utterances(*more) + ",\n" + LABELS
