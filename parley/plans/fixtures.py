"""Inputs for the registered queries, derived from the driver's tables.

One SQL text per fixture, for Spark and for DuckDB; the two dialects differ only in the words of
``Dialect``. Times are integer milliseconds, divided by 1e3 last, so both engines hold the same
doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    name: str

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.name == "spark" else f"({a} // {b})"

    def fmt(self, pattern: str, *args: str) -> str:
        return f"{'format_string' if self.name == 'spark' else 'printf'}('{pattern}', {', '.join(args)})"

    def upto(self, last: str) -> str:
        """A row for each of 0..last; last must not be negative."""
        return f"explode(sequence(0, CAST({last} AS INT)))" if self.name == "spark" else f"unnest(range(0, CAST({last} AS INT) + 1))"

    def pick(self, items: list[str], index: str) -> str:
        body = ", ".join(items)
        return f"element_at(array({body}), CAST({index} AS INT) + 1)" if self.name == "spark" else f"([{body}])[CAST({index} AS INT) + 1]"

    def at(self, array: str, index: str) -> str:
        """Element ``index`` (from 0) of an array column."""
        return f"{array}[CAST({index} AS INT)]" if self.name == "spark" else f"{array}[CAST({index} AS INT) + 1]"

    def day(self, ts: str) -> str:
        return f"day({ts})"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")

# Fixed values of the fixture definitions.
TAUS = (100, 200, 400, 500, 800, 1600)
TOKENS = ("Yeah,", "Mm-hmm!", "ok", "really?", "think", "uh huh")
HOURS_OF_GAPS = (-800, -200, 100, 400, 1500)


def ctes(names: list[str], d: Dialect) -> str:
    """``WITH`` list of the named fixtures and what they need."""
    texts = _texts(d)
    order: list[str] = []

    def need(n: str) -> None:
        for m in texts[n][0]:
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{texts[n][1]}\n)" for n in order)


def _texts(d: Dialect) -> dict[str, tuple[list[str], str]]:
    file_id = d.fmt("V00_S%04d_I%08d_%s", "conv_id", "conv_id", "pid")
    gap = "CASE (conv_id * 5 + turn) % 5 " + " ".join(f"WHEN {i} THEN {g}" for i, g in enumerate(HOURS_OF_GAPS)) + " END"
    token = d.pick([f"'{t}'" for t in TOKENS], "(conv_id * 31 + turn * 17 + i * 7) % 6")
    tau = d.pick([str(t) for t in TAUS], "event_id % 6")
    return {
        "v_turns": (
            [],
            f"""SELECT conv_id, turn, pid, file_id, n_words, dur_ms, CAST(clock - CASE WHEN is_short THEN 1500 ELSE 0 END AS BIGINT) AS start_ms FROM (
  SELECT *, 2500 + coalesce(sum(CASE WHEN is_short THEN 0 ELSE dur_ms + gap_ms END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clock FROM (
    SELECT *, CASE WHEN is_short THEN 100 + 200 * n_words ELSE 250 * n_words END AS dur_ms FROM (
      SELECT conv_id, turn, pid, is_short, {file_id} AS file_id, CASE WHEN is_short THEN 1 + (conv_id + turn) % 3 ELSE 4 + len % 30 END AS n_words, {gap} AS gap_ms FROM (
        SELECT conv_id, turn, CASE role WHEN 'user' THEN 'P0001' ELSE 'P0002' END AS pid, (conv_id * 7 + turn * 3) % 4 = 0 AS is_short, length(text) AS len
        FROM conversations WHERE role IN ('user', 'assistant')) t0) t1) t2) t3""",
        ),
        "v_intervals": (["v_turns"], "SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, turn) AS seg_idx, start_ms / 1e3 AS start_s, (start_ms + dur_ms) / 1e3 AS end_s FROM v_turns"),
        "v_words": (["v_turns"], f"SELECT file_id, {token} AS word, (start_ms + i * {d.div('dur_ms', 'n_words')}) / 1e3 AS start_s, (start_ms + (i + 1) * {d.div('dur_ms', 'n_words')}) / 1e3 AS end_s FROM (SELECT *, {d.upto('n_words - 1')} AS i FROM v_turns) w"),
        "v_manifest": (
            ["v_turns"],
            f"""SELECT {d.fmt('V00_S%04d_I%08d', 'conv_id', 'conv_id')} AS interaction_id, {d.fmt('V00_S%04d_I%08d_P0001', 'conv_id', 'conv_id')} AS file_id_a, {d.fmt('V00_S%04d_I%08d_P0002', 'conv_id', 'conv_id')} AS file_id_b,
  'P0001' AS participant_a, 'P0002' AS participant_b, CASE WHEN conv_id % 20 < 14 THEN 'train' WHEN conv_id % 20 < 17 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN conv_id % 5 = 0 THEN 'familiar' ELSE 'stranger' END AS relationship, CASE WHEN conv_id % 5 = 0 THEN 'friends' ELSE 'stranger' END AS relationship_detail, 'naturalistic' AS label, 'V00' AS vendor_id,
  conv_id, CAST(ceil(max(start_ms + dur_ms) / 1e3) AS DOUBLE) + 2e0 AS duration_s FROM v_turns GROUP BY conv_id""",
        ),
        "e_pairs": (
            [],
            f"""SELECT {d.div('a.vec_id', '2')} AS window_id, {d.fmt('F%02d', d.div('a.vec_id', '2') + ' % 10')} AS file_id, 0.5e0 * {d.div('a.vec_id', '2')} AS start_s, 0.5e0 * {d.div('a.vec_id', '2')} + 2e0 AS end_s, a.label % 3 AS label, a.embedding AS sx, b.embedding AS lx
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""",
        ),
        "e_frames": (
            ["e_pairs"],
            f"""SELECT window_id, frame, feature, CAST({d.at('sx', 'frame * 2 + feature')} AS DOUBLE) AS x, CAST({d.at('lx', 'frame * 2 + feature')} AS DOUBLE) AS y
FROM (SELECT window_id, sx, lx, {d.div('j', '2')} AS frame, j % 2 AS feature FROM (SELECT window_id, sx, lx, {d.upto('63')} AS j FROM e_pairs) e0) e1""",
        ),
        "c_preds": (
            [],
            f"""SELECT event_id, CAST(floor(value) AS BIGINT) % 3 AS label, CASE WHEN event_id % 4 = 0 THEN (CAST(floor(value) AS BIGINT) % 3 + 1) % 3 ELSE CAST(floor(value) AS BIGINT) % 3 END AS pred, {tau} AS tau_ms,
  CAST(user_id AS VARCHAR(20)) AS interaction_id, CAST(user_id AS VARCHAR(20)) || '_' || event_type AS speaker, event_type AS relationship, event_type || CAST(user_id % 3 AS VARCHAR(20)) AS relationship_detail, event_type AS experiment, {d.day('ts')} AS day, value
FROM events WHERE event_type <> 'error' OR {tau} = 400""",
        ),
        "g_edges": (
            [],
            """SELECT c_custkey AS src, coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey), c_custkey) AS dst FROM customer""",
        ),
        "t_assets": (
            ["v_manifest", "v_files"],
            """SELECT file_id, conv_id, CASE WHEN conv_id % 11 = 0 THEN 0 ELSE 1000 + conv_id END AS bytes, CASE WHEN conv_id % 13 = 0 THEN 199 ELSE 200 END AS t, CASE WHEN conv_id % 17 = 0 THEN 255 ELSE 256 END AS d FROM v_files WHERE conv_id % 7 <> 0""",
        ),
        "v_files": (["v_manifest"], "SELECT conv_id, interaction_id, file_id_a AS file_id, split FROM v_manifest UNION ALL SELECT conv_id, interaction_id, file_id_b AS file_id, split FROM v_manifest"),
    }


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "embeddings")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture over the tables in ``sf_dir``."""
    text = f"{ctes([name], SPARK)} SELECT * FROM {name}"
    used = {}
    for t in TABLES:
        if f"FROM {t} " in text + " " or f"FROM {t}\n" in text or f"FROM {t})" in text or f"JOIN {t} " in text or f"FROM {t} a" in text:
            used[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for t in used:
        for before in ("FROM ", "JOIN "):
            for after in (" ", "\n", ")"):
                text = (text + " ").replace(f"{before}{t}{after}", f"{before}{{{t}}}{after}")
    # braces are only the table arguments: no fixture text has any of its own
    return spark.sql(text.strip(), **used)
