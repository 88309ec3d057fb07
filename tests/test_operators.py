"""Properties, edge cases and round trips of the conversation operators."""

import json
import pathlib
import random
import shutil
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from parley.functions import scalars as S
from parley.operators import audit, filters, graphs, metrics, models, reports, signals, splits
from parley.plans import registry
from parley.sources import readers, sinks

from .helpers import rows as plain_rows
from .helpers import tables


def one(df):
    return df.collect()[0]


# --- metrics ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def preds(spark):
    r = random.Random(1)
    return spark.createDataFrame([(r.randrange(3), r.randrange(3), r.choice("xyz")) for _ in range(400)], "label int, pred int, g string").cache()


def test_confusion_sums_and_support(preds):
    cm = metrics.confusion_matrix(preds).collect()
    assert sum(r.pred_0 + r.pred_1 + r.pred_2 for r in cm) == 400
    for r in metrics.per_class_metrics(preds).collect():
        assert r.tp + r.fn == r.support


def test_balanced_accuracy_is_macro_recall(preds):
    a = one(metrics.accuracy_balanced(preds))
    m = one(metrics.macro_metrics(metrics.per_class_metrics(preds)))
    assert a.balanced_accuracy == pytest.approx(m.macro_recall)
    assert a.accuracy == pytest.approx(preds.where("label = pred").count() / 400)


def test_absent_class_gives_zeros(spark):
    p = spark.createDataFrame([(0, 0), (0, 1)], "label int, pred int")
    got = {r["class"]: (r.tp, r.fp, r.fn, r.f1) for r in metrics.per_class_metrics(p).collect()}
    assert got[2] == (0, 0, 0, 0.0) and got[1] == (0, 1, 0, 0.0)


def test_class_weights_sum_to_the_total(preds):
    n = {r.label: r["count"] for r in preds.groupBy("label").count().collect()}
    w = {r.label: r.weight for r in metrics.class_weights(preds).collect()}
    assert sum(w[c] * n[c] for c in w) == pytest.approx(400)


def test_class_weights_of_nothing(spark):
    assert metrics.class_weights(spark.createDataFrame([], "label int")).count() == 0


# --- reports ------------------------------------------------------------------------------------

# The published table: macro F1 and macro recall by rank, three decimals.
TABLE = [(0.707, 0.722), (0.705, 0.728), (0.703, 0.718), (0.697, 0.739), (0.688, 0.719), (0.684, 0.748), (0.681, 0.752), (0.669, 0.742), (0.581, 0.623), (0.568, 0.672), (0.568, 0.663), (0.562, 0.616), (0.559, 0.624), (0.555, 0.674), (0.553, 0.568), (0.544, 0.572), (0.537, 0.646), (0.536, 0.550), (0.536, 0.611), (0.530, 0.624), (0.477, 0.570), (0.437, 0.519), (0.437, 0.460), (0.400, 0.451)]


def test_leaderboard_rebuilds_the_table(spark):
    rows = [(f"e{i:02d}", a, b) for i, (a, b) in enumerate(TABLE)]
    random.Random(3).shuffle(rows)
    got = reports.leaderboard(spark.createDataFrame(rows, "experiment string, macro_f1 double, macro_recall double"), ("macro_f1", "macro_recall")).collect()
    assert [(r.macro_f1, r.macro_recall) for r in got] == TABLE
    assert [r["rank"] for r in got if r.is_max_macro_f1] == [1] and [r["rank"] for r in got if r.is_max_macro_recall] == [7]


def test_suite_lists_blocks_in_order(spark):
    order = reports.block_order(spark)
    t400 = order.select("block", "experiment").orderBy(F.rand(1))
    got = reports.ablation_suite(t400, order, reports.block_titles(spark)).collect()
    assert len(got) == 24 and [r.experiment for r in got] == [e for names in reports.BLOCK_ORDER.values() for e in names]
    assert [r.block_cell for r in got if r.block_cell] == list(reports.BLOCK_TITLES.values())


def test_auc_is_null_for_one_point(spark):
    s = spark.createDataFrame([("a", 100, 1.0), ("a", 300, 3.0), ("b", 400, 1.0)], "experiment string, tau_ms int, m double")
    assert {r.experiment: r.auc_m for r in reports.tau_auc(s, ("m",), ["experiment"]).collect()} == {"a": 400.0, "b": None}


def test_early_stop_and_best_epoch(spark):
    h = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate([0.1, 0.3, 0.3, 0.2, 0.3, 0.1, 0.9])], "x string, epoch int, f1 double")
    assert one(reports.early_stop_epoch(h, "f1", ["x"])).stop_epoch == 6
    assert one(reports.best_epoch(h.where("epoch < 7"), "f1", ["x"])).best_epoch == 2


def test_cap_per_split_is_repeatable(spark):
    s = spark.range(100).select(F.col("id"), F.when(F.col("id") < 70, "train").otherwise("val").alias("split"))
    a = reports.cap_per_split(s, 10, "id").collect()
    assert sorted(a) == sorted(reports.cap_per_split(s.repartition(7), 10, "id").collect()) and len(a) == 20


# --- signals ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def frames(spark):
    r = random.Random(5)
    return spark.createDataFrame([(0, t, f, r.gauss(0, 1), r.gauss(0, 1)) for t in range(40) for f in range(2)], "window_id int, frame int, feature int, x double, y double").cache()


def test_wcc_mirrors_when_roles_swap(frames):
    a = {(r.feature, r.lag): r["corr"] for r in signals.wcc_fast(frames).collect()}
    swapped = frames.select("window_id", "frame", "feature", F.col("y").alias("x"), F.col("x").alias("y"))
    b = {(r.feature, r.lag): r["corr"] for r in signals.wcc_fast(swapped).collect()}
    assert all(a[f, k] == pytest.approx(b[f, -k]) for f, k in a)
    assert all(abs(a[f, 0]) <= 1 + 1e-6 for f in range(2))


def test_short_window_is_an_error(frames):
    with pytest.raises(Exception, match="window too short"):
        signals.wcc_fast(frames.where("frame < 12")).collect()


def test_constant_series_correlate_to_zero(frames):
    assert {r["corr"] for r in signals.wcc_pearson(frames.withColumn("x", F.lit(1.0))).collect()} == {0.0}


def test_sub_windows(frames):
    got = signals.wcc_pearson(frames, win=15, stride=10)
    assert [r.sub for r in got.select("sub").distinct().orderBy("sub").collect()] == [0, 1, 2]


def test_mean_pool_needs_a_whole_ratio(frames):
    with pytest.raises(ValueError, match="whole multiple"):
        signals.mean_pool(frames, 100.0, 30.0)


def test_segments_join_abutting_windows(spark):
    w = spark.createDataFrame([("f", i, i * 2.0, i * 2.0 + 2.0, lab, 0.1, 0.1, 0.1, 0.1, 0.1) for i, lab in enumerate([0, 0, 1, 1, 0])], "file_id string, window_id int, start_s double, end_s double, label int, mean_max_abs_corr double, mean_abs_zero_lag_corr double, mean_best_lag_sec double, speaker_lead_ratio double, listener_lead_ratio double")
    assert [(r.label, r.duration_s) for r in signals.label_segments(w).orderBy("segment_id").collect()] == [(0, 4.0), (1, 4.0), (0, 2.0)]


# --- splits and graphs --------------------------------------------------------------------------


def greedy(sizes):
    room = splits.targets(sum(sizes))
    total = [0, 0, 0]
    for s in sorted(sizes, reverse=True):
        j = max(range(3), key=lambda j: room[j])
        room[j] -= s
        total[j] += s
    return total


@pytest.mark.parametrize("seed", range(4))
def test_packing_equals_the_greedy_fold(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 1, 1, 2, 2, 3, 5, r.randrange(1, 40)]) for _ in range(r.randrange(1, 300))]
    comp = spark.createDataFrame(list(enumerate(sizes)), "component long, size long")
    got = splits.pack_splits(comp).join(comp, "component").groupBy("split").agg(F.sum("size").alias("n"), F.count("*").alias("m")).collect()
    by = {x.split: x.n for x in got}
    assert [by.get(s, 0) for s in splits.SPLITS] == greedy(sizes) and sum(x.m for x in got) == len(sizes)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    random.Random(2).shuffle(chain)
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in graphs.connected_components(spark.createDataFrame(chain + hub + [(5000, 5000)], "src long, dst long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1200)} == {1000} and got[5000] == 5000


def test_components_of_nothing(spark):
    assert graphs.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_manifest_is_disjoint(spark, sf_dir):
    from parley.plans.q_audit import _interactions

    m = splits.build_manifest(_interactions(spark, sf_dir))
    assert splits.verify_disjoint(m).count() == 0 and m.count() == 150


def test_manifest_of_two_pools_with_text_ids(spark):
    rows = [("i1", "p2", "p1", "new"), ("i2", "p2", "p3", "new"), ("i3", "p9", "p8", "new"), ("i4", "p7", None, "new"), ("i5", None, None, "new")]
    ddl = "interaction_id string, participant_a string, participant_b string, origin string"
    poc = spark.createDataFrame([("i3", "p9", "p8", "poc"), ("i6", "p6", "p5", "poc")], ddl)
    out = spark.createDataFrame([("i2",)], "interaction_id string")
    got = {r.interaction_id: r for r in splits.build_manifest(spark.createDataFrame(rows, ddl), out, preferred=poc).collect()}
    assert set(got) == {"i1", "i3", "i4", "i6"}  # i2 is excluded, i5 has no participant
    assert (got["i3"].origin, got["i3"].participant_a, got["i3"].participant_b) == ("poc", "p8", "p9")
    assert {r.split for r in got.values()} <= set(splits.SPLITS)


def test_text_components_are_packed_like_numbers(spark):
    sizes = [9, 5, 5, 3, 2, 2, 1, 1, 1, 1]
    comp = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(sizes)], "component string, size long")
    by = {x.split: x.n for x in splits.pack_splits(comp).join(comp, "component").groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert [by.get(s, 0) for s in splits.SPLITS] == greedy(sizes)


# --- filters, scalars, audits -------------------------------------------------------------------


def test_dominant_length_prefers_the_longer_on_ties(spark):
    d = spark.createDataFrame([("a", 5), ("a", 5), ("a", 7), ("a", 7), ("a", 9)], "g string, n int")
    kept, rejects = filters.dominant_length(d, "g", "n")
    assert {r.n for r in kept.collect()} == {7} and rejects.count() == 3


def test_domain_filter_rejects_nulls(spark):
    kept, bad = filters.domain_filter(spark.createDataFrame([("train",), (None,), ("odd",)], "split string"), {"split": ["train"]})
    assert kept.count() == 1 and {r.reason for r in bad.collect()} == {"bad_split"}


def test_words(spark):
    d = spark.createDataFrame([("Mm-hmm!",), ("uh huh",), ("Ünïcode?",), ("…",), ("Yeah,",)], "w string")
    assert [r.n for r in d.select(S.normalize_word("w").alias("n")).collect()] == ["mmhmm", "uhhuh", "ünïcode", "", "yeah"]


def test_clock(spark):
    d = spark.createDataFrame([(75.25,), (None,), (5.0,)], "s double")
    assert [r.c for r in d.select(S.fmt_clock("s").alias("c")).collect()][1:] == ["?", "0:05.0"]


def test_unknown_error_kinds_are_hard(spark):
    e = spark.createDataFrame([("a", "missing_file"), ("b", "brand_new"), ("c", None)], "experiment string, error_kind string")
    assert {r.experiment: r.verdict for r in audit.audit_verdict(e).collect()} == {"a": "PASS", "b": "FAIL", "c": "PASS"}


def test_config_without_streams(spark):
    e = spark.createDataFrame([("x", "early", None, None, None)], "experiment string, fusion string, stream_idx int, modality string, role string")
    reg = spark.createDataFrame([("audio", "spliced", None, 256, 100.0)], "modality string, kind string, mode string, feature_dim int, frame_rate_hz double")
    assert [r.rule for r in audit.config_audit(e, reg).collect()] == ["no_streams"]


# --- sources and sinks --------------------------------------------------------------------------


def test_interval_files(spark, tmp_path):
    (tmp_path / "vad_V00_S0001_I00000001_P0001.jsonl").write_text('{"start": 2.5, "end": 3.0}\n{"start": 0.5, "end": 1.0}\n')
    got = readers.read_intervals(spark, str(tmp_path)).orderBy("seg_idx").collect()
    assert [(r.file_id, r.seg_idx, r.start_s) for r in got] == [("V00_S0001_I00000001_P0001", 1, 0.5), ("V00_S0001_I00000001_P0001", 2, 2.5)]


def test_bad_interval_line_is_an_error(spark, tmp_path):
    (tmp_path / "vad_a_b.jsonl").write_text('{"start": 2.5, "end": 3.0}\nnot json\n')
    with pytest.raises(Exception):  # noqa: B017
        readers.read_intervals(spark, str(tmp_path)).collect()


def test_transcripts_skip_bad_lines_and_incomplete_words(spark, tmp_path):
    words = [{"word": "ok", "start": 1.0, "end": 1.5}, {"word": "no end", "start": 2.0}, {"word": "null", "start": None, "end": 3.0}]
    (tmp_path / "transcript_a_b.jsonl").write_text(json.dumps({"words": words}) + "\nnot json\n")
    got = readers.flatten_words(readers.read_transcripts(spark, str(tmp_path))).collect()
    assert [(r.file_id, r.word, r.start_s, r.end_s) for r in got] == [("a_b", "ok", 1.0, 1.5)]


def test_label_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"a_t_0002000": 0, "a_t_0002500": 5}))
    (tmp_path / "bad.json").write_text(json.dumps({"a_t_0002000": 6}))
    assert {r.sample_key: r.label for r in readers.read_labels(spark, str(tmp_path / "good.json"), 400).collect()} == {"a_t_0002000": 0, "a_t_0002500": 5}
    with pytest.raises(Exception, match="bad label"):
        readers.read_labels(spark, str(tmp_path / "bad.json"), 400).collect()


def test_annotations_and_relationships(spark, tmp_path):
    (tmp_path / "3P-IS_V00_S1132_I00000354_P1093.json").write_text('{"annotation": "smiles", "start_ts": 1, "end_ts": 2}\n')
    r = one(readers.read_annotations(spark, str(tmp_path)))
    assert (r.kind, r.interaction_id, r.participant_id, r.annotation) == ("IS", "V00_S1132_I00000354", "P1093", "smiles")
    (tmp_path / "rel").mkdir()
    (tmp_path / "rel" / "session_relationship.json").write_text('{\n "vendor_id": "V00",\n "session_id": "1132",\n "relationship": "stranger",\n "relationship_detail": "stranger"\n}')
    assert one(readers.read_relationships(spark, str(tmp_path / "rel"))).relationship == "stranger"


def test_feature_file_index(spark, tmp_path):
    (tmp_path / "0001.50-0003.50_V00_S0001_I00000001_P0001.npy").write_bytes(b"12345")
    (tmp_path / "notes.txt").write_text("x")
    r = one(readers.index_feature_files(spark, str(tmp_path)))
    assert (r.bytes, r.start_s, r.end_s, r.file_id) == (5, 1.5, 3.5, "V00_S0001_I00000001_P0001")


def test_json_features(spark, tmp_path):
    (tmp_path / "a.json").write_text("[[1.0, 2.0]]")
    (tmp_path / "b.json").write_text('{"features": [[1.0, 2.0], [3.0, 4.0]]}')
    (tmp_path / "c.json").write_text('{"embeddings": [[1.0]]}')
    assert sorted(r.n for r in readers.read_json_features(spark, str(tmp_path)).select(F.size("matrix").alias("n")).collect()) == [1, 1, 2]


def files_written(spark, run):
    """Rows of a query, and how many part files it has left in the shared folder."""
    top = pathlib.Path(graphs.shared_folder(spark).removeprefix("file://"))
    before = set(top.iterdir())
    out = run()
    rows = out.collect()
    return rows, sum(len(list(p.rglob("part-*"))) for p in set(top.iterdir()) - before)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """1,200 conversations of two to five turns, and 800 vectors."""
    at = tmp_path_factory.mktemp("many")
    turns = spark.range(1_200).selectExpr("id AS conv_id", "explode(sequence(0L, id % 4 + 1)) AS turn").selectExpr("conv_id", "turn", "IF(turn % 2 = 0, 'user', 'assistant') AS role", "repeat('x', CAST(conv_id * 7 % 90 AS INT)) AS text")
    turns.coalesce(1).write.parquet(f"{at}/all")
    vectors = spark.range(800).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> CAST((id * 13 + i * 7) % 101 AS FLOAT) / 8) AS embedding", "CAST(id % 3 AS INT) AS label")
    vectors.selectExpr("vec_id", "transform(embedding, x -> CAST(x AS FLOAT)) AS embedding", "label").coalesce(1).write.parquet(f"{at}/vectors")
    for name, table in (("all", "conversations"), ("vectors", "embeddings")):
        next((at / name).glob("part-*.parquet")).rename(at / f"{table}.parquet")
        shutil.rmtree(at / name)
    return at


MANY = ["read_interaction_docs", "read_json_features", "read_transcripts", "read_intervals"]


@pytest.mark.parametrize("name", MANY)
def test_files_do_not_grow_with_the_documents(spark, many, name):
    registry.load()
    rows, n = files_written(spark, lambda: registry.QUERIES[name](spark, str(many)))
    cur = tables(str(many)).execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert plain_rows(names, [tuple(r[c] for c in names) for r in rows]) == plain_rows(names, cur.fetchall())
    assert 0 < n < 60


def test_packed_interaction_documents(spark, tmp_path):
    """Messy documents in folders, and the same packed, a folder at a time."""
    one = lambda i, label="naturalistic", split="train": {"file_id": f"V00_S0001_I{i:08d}_P{1 + (label == 'other'):04d}", "label": label, "split": split}
    both = lambda i: [one(i), {**one(i), "file_id": f"V00_S0001_I{i:08d}_P0002", "more": [1, {"a": 2}]}]
    dyads = {"good": both(1), "pretty": both(2), "single": one(3), "labels": [one(4), one(4, "other")], "broken": "[{", "empty": "", "none": "[]", "kinds": [{**both(5)[0], "split": 7}, both(5)[1]], "no_meta": both(6), "no_rel": both(7)}
    for name, held in dyads.items():
        at = tmp_path / "docs" / name / "interaction"
        at.mkdir(parents=True)
        (at / "filelist.json").write_text(held if isinstance(held, str) else json.dumps(held, indent=2 if name == "pretty" else None))
        if name != "no_meta":
            (at / "metadata.json").write_text('{"interaction_type": "talk"}' if name != "good" else "{oops")
        if name != "no_rel":
            (at / "relationship.json").write_text('{\n "relationship": "stranger",\n "relationship_detail": "stranger"\n}')
    kinds = ("filelist", "metadata", "relationship")
    plain = readers.read_interactions(spark, *[f"{tmp_path}/docs/*/interaction/{k}.json" for k in kinds])
    for k in kinds:
        sinks.pack_files(spark, [f"{tmp_path}/docs/{name}" for name in dyads], f"{tmp_path}/{k}", f"{k}.json", wholetext=True)
    packed = readers.read_interactions(spark, *[f"{tmp_path}/{k}" for k in kinds], packed=True)
    for a, b in zip(plain, packed):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert plain[0].count() == 2 and {r.folder: r.reason for r in packed[1].collect()} == {"single": "file_count", "labels": "labels", "broken": "file_count", "kinds": "splits", "no_meta": "no_metadata", "no_rel": "no_relationship"}


def test_packed_json_features(spark, tmp_path):
    texts = {"a/x.json": "[[1.0, 2.0]]", "a/y.json": '{\n "features":\n [[1.0, 2.0], [3.0, 4.0]]}', "b/z.json": '{"embeddings": [[1.0]]}'}
    for name, text in texts.items():
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_text(text)
    folders = [f"{tmp_path}/docs/{x}" for x in "ab"]
    sinks.pack_files(spark, folders, f"{tmp_path}/packed", "*.json", wholetext=True)
    plain = spark.createDataFrame([], "path string, matrix array<array<double>>")
    for x in folders:
        plain = plain.unionByName(readers.read_json_features(spark, x))
    got = readers.read_json_features(spark, f"{tmp_path}/packed", packed=True).collect()
    assert len(got) == 3 and sorted(map(repr, got)) == sorted(map(repr, plain.collect()))
    (tmp_path / "docs" / "b" / "z.json").write_text('{"other": 1}')
    sinks.pack_files(spark, folders, f"{tmp_path}/packed", "*.json", wholetext=True)
    with pytest.raises(Exception, match="no features in .*z.json"):
        readers.read_json_features(spark, f"{tmp_path}/packed", packed=True).collect()


def test_packed_transcripts_skip_bad_lines(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for k in range(3):
        words = [{"word": f"w{k}", "start": 1.0, "end": 1.5}, {"word": "no end", "start": 2.0}, {"word": "null", "start": None, "end": 3.0}]
        (tmp_path / "docs" / f"transcript_a_{k}.jsonl").write_text(json.dumps({"words": words}) + "\nnot json\n\n" + json.dumps({"other": 1}) + "\n" + json.dumps({"words": words[:1]}) + "\n")
    sinks.pack_files(spark, [f"{tmp_path}/docs"], f"{tmp_path}/packed")
    plain, packed = readers.read_transcripts(spark, f"{tmp_path}/docs"), readers.read_transcripts(spark, f"{tmp_path}/packed", packed=True)
    assert packed.count() == 6 and sorted(map(repr, plain.collect())) == sorted(map(repr, packed.collect()))
    assert sorted((r.file_id, r.word) for r in readers.flatten_words(packed).collect()) == [(f"a_{k}", f"w{k}") for k in (0, 0, 1, 1, 2, 2)]


def test_packed_intervals(spark, tmp_path):
    """Ties in the order of the lines and of the entries of a line; a bad line is an error."""
    r = random.Random(3)
    (tmp_path / "docs").mkdir()
    for k in range(4):
        lines = [json.dumps({"start": r.randrange(5) / 2, "end": float(i)}) for i in range(40)]
        lines[7:7] = ["", "  ", json.dumps([{"start": 0.5, "end": -1.0}, {"start": 0.5, "end": -2.0}]), json.dumps({"end": 9.0})]
        (tmp_path / "docs" / f"vad_a_{k}.jsonl").write_text("\n".join(lines) + "\n")
    pack = lambda: sinks.pack_files(spark, [f"{tmp_path}/docs"], f"{tmp_path}/packed", "*.jsonl")
    pack()
    plain, packed = readers.read_intervals(spark, f"{tmp_path}/docs"), readers.read_intervals(spark, f"{tmp_path}/packed", packed=True)
    assert packed.count() == 4 * 43 and sorted(map(repr, plain.collect())) == sorted(map(repr, packed.collect()))
    (tmp_path / "docs" / "vad_a_0.jsonl").write_text('{"start": 2.5, "end": 3.0}\nnot json\n')
    pack()
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_intervals(spark, f"{tmp_path}/packed", packed=True).collect()


def test_manifest_needs_its_columns_and_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("split,interaction_id\n")
    with pytest.raises(ValueError, match="lacks"):
        readers.read_manifest(spark, str(tmp_path / "m.csv"), ["split", "file_id_a"])
    with pytest.raises(ValueError, match="no rows"):
        readers.read_manifest(spark, str(tmp_path / "m.csv"), ["split"])


def test_lookup_last_row_wins(spark, tmp_path):
    (tmp_path / "l.csv").write_text("k,v\na,1\nb,2\na,3\n")
    assert {r.k: r.v for r in readers.read_lookup(spark, str(tmp_path / "l.csv"), ["k"]).collect()} == {"a": "3", "b": "2"}


def test_coordination_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("interaction,start_s,peak\ni,0.0,0.5\ni,0.0,0.7\n")
    assert one(readers.read_coordination(spark, str(tmp_path / "c.csv"), ["interaction", "start_s"], ["peak"])).peak == 0.7
    with pytest.raises(ValueError, match="lacks"):
        readers.read_coordination(spark, str(tmp_path / "c.csv"), ["interaction"], ["other"])


def test_sinks_can_be_run_again(spark, tmp_path):
    w = spark.createDataFrame([("i", 0, 0, 0.5)], "interaction_id string, feature int, lag int, corr double")
    for _ in range(2):
        sinks.write_wcc(w, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1
    counts = spark.createDataFrame([(400, "train", 3)], "tau_ms int, split string, n long")
    sinks.write_run_manifest({"stride_ms": "500"}, counts, counts, str(tmp_path / "run"))
    assert one(spark.read.json(str(tmp_path / "run" / "counts"))).n == 3


def test_manifest_order(spark, tmp_path):
    m = spark.createDataFrame([("test", "a"), ("train", "z"), ("train", "b"), ("val", "c")], "split string, interaction_id string")
    sinks.write_manifest(m, str(tmp_path / "m"))
    got = [(r.split, r.interaction_id) for r in spark.read.option("header", True).csv(str(tmp_path / "m")).collect()]
    order = {"train": 0, "val": 1, "test": 2}
    assert sorted(got, key=lambda x: (order[x[0]], x[1])) == [("train", "b"), ("train", "z"), ("val", "c"), ("test", "a")]
    assert all(a <= b for a, b in pairwise(sorted(order.values())))


def test_the_written_manifest_comes_back_whole_and_in_order(spark, sf_dir):
    """A row per dyad with its line, also where the files are read in many pieces."""
    from parley.plans import q_io
    from parley.plans.fixtures import fixture

    want = fixture(spark, sf_dir, "v_manifest").collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted(q_io.write_manifest(spark, sf_dir).collect(), key=lambda r: r.line)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    order = {"train": 0, "val": 1, "test": 2}
    assert [r.line for r in got] == list(range(len(want)))
    columns = [c for c in got[0].asDict() if c != "line"]
    assert len(columns) == 10
    assert [tuple(r[c] for c in columns) for r in got] == [tuple(r[c] for c in columns) for r in sorted(want, key=lambda r: (order[r.split], r.interaction_id))]


def test_summary_streams_in_the_shape_audit(spark):
    samples = spark.createDataFrame([("k1", "f1", "g1"), ("k2", "f2", "g2"), ("k3", "f3", "g3")], "sample_key string, speaker_file_id string, listener_file_id string")
    streams = spark.createDataFrame([("x", 0, "wcc", "speaker"), ("x", 1, "cont", "speaker")], "experiment string, stream_idx int, modality string, role string")
    reg = spark.createDataFrame([("wcc", "coordination", "summary", 19, None), ("cont", "coordination", "continuous", 4, None)], "modality string, kind string, mode string, feature_dim int, frame_rate_hz double")
    rows = spark.createDataFrame([("k1", "wcc", 1, 19), ("k2", "wcc", 1, 18)], "sample_key string, modality string, t int, d int")
    index = spark.createDataFrame([("cont", "f1", 40, 4, 0), ("cont", "f2", 41, 4, 0)], "modality string, file_id string, t int, d int, candidate int")
    kinds = lambda a: {(r.stream_idx, r.sample_key): r.error_kind for r in a.collect()}
    strict = audit.shape_audit(samples, streams, reg, index, rows, missing="error")
    assert kinds(strict) == {(0, "k1"): None, (0, "k2"): "shape_divergence", (0, "k3"): "summary_csv_key_missing", (1, "k1"): None, (1, "k2"): None, (1, "k3"): "missing_file"}
    lenient = audit.shape_audit(samples, streams, reg, index, rows)
    assert kinds(lenient)[(0, "k3")] is None
    by = {r.stream_idx: r for r in audit.stream_summary(lenient).collect()}
    # zeros have the right shape, so only the lengths 40 and 41, which nothing pads, are a hazard
    assert (by[0].n_missing, by[0].n_divergent, by[0].stack_hazard) == (1, 1, False)
    assert (by[1].n_missing, by[1].n_shapes, by[1].stack_hazard) == (1, 2, True)
    assert kinds(audit.shape_audit(samples, streams, reg, index, missing="error"))[(0, "k1")] == "summary_csv_key_missing"


def test_lengths_that_are_padded_are_no_hazard(spark):
    samples = spark.createDataFrame([("k1", "f1", "g1"), ("k2", "f2", "g2")], "sample_key string, speaker_file_id string, listener_file_id string")
    streams = spark.createDataFrame([("x", 0, "audio", "speaker")], "experiment string, stream_idx int, modality string, role string")
    reg = spark.createDataFrame([("audio", 4, 20.0)], "modality string, feature_dim int, frame_rate_hz double")
    index = spark.createDataFrame([("audio", "f1", 40, 4, 0), ("audio", "f2", 41, 4, 0)], "modality string, file_id string, t int, d int, candidate int")
    r = one(audit.stream_summary(audit.shape_audit(samples, streams, reg, index)))
    assert (r.n_t_mismatch, r.n_shapes, r.stack_hazard) == (1, 2, False)


def test_interactions_from_documents(spark, tmp_path):
    def dyad(name, files, meta=True, rel=True):
        p = tmp_path / name / "interaction"
        p.mkdir(parents=True)
        (p / "filelist_entries.json").write_text(json.dumps(files, indent=1))
        if meta:
            (p / "interaction_metadata.json").write_text('{\n"interaction_type": "talk"}')
        if rel:
            (p / "session_relationship.json").write_text('{\n"relationship": "familiar",\n"relationship_detail": "friends"}')

    f = lambda p, label="naturalistic", split="dev": {"file_id": f"V00_S0001_I00000007_{p}", "label": label, "split": split}
    dyad("ok", [f("P0009"), f("P0002")])
    dyad("three", [f("P0009"), f("P0002"), f("P0003")])
    dyad("labels", [f("P0009"), f("P0002", "improvised")])
    dyad("splits", [f("P0009"), f("P0002", split="train")])
    dyad("bare", [f("P0009"), f("P0002")], meta=False)
    dyad("alone", [f("P0009"), f("P0002")], rel=False)
    at = lambda n: str(tmp_path / "*" / "interaction" / n)
    good, bad = readers.read_interactions(spark, at("filelist_entries.json"), at("interaction_metadata.json"), at("session_relationship.json"))
    r = one(good)
    assert (r.interaction_id, r.vendor_id, r.session_id, r.seamless_split) == ("V00_S0001_I00000007", "V00", "0001", "dev")
    assert (r.participant_a, r.participant_b, r.relationship_detail, r.interaction_type) == ("P0002", "P0009", "friends", "talk")
    assert r.audio_url_b.endswith("/naturalistic/dev/audio/V00_S0001_I00000007_P0009.wav")
    assert {x.folder: x.reason for x in bad.collect()} == {"three": "file_count", "labels": "labels", "splits": "splits", "bare": "no_metadata", "alone": "no_relationship"}


def test_labels_written_as_json_are_read_again(spark, tmp_path):
    rows = [("a_t_0002000", 100, 5), ("a_t_0002000", 400, 0), ("b_t_0002000", 400, 2)]
    sinks.write_labels(spark.createDataFrame(rows, "sample_key string, tau_ms int, label int"), str(tmp_path), fmt="json")
    got = readers.read_labels(spark, str(tmp_path / "tau_ms=400"), 400, lines=True).collect()
    assert sorted((r.sample_key, r.tau_ms, r.label) for r in got) == rows[1:]


def test_a_block_leaves_results_and_an_index(spark, tmp_path):
    frames = spark.createDataFrame([(w, s, 0, 0, float(w % 3) + (s == "listener")) for w in range(60) for s in ("speaker", "listener")], "window_id long, stream string, frame int, feature int, value double")
    samples = spark.createDataFrame([(f"k{w}", w, "train" if w < 40 else "test") for w in range(60)], "sample_key string, window_id long, split string")
    labels = spark.createDataFrame([(f"k{w}", tau, w % 3) for w in range(60) for tau in (200, 400)], "sample_key string, tau_ms int, label int")
    path = str(tmp_path)
    for _ in range(2):  # a rerun replaces what it wrote
        models.ablation_block({"one": ("speaker",), "two": ("speaker", "listener")}, frames, samples, labels, path=path, block="roles")
    results = spark.read.parquet(f"{path}/results").collect()
    assert sorted((r.experiment, r.tau_ms) for r in results) == [("one", 200), ("one", 400), ("two", 200), ("two", 400)]
    index = one(spark.read.json(f"{path}/index"))
    assert (index.block, index.n_experiments, index.experiments, index.taus) == ("roles", 2, "one,two", "200,400")
    runs = {r.experiment: r for r in spark.read.json(f"{path}/experiments").collect()}
    assert (runs["one"].streams, runs["one"].n_params, runs["two"].streams, runs["two"].n_params) == ("speaker", 6, "speaker,listener", 9)
    at = {r.experiment: r.macro_f1 for r in results if r.tau_ms == 400}
    assert {k: r.macro_f1_at_train_tau for k, r in runs.items()} == at


def test_suite_names_streams_and_architecture(spark):
    order = spark.createDataFrame([("b", "e1", 0), ("b", "e2", 1)], "block string, experiment string, position int")
    titles = spark.createDataFrame([("b", 0, "Block")], "block string, block_position int, title string")
    t400 = spark.createDataFrame([("b", "e2", "Audio + face", "early"), ("b", "e1", "Audio", None)], "block string, experiment string, experiment_name string, arch string")
    assert [(r.block_cell, r.streams, r.architecture) for r in reports.ablation_suite(t400, order, titles).collect()] == [("Block", "Audio", None), ("", "Audio + face", "early")]


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        get = dict.get

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf())

    class Session:
        sparkContext = Context
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graphs.shared_folder(Session)
