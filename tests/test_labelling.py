"""Hand cases of the label tree, and the golden class counts."""

import pytest

from parley.operators import labelling
from parley.plans.fixtures import fixture

# a and b intervals, words of b (word, start), tau, expected class at t = 5.0
CASES = [
    ([(4, 10)], [], [], 400, 0),
    ([(4, 5.2)], [], [], 400, 5),
    ([(4, 10)], [(5.1, 5.3)], [("yeah", 5.15)], 400, 2),
    ([(4, 10)], [(5.1, 5.3)], [], 400, 2),
    ([(4, 10)], [(5.1, 9)], [("think", 5.15)], 400, 3),
    ([(4, 10)], [(5.1, 5.3)], [("think", 5.15)], 400, 4),
    ([(4, 5.3)], [(5.1, 9)], [("think", 5.15)], 400, 1),
    ([(4, 5.39)], [(5.1, 5.3)], [("think", 5.15)], 400, 1),
    ([(4, 10)], [(5.05, 5.65)], [], 800, 0),
    ([(4, 10)], [(5.02, 5.77)], [], 800, 4),
    ([(4, 10)], [(5.05, 5.8)], [], 800, 3),
    ([(4, 10)], [(5.4, 9)], [], 400, 0),
    ([(4, 10)], [(5.1, 5.3)], [("…", 5.15)], 400, 4),
    ([(4, 10)], [(5.1, 5.35)], [("ok", 5.12), ("yeah", 5.2), ("mm", 5.3)], 400, 4),
    ([(4, 5.5)], [(5.1, 5.3)], [("think", 5.15)], 600, 3),
    # the first containing interval decides, not the one that reaches furthest
    ([(4, 5.1), (4.5, 10)], [(5.0, 5.3)], [("think", 5.15)], 400, 1),
]


@pytest.fixture(scope="module")
def labelled(spark):
    iv, words, samples = [], [], []
    for n, (a, b, w, tau, _) in enumerate(CASES):
        for side, spans in (("a", a), ("b", b)):
            iv += [(f"{side}{n}", i + 1, float(s), float(e)) for i, (s, e) in enumerate(sorted(spans))]
        words += [(f"b{n}", x, float(t)) for x, t in w]
        samples.append((f"a{n}", f"b{n}", 0, 5.0))
    s = spark.createDataFrame(samples, "file_id string, other_file_id string, i int, t double")
    i = spark.createDataFrame(iv, "file_id string, seg_idx int, start_s double, end_s double")
    w = spark.createDataFrame(words, "file_id string, word string, start_s double")
    out = labelling.label_samples(s, i, w, tuple(sorted({c[3] for c in CASES})))
    return {(r.file_id, r.tau_ms): r.label for r in out.collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_hand_case(labelled, n):
    assert labelled[f"a{n}", CASES[n][3]] == CASES[n][4]


def test_golden_counts(spark, sf_dir):
    m, i, w = (fixture(spark, sf_dir, n) for n in ("v_manifest", "v_intervals", "v_words"))
    assert (m.count(), i.count(), w.count()) == (20, 82, 1253)
    at = labelling.label_windows(m, i, w).where("tau_ms = 400").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in at} == {0: 517, 1: 12, 2: 46, 3: 12, 4: 3, 5: 43}


def test_dyads_with_a_silent_side_can_be_left_out(spark, sf_dir):
    m, i, w = (fixture(spark, sf_dir, n) for n in ("v_manifest", "v_intervals", "v_words"))
    every, some = labelling.label_windows(m, i, w), labelling.label_windows(m, i, w, skip_empty=True)
    assert 0 < some.count() < every.count()


def test_no_samples_without_room_for_the_longest_horizon(spark):
    m = spark.createDataFrame([("I", "a", "b", "train", 3.6)], "interaction_id string, file_id_a string, file_id_b string, split string, duration_s double")
    i = spark.createDataFrame([("a", 1, 0.0, 9.0)], "file_id string, seg_idx int, start_s double, end_s double")
    assert labelling.sample_grid(m, i).count() == 0
