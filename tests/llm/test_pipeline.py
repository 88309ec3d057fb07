"""The corpus pipeline, stage by stage, against plain checks of each stage on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from parley.llm import langid, mixing, shards
from parley.llm.common import table, written

from .test_copies import brute_near
from .test_operators import brute_hits


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, sf_dir))
        out.append((name, docs))
    return out


def test_names_and_columns(spark, sf_dir, stages):
    assert [n for n, _ in stages] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]
    columns = table(spark, sf_dir, "documents").columns
    assert all(d.columns == columns for _, d in stages[:-1])


def test_each_stage_does_its_work(spark, sf_dir, stages):
    start = table(spark, sf_dir, "documents").collect()
    known = stages[0][1].collect()
    model = langid.learn(langid.training_rows(table(spark, sf_dir, "documents")))
    assert {r.doc_id for r in known} == {r.doc_id for r in start if model.decide(r.text)[2] >= langid.LEAST_SHARE}
    near = brute_near([r.text or "" for r in known])
    least = {}
    for r, c in zip(known, near, strict=True):
        least[c] = min(r.doc_id, least.get(c, r.doc_id))
    single = stages[1][1].collect()
    assert sorted(r.doc_id for r in single) == sorted(least.values())
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    hits = brute_hits([r.text for r in single], items)
    clean = stages[2][1].collect()
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r, h in zip(single, hits, strict=True) if not h[-1])
    assert any(h[-1] for h in hits)
    mixed = stages[3][1].collect()
    assert Counter(mixed) == Counter(clean)
    last = stages[4][1].collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in mixed}
    sizes, texts = Counter(), defaultdict(set)
    for r in last:
        sizes[r.shard] += r["size"]
        texts[r.text_crc32].add(r.shard)
    place = {r.placed: r.position for r in mixing.places(stages[3][1]).collect()}
    for k in sizes:
        own = sorted((r.slot, place[r.doc_id]) for r in last if r.shard == k)
        assert [x[0] for x in own] == list(range(len(own))) and own == sorted(own, key=lambda x: x[1])
    assert len(sizes) == shards.SHARDS and all(len(v) == 1 for v in texts.values())


def test_run_equals_the_stages(spark, sf_dir, stages):
    assert Counter(corpus_pipeline.run(spark, sf_dir).collect()) == Counter(stages[-1][1].collect())
