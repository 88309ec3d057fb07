"""Copies: rows that share ids or have none, and edited texts."""

import random
from collections import defaultdict

import numpy as np
import pytest

from parley.llm import nearcopies, simhash
from parley.llm.common import written
from parley.operators.graphs import connected_components

from .test_operators import words

SCHEMA = "doc_id long, text string"


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    r = random.Random(4)
    a, b, c, d = (words(r, 80) for _ in range(4))
    rows = [(5, a), (5, c), (3, b), (5, b), (None, d), (None, d), (None, a), (7, a)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((x.doc_id or 0, x.text) for x in nearcopies.without_near_copies(docs).collect())
    assert got == sorted([(5, a), (5, c), (3, b), (0, d)])


def test_the_stage_reduces_copies_without_ids(spark):
    import corpus_pipeline

    text = words(random.Random(5), 90)
    docs = spark.createDataFrame([(None, text), (None, text), (None, text)], SCHEMA)
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 1


def brute_near(texts):
    """Components of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def edited_copies():
    r = random.Random(6)
    common = words(r, 40)
    texts = [words(r, r.randrange(1, 300)) for _ in range(30)] + [words(r, 15) + " " + common + " " + words(r, 15) for _ in range(20)]
    for n, copies in ((400, 12), (60, 50)):
        base = words(r, n).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(1, 1 + max(1, n // 40))):
                own[r.randrange(n)] = "edited"
            texts.append(" ".join(own))
    return texts + ["", " ", "a b", "A  b"]


@pytest.mark.parametrize(("block", "tree", "weight"), [(nearcopies.BLOCK, simhash.TREE, nearcopies.WEIGHT), (8, 4, nearcopies.WEIGHT), (nearcopies.BLOCK, 4, 900)])
def test_links_join_exactly_the_near_copies(spark, block, tree, weight):
    texts = edited_copies()
    rows = spark.createDataFrame([(i, i, 0, t) for i, t in enumerate(texts)], "key long, id long, mark long, text string")
    printed = written(nearcopies.prints(rows))
    node = {x.key: bytes(x.node) for x in printed.collect()}
    found = {bytes(x.node): bytes(x.component) for x in connected_components(nearcopies.links(rows, printed, block, tree, weight)).collect()}
    want, groups = brute_near(texts), defaultdict(set)
    for i, w in enumerate(want):
        groups[w].add(found.get(node[i], node[i]))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_near_texts_are_within_the_radius_and_share_a_shard():
    r = random.Random(8)
    missed = total = 0
    for n in [6, 9, 12, 20, 40, 100, 400] * 40:
        base = words(r, n).split()
        other = list(base)
        while True:  # edit until the texts are no longer near; the last near state is judged
            last = list(other)
            other[r.randrange(n)] = f"e{r.random()}"
            a, b = (nearcopies.shingles(nearcopies.words_of(" ".join(x))) for x in (base, other))
            common = len(np.intersect1d(a, b))
            if 5 * common < 4 * (len(a) + len(b) - common):
                break
        b = nearcopies.shingles(nearcopies.words_of(" ".join(last)))
        away = simhash.distances(*(np.frombuffer(nearcopies.fingerprint(x), dtype=np.uint64)[None] for x in (a, b)))[0]
        total += 1
        missed += away > nearcopies.RADIUS or not set(nearcopies.shards(a)) & set(nearcopies.shards(b))
    assert missed <= 0.01 * total


def test_the_stage_finds_edited_copies(spark):
    import corpus_pipeline

    texts = edited_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(brute_near(texts)))
