"""Whitening, lexical search and the quadratic discriminant against brute force, on messy rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import discriminant, search, whitening
from parley.llm.entries import ORACLES, QUERIES

from ..helpers import same, tables
from .test_operators import ROWS, SCHEMA, words

# --- 11 whitening -------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x string, n long, component int"


def whole(c):
    return [math.floor(64 * float(np.float32(v))) + 1_000_000 for v in c]


def plain_whitening(rows):
    """Kept rows and numpy's own whitening of them."""
    kept = [(i, whole(c)) for i, c, *_ in rows if c and all(v is not None and math.isfinite(v) for v in c)]
    d = Counter(len(x) for _, x in kept).most_common(1)[0][0]
    kept = [(i, x) for i, x in kept if len(x) == d]
    u = np.unique(np.array([x for _, x in kept]), axis=0).astype(float)
    value, vector = np.linalg.eigh(np.cov(u.T, bias=True))
    value, vector = value[::-1], vector[:, ::-1]
    return kept, u, value, vector


def test_whitening_equals_numpy(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=20) * np.linspace(1, 3, 20)).tolist(), 1, "x", 5, 9) for i in range(300)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None, None)]
    rows += [(900, None, 0, "", 0, 0), (901, [], 0, "", 0, 0), (902, [1.0] * 19 + [None], 0, "", 0, 0), (903, [float("nan")] * 20, 0, "", 0, 0), (904, [float("-inf")] * 20, 0, "", 0, 0), (905, [1.0], 0, "", 0, 0)]
    got = whitening.report(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    kept, u, value, vector = plain_whitening(rows)
    n, sums = len(u), [int(s) for s in u.sum(axis=0)]
    assert Counter(g.vec_id for g in got) == Counter({i: 16 * c for i, c in Counter(i for i, _ in kept).items()})
    assert {g.n for g in got} == {n} and len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-12
    off = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}
    plain = {i: (np.array(x) - u.mean(axis=0)) @ vector / np.sqrt(value) for i, x in kept}
    sign = {}
    for g in got:
        want = plain[g.vec_id][g.component - 1]
        sign.setdefault(g.component, 1 if g.whitened * want > 0 else -1)
        assert g.deviation == off[g.vec_id] and abs(g.whitened * sign[g.component] - want) < 1e-8
        assert abs(g.explained - value[g.component - 1] / value.sum()) < 1e-12


def test_whitening_of_few_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.report(frame([])).count() == 0
    assert whitening.report(frame([(1, [1.0, 2.0], 0, "", 0, 0)] * 3)).count() == 0
    got = whitening.report(frame([(1, [0.0, 1.0], 0, "", 0, 0), (2, [1.0, 1.0], 0, "", 0, 0)])).collect()
    assert sorted((g.vec_id, g.component, abs(round(g.whitened, 12)), g.explained) for g in got) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    big = whitening.report(frame([(i, [float(3e38 * (-1) ** i), float(i)], 0, "", 0, 0) for i in range(8)])).collect()
    assert len(big) == 8 and any(g.deviation is None for g in big)  # the second is lost in the rounding of the first


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1, 1 + 1e-9, 1 + 2e-9, 0.5, 0.5 + 1e-12, 0.1], [3, 3, 3, 1, 1, 0], [0, 0], [2]])
def test_refined_eigenvectors(values):
    r = np.random.default_rng(1)
    d = len(values)
    q = np.linalg.qr(r.normal(size=(d, d)))[0].astype(np.longdouble)
    q = q + q @ (np.eye(d) - q.T @ q) / 2
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    value, x = whitening.eigen((a + a.T) / 2)
    assert np.abs(value - np.sort(np.array(values, dtype=np.longdouble))[::-1]).max() < 1e-15
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17 and np.abs(a @ x - x * value).max() < 1e-15


@pytest.mark.parametrize("bits", [5, 19, 26, 50, 62])
def test_products_are_exact(bits):
    y = np.random.default_rng(bits).integers(-(2**bits), 2**bits, size=(9_000, 3))
    assert (whitening.gram(y) == y.astype(object).T @ y.astype(object)).all()


# --- 12 search ----------------------------------------------------------------------------------


def plain_terms(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_search(rows, items, k=20):
    docs = [(r[0], Counter(plain_terms(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_all, l_all = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in docs:
            m = 75 + 25 * n * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


ITEMS = [(7, ROWS[3][1]), (7, ROWS[3][1]), (None, ROWS[61][1]), (1, None), (2, ""), (3, "!!"), (4, "É 123"), (5, "nowhere-to-be-found zzzz"), (6, "ab AB ab Th"), (8, ROWS[72][1]), (9, words(random.Random(5), 3_000))]


@pytest.mark.parametrize("size,block,most", [(1 << 18, 32, 8 << 20), (300, 2, 8 << 20), (50, 4, 1_000)])
def test_search_equals_scoring_all(spark, docs, monkeypatch, size, block, most):
    monkeypatch.setattr(search, "BATCH_BYTES", most)
    monkeypatch.setattr(search, "SEGMENT", size)
    monkeypatch.setattr(search, "BLOCK", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("q", F.lit(1)).withColumn("doc_id", F.lit("x")).coalesce(1)
    got = search.report(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(ROWS, ITEMS)


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.report(none, items).count() == 0 and search.report(docs, items.limit(0)).count() == 0


def test_search_equals_sql(spark, sf_dir):
    same(QUERIES["op12_search"](spark, sf_dir), tables(sf_dir), ORACLES["op12_search"])


def segment_of(r, documents, size):
    """A segment of random vectors, grouped around a few centres."""
    centres = [r.choice(size, 12, replace=False) for _ in range(12)]
    vectors = []
    for i in range(documents):
        own = np.unique(np.concatenate([r.choice(centres[i % 12], 8), r.choice(size, 3)]))
        vectors.append((own, r.integers(1, 1_000_000, len(own))))
    ptr = np.append(0, np.cumsum([len(t) for t, _ in vectors]))
    return vectors, search.Segment(ptr, np.concatenate([t for t, _ in vectors]), np.concatenate([v for _, v in vectors]), size, search.directions(size))


def test_summaries_bound_every_document_and_blocks_are_skipped(monkeypatch):
    r = np.random.default_rng(2)
    size, documents, scored = 200, 3_000, 0
    vectors, index = segment_of(r, documents, size)
    for t in range(size):
        rows, starts, summary, terms, maxima = index.blocks(t)
        assert sorted(rows) == [i for i, (own, _) in enumerate(vectors) if t in own]
        for b, (a, e) in enumerate(zip(starts, starts[1:], strict=False)):
            end = summary[b + 1] if b + 1 < len(summary) else len(terms)
            want: dict[int, int] = {}
            for i in rows[a:e]:
                for c, v in zip(*vectors[i], strict=True):
                    want[c] = max(want.get(c, 0), v)
            assert dict(zip(terms[summary[b] : end].tolist(), maxima[summary[b] : end].tolist(), strict=True)) == want
    place = np.arange(documents)
    add = search.Found.add

    def counted(self, score, *more):
        nonlocal scored
        scored += len(score)
        add(self, score, *more)

    monkeypatch.setattr(search.Found, "add", counted)
    buffers = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for i in range(50):
        at, weight = vectors[i][0], r.integers(1, 9_000, len(vectors[i][0]))
        order = np.argsort(-weight, kind="stable")
        found = search.Found(20, 0)
        index.search(at[order], weight[order], found, place, place, buffers)
        full = dict(zip(at.tolist(), weight.tolist(), strict=True))
        want = sorted((-sum(full.get(int(c), 0) * int(v) for c, v in zip(*x, strict=True)), k) for k, x in enumerate(vectors))[:20]
        assert list(zip((-found.score).tolist(), found.row.tolist(), strict=True)) == want
        assert not buffers[0].any() and not buffers[1].any()
    assert scored < 0.5 * 50 * documents


# --- 13 quadratic discriminant ------------------------------------------------------------------


def test_discriminant_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in discriminant.report(d, labels).where("held_out").collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    both = [(got[i], y) for i, y in marks.items() if i in got]
    right = sum(r.predicted == y for r, y in both)
    assert len(both) > 50 and right / len(both) > 0.95
    assert sum(r.predicted == 0 for r, y in both if y == 0) >= 0.9 * sum(y == 0 for _, y in both)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_discriminant_equals_plain_densities(spark, docs):
    """Means, covariances, Cholesky factors and the calibrated score, recomputed from the rows in numpy."""
    marks = {r[0]: int(r[0] % 3 > 0) for r in ROWS if r[0] is not None}
    labels = spark.createDataFrame([(i, y) for i, y in marks.items()], "doc_id long, quality int")
    got = discriminant.report(docs, labels).collect()
    train = [(np.array(discriminant.statistics(r[1])), marks[r[0]]) for r in ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    z, y = np.array([v for v, _ in train]), np.array([c for _, c in train])
    x = (z - z.mean(axis=0)) / np.sqrt(np.maximum(z.var(axis=0), 1e-12))
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(covs[c] * (y == c).sum() for c in (0, 1)) / len(y)
    p, density = x.shape[1], []
    for c in (0, 1):
        n = (y == c).sum()
        s = n / (n + discriminant.POOL * p) * covs[c] + (1 - n / (n + discriminant.POOL * p)) * pooled
        s2, tr = np.trace(s @ s), np.trace(s)
        rho = min(1, ((1 - 2 / p) * s2 + tr**2) / ((n + 1 - 2 / p) * (s2 - tr**2 / p)))
        s = (1 - rho) * s + (rho * tr / p + 1e-6) * np.eye(p)
        mean = x[y == c].mean(axis=0)
        density.append(lambda v, s=s, mean=mean: -0.5 * (v - mean) @ np.linalg.solve(s, v - mean) - 0.5 * np.linalg.slogdet(s)[1])
    scores = {}
    for r in ROWS:
        v = (np.array(discriminant.statistics(r[1])) - z.mean(axis=0)) / np.sqrt(np.maximum(z.var(axis=0), 1e-12))
        scores[r[0]] = np.clip(density[1](v) - density[0](v) + math.log(y.mean() / (1 - y.mean())), -discriminant.CLIP, discriminant.CLIP)
    # the calibration is one increasing line for all
    odds = np.array([scores[g.doc_id] for g in got if g.doc_id is not None])
    said = np.array([math.log(g.score / (1 - g.score)) for g in got if g.doc_id is not None])
    slope, at = np.polyfit(odds, said, 1)
    assert slope > 0 and np.abs(slope * odds + at - said).max() < 1e-6


def test_discriminant_edges(spark, docs, none):
    labels = "doc_id long, quality int, toxic int"
    some = spark.createDataFrame([(i, i % 2 if i % 5 else None, 0) for i in range(60)] + [(None, 1, 1), (4, 7, 1)], labels)
    got = discriminant.report(docs, some)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(ROWS)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert discriminant.report(none, some).count() == 0
    for marks, share in (([], 0.0), ([(1, 1, 0), (2, 1, 0), (3, 1, 0)], 1.0), ([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0.0)):
        assert {r.score for r in discriminant.report(docs, spark.createDataFrame(marks, labels)).collect()} == {share}


def test_statistics_of_odd_texts():
    for t in (None, "", " \n\t", "a", "É" * 10, "!" * 1000, "word " * 50_000):
        z = discriminant.statistics(t)
        assert len(z) == len(discriminant.NAMES) and all(map(math.isfinite, z))
    assert discriminant.statistics(None) == discriminant.statistics("")
