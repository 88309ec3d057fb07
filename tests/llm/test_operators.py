"""The ten operators against brute force, on messy rows: nulls, empty and very long texts, ties,
repeated rows, null ids, extra columns."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import decontam, langid, lm, mixing, quality, secrets, shards, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, item string, k long, words string"


def words(r, n, syllables=("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(n))


def messy():
    r = random.Random(11)
    passage = words(r, 120)
    texts = [words(r, r.randrange(1, 200)) for _ in range(60)]
    texts += [words(r, 30) + " " + passage + " " + words(r, 30) for _ in range(12)]
    base = words(r, 300)
    texts += [base] * 4 + [base + " x", base.replace("th", "TH", 3), base[: len(base) // 2]]
    texts += [None, "", " \n\t ", "a", "a b", "É", "123 456 !!", "ab " * 500, "x" * 5000]
    texts += [words(r, 15_000)]
    texts += ['the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "AKIA" + "A1" * 10 + " then Password:  abcdef1 é API_KEY=abc", "deadbeef" * 4, "Secret='s3cr3t-value' éé AKIASHORT"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["hot", "hot", "b", None][i % 4], 0, 0.5, "it", 1, "w") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[70]]  # repeated rows
    rows += [(None, "no id here " + passage, "en", "hot", 0, 0.1, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


ROWS = messy()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return Counter(map(repr, rows))


# --- 10 language identification ---------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(d).join(d.select(F.col("doc_id").alias("i"), "lang"), F.col("doc_id") == F.col("i")).where("held_out")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 200 and right / n > 0.98
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(docs, none):
    got = langid.report(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        t = next((x[1] for x in ROWS if x[0] == r.doc_id), None)
        if r.doc_id is not None and (t is None or not any(c.isalpha() for c in t)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "fr")
    assert langid.report(none).count() == 0
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns
    model = langid.learn(langid.training_rows(docs))
    want = [x for x in ROWS if model.decide(x[1])[2] >= langid.LEAST_SHARE]
    assert counted(map(tuple, kept.collect())) == counted(want)
    assert {x[1] for x in ROWS if x[1] and len(x[1]) > 200 and " th" in x[1]} <= {x[1] for x in want}


def test_texts_of_no_learned_language_are_rejected(spark):
    r = random.Random(12)
    english = [(i, words(r, 60), "en") for i in range(40)]
    other = [(100 + i, words(r, 60, "щы ъж юя эф цх шч".split()), None) for i in range(5)]
    docs = spark.createDataFrame(english + other, "doc_id long, text string, lang string")
    assert {x.doc_id for x in langid.with_language(docs).collect()} == {x[0] for x in english}


def test_more_languages_than_bits_in_a_word(spark):
    r = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    speech = {f"l{i:02d}": [letters[i % 26] + letters[(i * 7 + k * (i // 26 + 1)) % 26] + letters[(i + 3 * k) % 26] for k in range(4)] for i in range(70)}
    rows = [(n * 10 + j, words(r, 40, own), lang) for n, (lang, own) in enumerate(speech.items()) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in langid.report(docs).collect()}
    right = sum(got[i] == lang for i, _, lang in rows)
    assert right > 0.95 * len(rows) and len(set(got.values())) == 70
    # the corrected counts, against exact sets of n-grams
    model = langid.learn(langid.training_rows(docs))
    exact = defaultdict(set)
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            exact[lang].update(langid.gram_codes(t).tolist())
    for i, t, _ in rows[::40]:
        codes = langid.gram_codes(t).tolist()
        got_n, n = model.counts(t)
        corrected = (got_n / n - model.fill**langid.HASHES) / (1 - model.fill**langid.HASHES)
        for k, lang in enumerate(model.languages):
            assert corrected[k] == pytest.approx(sum(c in exact[lang] for c in codes) / n, abs=0.03)


def test_bloom_filter_holds_every_gram_of_its_language():
    codes = [langid.gram_codes("the other one"), langid.gram_codes("der andere hier")]
    table = np.zeros((1 << langid.SLOTS_LOG2, 1), dtype=np.uint64)
    for i, c in enumerate(codes):
        for s in langid.slots_of(c):
            table[s, 0] |= np.uint64(1 << i)
    f = langid.Filter(["en", "de"], table)
    assert all(((f.masks(c)[:, 0] >> np.uint64(i)) & np.uint64(1)).all() for i, c in enumerate(codes))
    assert f.decide("the other one")[0] == "en" and f.decide("der andere hier")[0] == "de"


# --- 1 toxicity ----------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.report(d, l).join(l.select(F.col("doc_id").alias("i"), "toxic"), F.col("doc_id") == F.col("i")).where("held_out").collect()
    pos, neg = [x.score for x in got if x.toxic], [x.score for x in got if not x.toxic]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.9
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)


def test_toxicity_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(0, 60)] + [(2, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= x.score <= 1 for x in got)
    same = defaultdict(set)
    for x in got:
        if x.doc_id is not None:
            same[next(r[1] or "" for r in ROWS if r[0] == x.doc_id)].add(x.score)
    assert all(len(v) == 1 for v in same.values())
    assert toxicity.report(none, labels).count() == 0
    # without labels of both classes
    assert {x.predicted for x in toxicity.report(docs, labels.where("toxic = 0")).collect()} == {0}


def plain_toxicity(model, text):
    """The score of a text, n-gram by n-gram."""
    weight, low = dict(zip(model.features.tolist(), model.weight.tolist(), strict=True)), (text or "").lower()
    shown = " " + "".join(c if c.isalpha() else " " for i, c in enumerate(low) if c.isalpha() or (i and low[i - 1].isalpha())) + " "
    hit = set()
    for n in toxicity.SIZES if low else ():
        for a in range(len(shown) - n + 1):
            code = n
            for c in shown[a : a + n]:
                code = (code * 0x100000001B3 % 2**64) ^ ord(c)
            hit.add((code * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BUCKETS_LOG2))
    z = model.intercept + sum(weight.get(b, 0.0) for b in hit)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def test_toxicity_equals_plain_scores(spark, docs):
    r = random.Random(9)
    texts = [(words(r, 20) + (" you awful thing" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(texts, "text string, toxic int"))
    short = docs.where("text IS NULL OR length(text) < 3000")
    by_id = {x.doc_id: x.text for x in short.where("doc_id IS NOT NULL").collect()}
    got = [x for x in toxicity.score(short, model).collect() if x.doc_id is not None]
    assert len(got) > 80 and len({x.score for x in got}) > 20
    for x in got:
        assert x.score == pytest.approx(plain_toxicity(model, by_id[x.doc_id]), abs=1e-9)


# --- 2 sharding ----------------------------------------------------------------------------------


def check_shards(rows, ways):
    texts, sizes, slots = defaultdict(set), Counter(), defaultdict(list)
    for text, shard, size, slot in rows:
        texts[text].add(shard)
        sizes[shard] += size
        slots[shard].append(slot)
    assert all(len(v) == 1 for v in texts.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return [sizes[i] for i in range(ways)]


def test_sharding_edges(docs, none):
    got = shards.shard(docs).collect()
    by_id = {r[0]: r[1] or "" for r in ROWS}
    assert len(got) == len(ROWS) and {g.law for g in got} == {"bytes"} and {g.grown_shard for g in got} == {None}
    for g in got:
        if g.doc_id is not None:
            t = by_id[g.doc_id].encode()
            assert (g["size"], g.text_crc32) == (len(t) + 8, zlib.crc32(t))
    check_shards([(g.text_crc32, g.shard, g["size"], g.slot) for g in got], shards.SHARDS)
    assert shards.shard(none).count() == 0


def test_differencing_beats_or_equals_one_item_of_spread():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 24, 100, 3000):
        sizes = r.integers(8, 5000, n)
        part = shards.difference(sizes, 24)
        sums = np.bincount(part, weights=sizes, minlength=24)
        assert part.min() >= 0 and part.max() < 24
        assert sums.max() - sums.min() <= sizes.max()
        if n == 3000:
            assert sums.max() - sums.min() <= 8


def plain_differencing(sizes, ways):
    """Sums of the parts: the two partial partitions of largest spread are combined, oppositely ordered."""
    parts = [(i, sorted([int(x)] + [0] * (ways - 1), reverse=True)) for i, x in enumerate(sorted(sizes, reverse=True))]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0] - p[1][-1]), p[0]))
        (_, a), (_, b) = parts[:2]
        parts = [*parts[2:], (made, sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))]
        made += 1
    return parts[0][1]


@pytest.mark.parametrize("ways", [2, 5, 24])
def test_differencing_equals_the_plain_rule(ways):
    r = np.random.default_rng(ways)
    for n in (1, 3, 24, 60, 200):
        sizes = r.integers(8, 5000, n)
        sums = np.bincount(shards.difference(sizes, ways), weights=sizes, minlength=ways)
        assert sorted(sums.tolist(), reverse=True) == plain_differencing(sizes, ways)


def test_bundles_stay_balanced(spark, monkeypatch):
    monkeypatch.setattr(shards, "TOP", 4_000)
    r = random.Random(4)
    sizes = [r.randrange(8, 4000) for _ in range(20_000)] + [60_000, 200_000]
    groups = spark.createDataFrame([(f"g{i}", s) for i, s in enumerate(sizes)], "item string, size long")
    assert shards.bundled(groups, len(sizes), sum(sizes), 4_000).select("bundle").distinct().count() < 4_000
    got = {x.item: x.shard for x in shards.assign(groups).collect()}
    assert len(got) == len(sizes)
    sums = Counter()
    for i, s in enumerate(sizes):
        sums[got[f"g{i}"]] += s
    assert max(sums.values()) - min(sums.values()) < 0.0005 * sum(sizes) / 24


# --- 3 language model ------------------------------------------------------------------------------


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def test_language_model_counts_and_base(docs, none):
    train = Counter()
    for r in ROWS:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            train.update(tokens(r[1]))
    n, v = sum(train.values()), len(train)
    want = []
    for r in ROWS:
        w = tokens(r[1])
        want.append((r[0], len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = lm.report(docs).collect()
    assert counted(want) == counted([(g.doc_id, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got])
    assert all(g.score < 0 and math.isfinite(g.score) for g in got)
    assert lm.report(none).count() == 0


def test_language_model_beats_the_base_on_held_out_documents(spark):
    got = lm.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(*[F.sum(c).alias(c) for c in ("score", "base_score", "n_tokens")]).first()
    assert got.score / got.n_tokens > got.base_score / got.n_tokens + 0.15


def test_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    r = random.Random(9)
    docs = spark.createDataFrame([(i, words(r, r.randrange(1, 120))) for i in range(300)] + [(None, "a b"), (7, None)], "doc_id long, text string")
    monkeypatch.setattr(lm, "PART", 20_000)
    once, other = ({(x.doc_id, x.n_tokens): x for x in lm.report(docs.repartition(n)).collect()} for n in (1, 7))
    assert once.keys() == other.keys()
    assert all(x.base_score == pytest.approx(other[k].base_score) and x.score == pytest.approx(other[k].score, rel=1e-4) for k, x in once.items())


def test_counts_over_many_shards(spark, monkeypatch):
    r = random.Random(10)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(200)) for _ in range(20)]
    monkeypatch.setattr(lm, "PART", 2_000)
    packed = lm.packs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert packed.count() > 3
    monkeypatch.setattr(lm, "SHARD", 100)
    answers, shards = lm.counted(packed)
    assert shards > 10
    corpus = lm.Corpus(answers, shards)
    train = Counter(w for i, t in enumerate(texts) if not lm.held_out(i) for w in tokens(t))
    assert (corpus.n, corpus.v) == (sum(train.values()), len(train))
    got = {x.doc_id: x for x in lm.score(packed, answers, corpus, lm.Model(corpus)).collect()}
    for i, t in enumerate(texts):
        base = sum(math.log10((train[w] + 1) / (corpus.n + corpus.v + 1)) for w in tokens(t))
        assert got[i].base_score == pytest.approx(base) and got[i].n_known == sum(train[w] > 0 for w in tokens(t))


def plain_log_probability(m, leaf, features):
    """P(leaf) from the tables, outcome by outcome."""
    total, first = 0.0, 0
    for level in range(lm.LEVELS):
        node = [0, leaf // lm.WAYS**2, leaf // lm.WAYS][level]
        z = m.bias[level][node].astype(float).copy()
        for i, f in enumerate(lm.FEATURES[level]):
            z += m.tables[first + i][lm.table_rows(level, features[f], np.array([node]))[0]]
        first += len(lm.FEATURES[level])
        total += z[leaf // lm.WAYS ** (lm.LEVELS - 1 - level) % lm.WAYS] - math.log(np.exp(z).sum())
    return total


def test_class_probabilities_sum_to_one_and_equal_plain_ones():
    class Corpus:
        leaf_n = np.arange(lm.LEAVES, 0, -1)

    m = lm.Model(Corpus)
    r = np.random.default_rng(2)
    for t in m.tables:
        t += r.normal(0, 0.3, t.shape).astype(np.float32)
    every = np.arange(lm.LEAVES, dtype=np.int32)
    features = [np.full(len(every), k, dtype=np.int32) for k in (7, 8, 4_000, lm.LEAVES, 123_456)]
    got = lm.log_probabilities(m, every, features)
    assert np.exp(got).sum() == pytest.approx(1.0, abs=1e-4)
    for leaf in (0, 17, 1_500, lm.LEAVES - 1):
        assert got[leaf] == pytest.approx(plain_log_probability(m, leaf, [f[:1] for f in features]), abs=1e-4)


def test_gradient_steps_raise_the_likelihood():
    class Corpus:
        leaf_n = np.full(lm.LEAVES, 10)

    leaves = np.tile(np.array([3, 700, 1050, 9, 4_042], dtype=np.int32), 2_000)
    lengths = np.array([len(leaves)])
    m = lm.Model(Corpus)
    f = lm.contexts(leaves, lengths)
    before = lm.log_probabilities(m, leaves, f).mean()
    trainer = lm.Trainer(m)
    trainer.learn(leaves, f)
    assert lm.log_probabilities(trainer.model, leaves, f).mean() > before + 1
    assert not any(t.any() for t in m.tables)  # the weights of the round stay


# --- 4 secrets ----------------------------------------------------------------------------------------


def test_secret_base_spans(docs, none):
    assign = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    want = []
    for r in ROWS:
        t = r[1] or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        line = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
        want.append((r[0], *[sum(x[1] == k for x in found) for k in range(3)], hashlib.sha256(line.encode()).hexdigest()))
    got = secrets.report(docs).collect()
    assert counted(want) == counted([(g.doc_id, g.n_assign, g.n_access, g.n_hex, g.base_sha256) for g in got])
    for g in got:
        base = ",".join(x for x in g.spans.split(",") if not x.startswith("model"))
        assert hashlib.sha256(base.encode()).hexdigest() == g.base_sha256
    assert secrets.report(none).count() == 0


def test_network_gradients_and_learning():
    r = random.Random(1)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]
    numbers = ["".join(r.choice("0123456789") for _ in range(16)) for _ in range(300)]
    x = np.frombuffer(b"".join(secrets.window(f"the value {w} is here", 10, 10 + len(w)) for w in hexes + numbers), dtype=np.uint8).reshape(-1, secrets.WIDTH)
    y = np.array([1.0] * 300 + [0.0] * 300, dtype=np.float32)
    net = secrets.Network()
    w = np.ones(len(y))
    loss = lambda: float(np.mean(np.logaddexp(0, net.logits(x)) - y * net.logits(x)))
    grads = net.gradients(x, y, w)
    for table, g in zip((net.embed, net.conv, net.bias, net.out), grads, strict=False):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = table[at]
        table[at] = old + 1e-2
        up = loss()
        table[at] = old - 1e-2
        down = loss()
        table[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.15, abs=1e-3)
    net.train(x, y).calibrate(x, y, np.ones(len(y)))
    assert ((net.probability(x) >= net.threshold) == (y == 1)).mean() > 0.95


def test_the_network_adds_what_the_patterns_miss(spark):
    r = random.Random(8)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'some token = "{key()}" and {r.randrange(10**15, 10**16)} more words') for i in range(300)]
    rows += [(1000, f"bare {key().upper()} here"), (1001, f"number {r.randrange(10**15, 10**16)} here")]
    got = {g.doc_id: g.spans for g in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "model:5:45" in got[1000] and got[1001] == ""


def test_candidates_of_runs_and_values():
    cut = lambda t: [t[a:b] for a, b in secrets.candidates(t)]
    assert cut("pwd: hunter2x and the rest") == ["hunter2x"]
    assert cut("passphrase=abcdefghij12 ok") == ["abcdefghij12"]
    assert cut("x AbCdEfGhIjKlMnOpQrSt y") == ["AbCdEfGhIjKlMnOpQrSt"]  # no digit
    assert cut("a/path/of/many/small/words/only") == [] and cut("so it was: yes") == [] and cut("") == []
    assert cut('key = "deadbeefdeadbeefdeadbeef"') == ["deadbeefdeadbeefdeadbeef"]


def test_recall_on_planted_secrets(spark):
    r = random.Random(10)
    some = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(a) for _ in range(n))
    learnt = [(i, f"{words(r, 10)} {r.choice(['secret', 'token', 'password', 'api_key'])} = '{some(r.randrange(8, 44))}' {words(r, 5)}") for i in range(400)]
    learnt += [(1000 + i, f"{words(r, 10)} {r.choice(['note', 'and', 'said', 'name'])}: {words(r, 4)} {r.randrange(10**16, 10**17)} {words(r, 3)}") for i in range(400)]
    kinds = [lambda: "ghp_" + some(36), lambda: "Bearer " + some(40), lambda: "xoxb-" + some(12, "0123456789") + "-" + some(24), lambda: "pwd: " + some(12), lambda: "auth = " + some(24, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    planted = [(2000 + i, f"{words(r, 10)} {kinds[i % 5]()} {words(r, 5)}") for i in range(100)]
    clean = [(3000 + i, f"{words(r, 20)} said: {words(r, 5)} {r.randrange(10**16, 10**17)}.") for i in range(100)]
    model = secrets.learn(spark.createDataFrame(learnt, "doc_id long, text string"))
    got = {x.doc_id: x.spans for x in secrets.scan(spark.createDataFrame(planted + clean, "doc_id long, text string"), model).collect()}
    assert sum(bool(got[i]) for i, _ in planted) >= 90
    assert sum(bool(got[i]) for i, _ in clean) <= 5


def test_recall_on_kinds_that_neither_patterns_nor_templates_name(spark):
    """400 secrets of eight kinds in documents of sf0.01, whose few findings are all there is to learn from.

    The names are in no template; some shapes are (prefixed and chat tokens, three parts).
    """
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = lambda n, a=letters + letters.upper() + "0123456789": "".join(r.choice(a) for _ in range(n))
    kinds = [
        lambda: "ghp_" + some(36), lambda: "Bearer " + some(40), lambda: base64.b64encode(r.randbytes(30)).decode(), lambda: "xoxb-" + some(12, "0123456789") + "-" + some(24),
        lambda: "eyJ" + some(17) + ".eyJ" + some(30) + "." + some(43), lambda: "pwd: " + some(12), lambda: "passphrase=" + some(14, letters + "0123456789"), lambda: "auth_value = " + some(24, letters + letters.upper()),
    ]
    assert not {"pwd", "passphrase", "auth_value"} & set(secrets.NAMES)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [x.text for x in d.orderBy("doc_id").collect() if x.text and len(x.text) > 200]
    rows, where = [], {}
    for i in range(400):
        parts = texts[i % len(texts)].split(" ")
        at, value = r.randrange(len(parts)), kinds[i % 8]()
        before = " ".join(parts[:at]) + " "
        rows.append((i, before + value + " " + " ".join(parts[at:])))
        where[i] = (len(before), len(before) + len(value))
    model = secrets.learn(d)
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sum(any(x.start < where[g.doc_id][1] and x.end > where[g.doc_id][0] for x in g.spans) for g in got) >= 360
    added = secrets.scan(d, model).select(F.explode("spans").alias("s")).where("s.kind = 'model'").count()
    assert added <= 5


def test_no_model_without_findings_to_set_aside(spark):
    """One finding of either label can't both teach and calibrate."""
    few = spark.createDataFrame([(1, "secret = 'abcdef123456' and"), (2, "said: hello12 there")], "doc_id long, text string")
    assert secrets.learn(few) is None
    assert [x.spans for x in secrets.report(few).orderBy("doc_id").collect()] == ["assign:0:22", ""]


def test_every_finding_of_all_documents_is_learnt_from_in_packs(spark, monkeypatch):
    """More findings than the 3,000 of a label that were once learnt from: three quarters teach, the rest calibrates."""
    r = random.Random(12)
    token = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    rows = [(None if i % 2 else 7, f"so token = {token()} it" if i < 4000 else f"so number {r.randrange(10**17, 10**18)} it") for i in range(8000)]
    taught, placed = [], []
    train, place = secrets._train, secrets.Network.place
    monkeypatch.setattr(secrets, "_train", lambda d: taught.append({x.label: x["count"] for x in d.where("not made").groupBy("label").count().collect()}) or train(d))
    monkeypatch.setattr(secrets.Network, "place", lambda self, z, y, n: placed.append((n[y == 0].sum(), n[y == 1].sum())) or place(self, z, y, n))
    monkeypatch.setattr(secrets, "EPOCHS", 2)
    monkeypatch.setattr(secrets, "TEMPLATES", 200)
    monkeypatch.setattr(secrets, "_doubtful", lambda single, made: single.withColumn("doubtful", F.lit(False)))
    monkeypatch.setattr(secrets, "PACK", 5000)
    model = secrets.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(taught[0].values()) == 6000 and len(taught) == 1  # in four packs
    assert all(2800 < n < 3600 for n in placed[0])  # a thousand shown in three ways, and templates
    seen = lambda t, a, b: model.probability(np.frombuffer(secrets.window(t, a, b), dtype=np.uint8).reshape(1, -1))[0]
    assert seen("so number 123456789123456789 it", 10, 28) < model.threshold <= seen("so token = aB3dE6gH9jK2mN5pQ8sT1vW4 it", 11, 35)


def test_windows_cover_whole_candidates():
    r = random.Random(3)
    for n in (1, 16, 39, 40, 41, 64, 65, 200, 1_001):
        text = "ab " + "".join(r.choice("abcdef0123456789") for _ in range(n)) + " cd"
        own = secrets.windows(text, 3, 3 + n)
        inside = [x[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE].rstrip(b"\0") for x in own]
        whole = secrets.window(text[3 : 3 + n].ljust(1), 0, 1)[:0] + b"".join(secrets.window(c, 0, 1)[secrets.BEFORE : secrets.BEFORE + 1] for c in text[3 : 3 + n])
        at = [whole.find(x) for x in inside]
        assert at[0] == 0 and at[-1] + len(inside[-1]) == n and all(b <= a + len(x) for a, b, x in zip(at, at[1:], inside))


def test_overlaps_of_many_spans():
    r = random.Random(4)
    base = sorted((a, r.randrange(3), a + r.randrange(1, 60)) for a in (r.randrange(5_000) for _ in range(200)))
    spans = secrets.Spans(base)
    for _ in range(500):
        s = r.randrange(5_000)
        e = s + r.randrange(1, 40)
        assert spans.overlap(s, e) == any(a < e and s < b for a, _, b in base)
    assert not secrets.Spans([]).overlap(0, 5)


# --- 5 substrings -------------------------------------------------------------------------------------


def brute_repeats(texts, length=substrings.LENGTH):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_repeated_strings(docs, hot):
    texts = [r[1] for r in ROWS]
    shorter = [x[1] for x in brute_repeats(texts, substrings.PASSAGE)]
    want = [(r[0], *x, y) for r, x, y in zip(ROWS, brute_repeats(texts), shorter, strict=True)]
    got = substrings.remove_repeats(docs, hot=hot).collect()
    assert counted(want) == counted([(g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256, g.n_repeated) for g in got])
    assert all(hashlib.sha256(g.kept).hexdigest() == g.kept_sha256 for g in got)


@pytest.mark.parametrize("ids", ["null", "same", "both"])
def test_rows_without_an_id_of_their_own(spark, ids):
    """Hundreds of rows that share or lack an id: the right results, and work that grows with the rows."""
    r = random.Random(21)
    shared = words(r, 160)
    texts = [words(r, 60) + " " + (shared if i % 3 == 0 else "") + words(r, 60) for i in range(300)] + [shared] * 200
    rows = [({"null": None, "same": 7, "both": (None, 7)[i % 2]}[ids], t) for i, t in enumerate(texts)]
    began = time.time()
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert time.time() - began < 60
    want = Counter((x[0], *y) for x, y in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want


def passages(bodies, words=50):
    """(document, first byte, last byte) of the maximal runs that strings of so many words cover which stand in other documents too."""
    places = [[m.span() for m in re.finditer(rb"\S+", b)] for b in bodies]
    holders = defaultdict(set)
    for d, (b, p) in enumerate(zip(bodies, places, strict=True)):
        for i in range(len(p) - words + 1):
            holders[hash(b[p[i][0] : p[i + words - 1][1]])].add(d)
    out = []
    for d, (b, p) in enumerate(zip(bodies, places, strict=True)):
        at = None
        for i in range(len(p) - words + 1):
            if len(holders[hash(b[p[i][0] : p[i + words - 1][1]])]) > 1:
                if at is None or p[i][0] > at[1]:
                    if at:
                        out.append((d, *at))
                    at = [p[i][0], p[i + words - 1][1]]
                at[1] = p[i + words - 1][1]
        if at:
            out.append((d, *at))
    return out


def test_repeated_passages_of_the_tables(spark):
    """Every document of sf0.01 against windows counted one by one, and every passage of 50 words or more by its length."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, (x.text or "").encode()) for x in docs.select("doc_id", "text").collect()]
    bodies = [b for _, b in rows]
    seen = Counter(hash(b[i : i + substrings.LENGTH]) for b in bodies for i in range(len(b) - substrings.LENGTH + 1))
    gone = []
    for b in bodies:
        mask = np.zeros(len(b) + 1, dtype=np.int64)
        for i in range(len(b) - substrings.LENGTH + 1):
            if seen[hash(b[i : i + substrings.LENGTH])] > 1:
                mask[i] += 1
                mask[i + substrings.LENGTH] -= 1
        gone.append(np.cumsum(mask)[:-1] > 0)
    got = {x.doc_id: x for x in substrings.report(docs).collect()}
    for (i, b), g in zip(rows, gone, strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~g]) if len(b) else b""
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), int(g.sum()), hashlib.sha256(kept).hexdigest())
    # a passage goes whole if it has 400 bytes, and stays if it is shorter and in no longer repeat
    found = passages(bodies)
    long = [x for x in found if x[2] - x[1] >= substrings.LENGTH]
    assert all(gone[d][a:e].all() for d, a, e in long)
    short = [x for x in found if x[2] - x[1] < substrings.LENGTH]
    kept = [x for x in short if not gone[x[0]][x[1] : x[2]].any()]
    print(f"passages {len(found)}, of 400 bytes {len(long)}, shorter {len(short)}, of these untouched {len(kept)}")
    assert len(long) > 50 and len(short) > 20
    # all of them, short or long, count as repeated
    assert all(got[rows[d][0]].n_repeated >= e - a for d, a, e in found if e - a >= substrings.PASSAGE)


def test_passages_across_pieces_and_runs(spark, monkeypatch):
    """Passages of all lengths in other texts, repeats within a text, and pieces that cut texts anywhere."""
    r = random.Random(21)
    shared = [words(r, n) for n in (30, 52, 60, 75, 90, 140)]
    texts = [words(r, 40) + " " + shared[i % 6] + " " + words(r, r.randrange(30, 90)) for i in range(24)]
    texts += [texts[0] + "!", shared[4], shared[5] + shared[5], "ab" * 400, "ab" * 300, "é" * 500, "x" * 255, "x" * 256, shared[3][:256], shared[3][:255]]
    monkeypatch.setattr(substrings, "PIECE", 700)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [(i, *x[1:3], y[1]) for i, (x, y) in enumerate(zip(brute_repeats(texts), brute_repeats(texts, substrings.PASSAGE), strict=True))]
    assert counted(want) == counted([(g.doc_id, g.n_removed, g.n_spans, g.n_repeated) for g in substrings.remove_repeats(docs).collect()])
    cut = [list(substrings.segments([t.encode()])) for t in texts]
    for t, own in zip(texts, cut, strict=True):
        n = max(0, len(t.encode()) - substrings.PASSAGE + 1)
        assert sorted(w for _, s, e, *_ in own for w in range(s, e + 1)) == list(range(n))


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_texts_that_end_alike_short_of_a_removed_string(spark, hot):
    """Ends of 256 to 399 common bytes stay, whatever follows them in a suffix array; one of 400 goes."""
    r = random.Random(22)
    some = lambda n, a="abcdefgh ": "".join(r.choice(a) for _ in range(n))
    texts = [some(100) + mark + tail for tail in (some(n) for n in (256, 300, 390, 397, 398, 399, 400, 401)) for mark in "xyz"]
    binary = [some(r.choice((1, 255, 300, 399, 400, 700)), "ab") for _ in range(6)]
    texts += ["".join(r.choice(binary)[-r.randrange(1, 800) :] for _ in range(r.randrange(1, 5))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {(i, *x) for i, x in enumerate(brute_repeats(texts))}
    assert {(g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in substrings.remove_repeats(docs, hot=hot).collect()} == want
    assert all(x[2] == 0 for x in want if x[0] < 18) and all(x[2] for x in want if 18 <= x[0] < 24)


def test_no_rows_no_repeats(none):
    assert substrings.report(none).count() == 0


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 70))
        t = r.integers(1, 4, n).astype(np.uint8)
        t[-1] = 0
        order, b = substrings.suffix_array(t, 80), bytes(t)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        whole = np.concatenate([t, np.zeros(16, dtype=np.uint8)])
        for got, n in zip(substrings.same_as_before(t, order, (16, 8)), (16, 8), strict=True):
            rows = [bytes(whole[o : o + n]) for o in order]
            assert got.tolist() == [i > 0 and rows[i - 1] == rows[i] for i in range(len(rows))]


# --- 6 decontamination -----------------------------------------------------------------------------------


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(texts, items):
    windows = defaultdict(set)
    for item, t in items:
        w = bench_words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    out = []
    for t in texts:
        w, hit, own = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                if g in windows:
                    hit.update(range(i, i + n))
                    own |= windows[g]
        out.append((len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items():
    long = ROWS[62][1].split()
    return [(1, " ".join(long[35:70])), (2, "Ab, AB! ab"), (10, " ".join(long[36:46])), (3, None), (4, ""), (5, "--- !"), (6, "qqq zzz"), (6, " ".join(long[100:115]))]


def brute_longest(t, items):
    """(words, offset) of the longest common run of words with an item; the first, if several."""
    w, best = bench_words(t), (0, 0)
    for _, i in items:
        own = bench_words(i)
        for a in range(len(w)):
            for b in range(len(own)):
                n = 0
                while a + n < len(w) and b + n < len(own) and w[a + n] == own[b + n]:
                    n += 1
                best = max(best, (n, -a))
    return best[0], -best[1]


@pytest.mark.parametrize("most", [decontam.MAX_BROADCAST, 200])
def test_benchmark_windows(spark, docs, none, items, most):
    b = spark.createDataFrame(items, "item_id long, text string")
    matches = decontam.match_benchmark(docs, b, max_broadcast=most).cache()
    want = [(r[0], *x) for r, x in zip(ROWS, brute_hits([r[1] for r in ROWS], items), strict=True)]
    assert counted(want) == counted([tuple(g) for g in decontam.report(matches).collect()])
    by_id = {r[0]: r[1] for r in ROWS}
    for x in matches.where("n_hit > 0 and doc_id is not null").collect():
        assert (x.longest.words, x.longest.start) == brute_longest(by_id[x.doc_id], items)
        text = " ".join(bench_words(by_id[x.doc_id])[x.longest.start : x.longest.start + x.longest.words])
        assert any(str(i) == x.longest.item and text in " ".join(bench_words(t)) for i, t in items)
    assert matches.where("n_hit = 0 and longest is not null").isEmpty()
    assert decontam.match_benchmark(none, b).count() == 0 and decontam.match_benchmark(docs, b.limit(0)).where("n_hit > 0").count() == 0


def test_longest_matches_of_periodic_texts():
    items = [("a", "x y " * 40), ("b", "z " * 30), ("c", "p q r")]
    windows = decontam.Windows(items, 10)
    texts = ["x y " * 15 + "w", "k " + "z " * 50, "y x " * 60, "p q r s", "n " * 5 + "z " * 12 + "x y x y x y x y x y x y x y"]
    _, _, _, best = decontam.search_shard(texts, windows)
    assert {d: best[d][:2] for d in best} == {d: brute_longest(t, items) for d, t in enumerate(texts)}


@pytest.mark.parametrize("most", [decontam.MAX_BROADCAST, 200])
def test_decontaminate_keeps_clean_rows(spark, docs, items, most):
    kept = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), most)
    hit = brute_hits([r[1] for r in ROWS], items)
    assert kept.columns == docs.columns
    assert counted([tuple(r) for r in kept.collect()]) == counted([r for r, h in zip(ROWS, hit, strict=True) if not h[-1]])


# --- 7 quality ---------------------------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality_counts(spark, docs, none):
    extra = [(500, "one two\n\none two\n  \n  \none two x # * |", "en", "b", 0, 0.0, "", 0, ""), (501, "a b c d e f g h i " * 3, "en", "b", 0, 0.0, "", 0, "")]
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality.report(both, labels).collect()
    want = [(r[0], *brute_quality(r[1])) for r in [*ROWS, *extra]]
    assert counted(want) == counted([tuple(g)[:7] for g in got])
    assert not any(g.base_failed and g.kept for g in got)
    assert quality.report(none, labels).count() == 0


@pytest.mark.parametrize("n,k", [(100, 0), (1000, 3), (5000, 70), (20000, 350), (5_000_000, 99_000), (50, 20), (0, 0)])
def test_binomial_tail(spark, n, k):
    p = quality.ALPHA
    got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("p")).first().p
    if n == 0 or k >= n * p:
        assert got == 1.0
    else:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert got == pytest.approx(exact, rel=1e-6)


def test_cutoffs_reject_bad_rows_and_spare_good_ones(spark):
    r = random.Random(6)
    rows = [(i, words(r, 60), "en") for i in range(1500)] + [(5000 + i, " ".join(w + "***" for w in words(r, 60).split()), "en") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1500)] + [(5000 + i, 0, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {g.doc_id: g.kept for g in quality.report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert sum(not got[i] for i in range(1500)) <= 1500 * quality.ALPHA * len(quality.GRIDS)
    assert not any(got[5000 + i] for i in range(200))


def test_every_language_is_a_stratum(spark):
    r = random.Random(15)
    text = words(r, 60)
    rows = [(i, text, f"l{i % 80:02d}") for i in range(80 * 30)] + [(9_000 + i, text, None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    strata = quality.features(docs).select("stratum").distinct().count()
    assert strata == 81
    assert quality.report(docs, labels).where("kept").count() == len(rows)


# --- 8 near-duplicates -----------------------------------------------------------------------------------------


def brute_fingerprint(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=2):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def test_fingerprints_and_components(docs, none):
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(ROWS, fps, brute_components([r[0] for r in ROWS], fps), strict=True)]
    assert counted(want) == counted([tuple(g) for g in simhash.report(docs).collect()])
    assert simhash.report(none).count() == 0


@pytest.mark.parametrize("tree", [simhash.TREE, 16])
def test_links_of_dense_fingerprints(spark, tree):
    r = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        f = r.getrandbits(64)
        for _ in range(r.randrange(1, 12)):
            fps.add(f)
            f ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                f ^= 1 << r.randrange(64)
            if r.random() < 0.3:
                f ^= 7
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tree)).collect()
    comp = {x.node: x.component for x in found}
    want = brute_components(list(range(len(fps))), fps)
    groups = defaultdict(set)
    for s, w in zip(signed, want, strict=True):
        groups[w].add(comp.get(s, s))
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_tree_search_equals_scanning():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(5), base ^ np.uint64(7 << 40)]))
    got = {(n, q) for n, near in simhash.Tree(points[:, None]).search(points[:, None], 2) for q in near.tolist()}
    assert got == {(i, j) for i in range(len(points)) for j in range(len(points)) if int(points[i] ^ points[j]).bit_count() <= 2}


# --- 9 mixing ---------------------------------------------------------------------------------------------------


def brute_schedule(weights, period):
    done, out = dict.fromkeys(weights, 0), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // w), s or "", s) for s, w in weights.items() if done[s] < w and done[s] * period // w <= t]
        assert ready
        s = min(ready)[2]
        out.append((s, done[s], t))
        done[s] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 3, "b": 2, "c": 5}, {"a": 50, **{f"s{i:02d}": 1 for i in range(50)}}, {"x": 1, "y": 98, "z": 1}])
def test_schedule_is_fair_and_earliest_deadline_first(spark, weights):
    period = sum(weights.values())
    got = mixing.schedule(spark.createDataFrame(list(weights.items()), "source string, weight long"), period).orderBy("slot").collect()
    assert [(g.source, g.k, g.slot) for g in got] == brute_schedule(weights, period)
    done = Counter()
    for t, g in enumerate(got, 1):
        done[g.source] += 1
        assert all(abs(done[s] - t * w / period) < 1 for s, w in weights.items())


def test_mixture_keeps_all_rows(docs, none):
    got = mixing.mix(docs, block_bytes=2_000).collect()
    assert counted([g.doc_id for g in got]) == counted([r[0] for r in ROWS])
    assert sorted(g.position for g in got) == list(range(len(ROWS)))
    slots = [g.slot for g in sorted(got, key=lambda g: g.position)]
    assert slots == sorted(slots)
    by = defaultdict(set)
    for g in got:
        by[g.slot].add((g.source, g.block))
    assert all(len(v) == 1 for v in by.values())
    assert {g.source for g in got} == {"hot", "b", None}
    assert mixing.mix(none).count() == 0
    ordered = mixing.mixed_order(docs)
    assert ordered.columns == docs.columns and counted([tuple(r) for r in ordered.collect()]) == counted(ROWS)


def test_rows_without_an_id_stand_by_their_texts(spark, monkeypatch):
    """Blocks of many null and repeated ids against running sums in the order of the hash."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    r = random.Random(4)
    rows = [(None if i % 3 else i % 2, words(r, 1 + i % 17), "hot" if i % 4 else None) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_bytes=1_000).collect()
    sums, want = Counter(), Counter()
    mark = {row: hashlib.md5((("" if row[0] is None else str(row[0])) + "mixing" + hashlib.md5(row[1].encode()).hexdigest()).encode()).hexdigest() for row in rows}
    for row in sorted(rows, key=lambda row: mark[row]):
        want[(row[0], row[2], sums[row[2]] // 1_000)] += 1
        sums[row[2]] += len(row[1].encode()) + mixing.OVERHEAD
    assert Counter((g.doc_id, g.source, g.block) for g in got) == want
    assert sorted(g.position for g in got) == list(range(300))
    # each text has its own place, so the order of a table does not gather rows without an id
    assert mixing.places(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == len({row[:2] for row in rows})


def test_weights_fill_the_period(spark):
    w = mixing.weights_from_bytes(spark.createDataFrame([("a", 10**9), ("b", 10**6), ("c", 1), (None, 5)], "source string, bytes long")).collect()
    assert sum(x.weight for x in w) == mixing.PERIOD and all(x.weight >= 1 for x in w)


# --- SQL ----------------------------------------------------------------------------------------------------------


def test_oracles(spark):
    from parley.llm.entries import ORACLES, QUERIES

    from ..helpers import same, tables

    for name, sql in ORACLES.items():
        same(QUERIES[name](spark, "/root/testdata/sf0.001"), tables("/root/testdata/sf0.001"), sql)
    assert duckdb.__version__
