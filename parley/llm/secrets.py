"""Secret scanning: fixed patterns, and a character convolutional network over further candidates.

Patterns give the base spans. Candidates are runs of 16 or more key-like characters that have a
digit or a capital after a small letter, and values of six or more after a name and a sign; a small
convolutional network in numpy reads each together with its surrounding context, a long one window
by window, and decides by the highest score whether it is added as a ``model`` span.

The network is trained on labelled findings: the distinct candidates of all documents, labelled by
whether a base pattern found them. Each is also shown without its context, and so in capitals, so
that shape counts as well as context. As the patterns find only their own kinds, labelled templates
join them (``templates``): random values of many shapes behind other names and signs, and harmless
ones (words, numbers, dates, paths), within the words that stand in most of the documents. Training
goes in packs: in each epoch every pack is passed once from the same weights, and the weights and
moments of all packs are averaged; up to ``PACK`` windows are one pack. Scores are calibrated
(Platt) on a quarter of the findings and templates, which training does not see, counted by score. Among the
thresholds of 0.5 or more that keep a recall of ``RECALL`` there, the lowest with the best precision is
used. Unmatched candidates that look like secrets to a network trained on the other half are left
out of training, as they may be just what the patterns miss, but not out of calibration.

Defined cases: a null text is empty; very long texts are read whole; spans are code points, end
exclusive; candidates that overlap a base span are never added; without findings of both labels
in what is learnt from and in what is set aside nothing is added; ids play no part; repeated rows are each scanned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.graphs import scratch

from .common import numbered, per_batch, written

# Fixed patterns of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: What a run has if it is no word or path: a digit, or a capital after a small letter.
KEYLIKE = re.compile(r"[0-9]|[a-z][A-Z]")
#: A name and its sign within a run, and a value after a sign.
NAMED = re.compile(r"[A-Za-z_.-]+=(?=[^=]{6})")
VALUE = re.compile(r"""[A-Za-z_]["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""")
KINDS = ("assign", "access", "hex", "model")
MIN_ASSIGN = 6

#: Characters of context before a candidate, of the candidate, and after it, that the network reads.
BEFORE, INSIDE, AFTER = 24, 40, 8
#: Characters that neighbouring windows of a long candidate share.
OVERLAP = 16
WIDTH = BEFORE + INSIDE + AFTER
SYMBOLS, EMBED, FILTERS, KERNEL = 72, 8, 32, 5
EPOCHS, BATCH, RATE = 10, 64, 0.006
RECALL = 0.95
#: Words in templates, those in most of all documents, and templates of either label.
WORDS, TEMPLATES = 4_000, 4_000
#: Windows of one pack of training rows (expected number), and steps of a score that are told apart in calibration.
PACK, STEPS = 30_000, 1_024
#: Names and words before a value in templates of secrets, and of harmless values.
NAMES = ("auth", "credential", "credentials", "access_key", "private_key", "client_secret", "authorization", "key", "signature", "session", "login", "pin_code", "db_pass", "unlock", "cert", "smtp_auth", "Key", "AUTH", "master_key", "otp", "passcode", "access")
HARMLESS = ("note", "said", "name", "title", "see", "version", "ref", "page", "date", "from", "id", "file", "and", "url", "topic", "author", "time", "subject", "Re", "size")
SIGNS = (": ", "=", " = ", ":", ': "', '="', "='")
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
MIXED = LOWER + LOWER.upper() + DIGITS
#: Candidates scored at once.
RUN = 2_048


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Key-like runs, without a name and its sign before them, and other values after a sign, by start."""
    runs = []
    for m in CANDIDATE.finditer(text):
        named = NAMED.match(text, m.start(), m.end())
        start = named.end() if named else m.start()
        if KEYLIKE.search(text, start, m.end()):
            runs.append((start, m.end()))
    held = Spans([(a, 0, b) for a, b in runs])
    values = [m.span(1) for m in VALUE.finditer(text) if not held.overlap(*m.span(1))]
    return sorted(runs + values)


def _symbol_table() -> np.ndarray:
    table = np.full(128, 1, dtype=np.uint8)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-:\"'"):
        table[ord(c)] = min(i + 3, SYMBOLS - 1)
    table[ord(" ")] = table[ord("\n")] = 2
    return table


_SYMBOLS = _symbol_table()
#: Symbols with small letters made capital.
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[3:29] += 26


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The windows that the network sees of a candidate: overlapping ones, the last up to its end."""
    first = [*range(start, end - INSIDE, INSIDE - OVERLAP), max(start, end - INSIDE)]
    return [window(text, a, min(end, a + INSIDE)) for a in dict.fromkeys(first)]


def window(text: str, start: int, end: int) -> bytes:
    """What the network sees of a candidate: 0 is padding, 1 any other character."""
    before, inside, after = text[max(0, start - BEFORE) : start], text[start : min(end, start + INSIDE)], text[end : end + AFTER]
    padded = before.rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + after.ljust(AFTER, "\0")
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where(points < 128, _SYMBOLS[np.minimum(points, 127)], 1).astype(np.uint8)
    out[points == 0] = 0
    return out.tobytes()


class Network:
    """Embedding, one convolution, rectifier, maximum over the window, logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (SYMBOLS, EMBED)).astype(np.float32)
        self.conv = r.normal(0, (2 / (KERNEL * EMBED)) ** 0.5, (KERNEL * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = r.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32)
        self.shift = np.zeros(1, dtype=np.float32)
        self.scale, self.offset, self.threshold = 1.0, 0.0, 2.0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.embed[x]
        view = np.concatenate([e[:, k : WIDTH - KERNEL + 1 + k] for k in range(KERNEL)], axis=2)
        h = view @ self.conv + self.bias
        top = h.argmax(1)
        m = np.maximum(np.take_along_axis(h, top[:, None], 1)[:, 0], 0)
        return m @ self.out + self.shift[0], (view, top, m)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[a : a + RUN])[0] for a in range(0, len(x), RUN)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.offset, -60, 60)))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        z, (view, top, m) = self.forward(x)
        dz = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight / len(y)).astype(np.float32)
        dm = dz[:, None] * self.out * (m > 0)
        picked = np.take_along_axis(view, top[:, :, None], 1)  # rows, filters, kernel * embed
        dconv = np.einsum("nfk,nf->kf", picked, dm)
        dpicked = dm[:, :, None] * self.conv.T[None]
        dembed = np.zeros_like(self.embed)
        places = top[:, :, None] + np.arange(KERNEL)[None, None]
        symbols = np.take_along_axis(x, places.reshape(len(x), -1), 1).ravel()
        np.add.at(dembed, symbols, dpicked.reshape(-1, EMBED))
        return [dembed, dconv, dm.sum(0), m.T @ dz, dz.sum(keepdims=True)]

    def state(self) -> list[np.ndarray]:
        """Weights, and the moments of their gradients (none so far)."""
        weights = [self.embed, self.conv, self.bias, self.out, self.shift]
        return weights + [np.zeros_like(w) for w in weights * 2]

    def loaded(self, state: list[np.ndarray]) -> Network:
        self.embed, self.conv, self.bias, self.out, self.shift = state[:5]
        return self

    def epoch(self, state: list[np.ndarray], step: int, x: np.ndarray, y: np.ndarray, weight: tuple[float, float], r: np.random.Generator) -> int:
        """One pass of Adam over the rows, which changes ``state`` in place; the number of steps so far."""
        weights = state[:5]
        self.loaded(state)
        each = np.where(y == 1, np.float32(weight[1]), np.float32(weight[0]))
        order = r.permutation(len(y))
        for a in range(0, len(y), BATCH):
            at, step = order[a : a + BATCH], step + 1
            for w, g, m, v in zip(weights, self.gradients(x[at], y[at], each[at]), state[5:10], state[10:], strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        return step

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
        r, state, step = np.random.default_rng(seed), self.state(), 0
        for _ in range(EPOCHS):
            step = self.epoch(state, step, x, y, balance(len(y), float(y.sum())), r)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
        return self.place(self.logits(x), y, weight)

    def place(self, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> Network:
        """Platt scaling of outputs that occur ``n`` times; then, of the thresholds with recall ``RECALL``,
        the lowest of the best precision."""
        ones, total = float(n[y == 1].sum()), float(n.sum())
        target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (total - ones + 2))
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
            a -= 0.05 * float((n * (p - target) * z).sum()) / total
            b -= 0.05 * float((n * (p - target)).sum()) / total
        self.scale, self.offset = a, b
        if not ones:
            return self
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        order = np.argsort(p)
        p, y, n = p[order], y[order], n[order]
        below = np.cumsum(n * (y == 1))
        most = max(0.5, float(p[np.searchsorted(below, np.floor((1 - RECALL) * ones), "right")]))
        tries = np.unique(np.clip([0.5, *p[(y == 1) & (p <= most)]], 0.5, most))
        # of each try, the rows at or above it
        first = np.searchsorted(p, tries, "left")
        up, right = (np.append(np.cumsum(k[::-1])[::-1], 0)[first] for k in (n, n * (y == 1)))
        self.threshold = float(tries[int(np.argmax(right / np.maximum(1e-9, up)))])
        return self


def balance(n: int, ones: float) -> tuple[float, float]:
    """Weights of the labels 0 and 1 that give both the same say."""
    return n / (2 * max(1.0, n - ones)), n / (2 * max(1.0, ones))


class Spans:
    """Spans by start, for many questions about overlaps."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts = [x[0] for x in base]
        self.ends = list(accumulate((x[2] for x in base), max))

    def overlap(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def templates(words: list[str], n: int, seed: int = 11) -> tuple[list[bytes], list[int]]:
    """Windows and labels of ``n`` made-up secrets and ``n`` harmless values, within words of the corpus."""
    r = random.Random(seed)
    words = words or ["word"]
    some = lambda k, letters: "".join(r.choice(letters) for _ in range(k))
    said = lambda k: " ".join(r.choice(words) for _ in range(k))

    def secret() -> tuple[str, str]:
        """What stands before the value, and the value."""
        size = r.randrange(8, 44)
        shape = r.randrange(12)
        if shape == 0:
            value = some(size, LOWER)  # after a secret's name only: letters alone say little
        elif shape == 1:
            value = some(size, MIXED + "+/") + "=" * r.randrange(3)
        elif shape == 2:
            value = some(size, LOWER + DIGITS)
        elif shape in (3, 8):
            value = some(size, MIXED[:52])
        elif shape == 4:
            value = some(r.randrange(2, 6), LOWER) + r.choice("_-") + some(r.randrange(16, 40), MIXED)
        elif shape == 5:
            value = some(r.randrange(3, 5), LOWER) + "-" + some(r.randrange(8, 14), DIGITS) + "-" + some(r.randrange(16, 30), MIXED)
        elif shape == 6:
            value = ".".join(some(r.randrange(10, 30), MIXED + "_-") for _ in range(3))
        elif shape == 7:
            value = some(size, LOWER.upper() + DIGITS)
        elif shape in (9, 10):
            value = some(r.randrange(8, 18), MIXED)
        else:
            value = some(size, MIXED)
        if shape and len(value) >= 20 and r.random() < 0.5:
            return r.choice(("", "", "Basic ", "with ", "use ", "Token ")), value
        return r.choice(NAMES) + r.choice(SIGNS), value

    def harmless() -> tuple[str, str]:
        kind = r.randrange(10)
        word = lambda: r.choice(words)
        if kind < 4:
            value = word() if kind < 3 else word() + r.choice("-_./") + word()
        elif kind == 4:
            value = some(r.randrange(6, 20), DIGITS)
        elif kind == 5:
            value = f"20{some(2, DIGITS)}-0{some(1, '123456789')}-{some(2, '12')}T{some(2, '01')}.{some(2, DIGITS)}"
        elif kind == 6:
            value = "/".join(word() for _ in range(r.randrange(2, 6))) + r.choice(("", ".txt", ".html", "/1", "/2024"))
        elif kind == 7:
            value = "".join(word().capitalize() for _ in range(r.randrange(2, 4)))
        elif kind == 8:
            value = r.choice("=-._") * r.randrange(6, 40)
        else:
            value = word() + some(r.randrange(1, 5), DIGITS)
        before = r.choice(HARMLESS) + r.choice(SIGNS) if r.random() < 0.7 else r.choice((word() + ": ", "", "www.", "to "))
        return before, value

    seen, labels = [], []
    for label, make in ((1, secret), (0, harmless)):
        for _ in range(n):
            before, value = make()
            text = f"{said(r.randrange(6))} {before}".lstrip()
            # windows of a long value that lie behind its first are as good
            for x in windows(text + value + r.choice((" ", '"', "\n", ". ", "", ",")) + said(2), len(text), len(text) + len(value))[:2]:
                seen.append(x)
                labels.append(label)
    return seen, labels


def learn(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Network | None:
    """A network from the findings of all documents; None without findings of both labels."""
    with scratch(documents.sparkSession):
        return _learn(documents.select(F.col(text).alias("text")))


def _learn(documents: DataFrame) -> Network | None:
    def rows(texts: list) -> dict:
        out = {"window": [], "label": []}
        for t in texts:
            if t:
                base = Spans(base_spans(t))
                for s, e in candidates(t):
                    own = windows(t, s, e)
                    out["window"] += own
                    out["label"] += [int(base.overlap(s, e))] * len(own)
        return out

    findings = per_batch(documents, "window binary, label int", rows, "text")
    # repeated windows (copies of a document) say nothing new, and must not reach both parts
    apart = written(findings.distinct().withColumn("h", F.pmod(F.xxhash64("window", "label"), F.lit(1 << 30))))
    each = numbered(apart, [], F.shiftright("h", 18), ["h", "window", "label"], "i")
    single = written(each.select("i", "window", "label", (F.col("i") % 4 == 0).alias("aside"), (F.col("i") % 2).cast("int").alias("half"), F.lit(False).alias("made")))
    labels = lambda where: {r.label for r in single.where(where).select("label").distinct().collect()}
    if labels("aside") != {0, 1} or labels("not aside") != {0, 1}:
        return None
    made = written(_made(documents))
    single = _doubtful(single, made.where("not spare").select("i", "window", "label", "made"))
    if labels("not aside and not doubtful") != {0, 1}:
        return None
    columns = [F.lit(0).alias("net"), "i", "window", "label", "made"]
    model = _train(single.where("not aside and not doubtful").select(*columns).unionByName(made.where("not spare").select(*columns)))[0]
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scores(seen: list, truth: list, template: list) -> dict:
        x, y = _expanded(seen, truth, template)
        return {"z": np.floor(held.value.logits(x).astype(np.float64) * STEPS).astype(np.int64), "label": y.astype(np.int32)}

    part = single.where("aside").select("window", "label", "made").unionByName(made.where("spare").select("window", "label", "made"))
    counts = per_batch(part, "z long, label int", scores, "window", "label", "made").groupBy("z", "label").count().orderBy("z", "label").toPandas()
    return model.place(counts.z.to_numpy() / STEPS, counts.label.to_numpy(), counts["count"].to_numpy(dtype=np.float64))


def _made(documents: DataFrame) -> DataFrame:
    """``i, window, label, spare, made``: templates within the ``WORDS`` words that stand in most of all documents."""
    words = documents.select(F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("w")).where(F.length("w").between(2, 24))
    often = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(WORDS).orderBy(F.xxhash64("w"), "w").collect()
    seen, labels = templates([r.w for r in often], TEMPLATES)
    rows = [(i, bytearray(x), y, i % 4 == 0, True) for i, (x, y) in enumerate(zip(seen, labels, strict=True))]
    return documents.sparkSession.createDataFrame(rows, "i long, window binary, label int, spare boolean, made boolean")


def _train(rows: DataFrame) -> dict[int, Network]:
    """A network for each ``net`` of the rows (net, i, window, label, made), averaged over packs after each epoch."""
    shown = F.when(F.col("made"), 1).otherwise(3)
    sizes = {r.net: (r.n, r.ones) for r in rows.groupBy("net").agg(F.sum(shown).alias("n"), F.sum(shown * F.col("label")).alias("ones")).collect()}
    packs, several = {net: -(-n // PACK) for net, (n, _) in sizes.items()}, F.lit(1)
    for net, n in packs.items():
        several = F.when(F.col("net") == net, n).otherwise(several)
    h = F.xxhash64("window", "label", "made")
    grouped = rows.select("net", F.pmod(h, several).alias("pack"), F.struct("made", "i", "window", "label").alias("row")).groupBy("net", "pack").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def bytes_of(nets: list, numbers: list, packed: list) -> dict:
        own = [_expanded(*([x[c] for x in rows] for c in ("window", "label", "made"))) for rows in packed]
        return {"net": nets, "pack": numbers, "x": [x.tobytes() for x, _ in own], "y": [y.astype(np.uint8).tobytes() for _, y in own]}

    # more partitions than packs, so that few packs share one
    ready = written(per_batch(grouped, "net int, pack long, x binary, y binary", bytes_of, "net", "pack", "rows").repartition(4 * sum(packs.values()), "net", "pack"))
    shapes = [w.shape for w in Network().state()]
    states, steps = {net: Network().state() for net in sizes}, dict.fromkeys(sizes, 0)
    for epoch in range(EPOCHS):
        held = rows.sparkSession.sparkContext.broadcast((states, steps))

        def one(nets: list, numbers: list, xs: list, ys: list, held=held, epoch=epoch) -> dict:
            out, (before, done) = [], held.value
            for net, pack, x, y in zip(nets, numbers, xs, ys, strict=True):
                state = [w.copy() for w in before[net]]
                Network().epoch(state, done[net], np.frombuffer(x, dtype=np.uint8).reshape(-1, WIDTH), np.frombuffer(y, dtype=np.uint8).astype(np.float32), balance(*sizes[net]), _order(pack, epoch, len(y)))
                out.append(np.concatenate([w.ravel() for w in state]).astype(np.float64))
            return {"net": nets, "pack": numbers, "state": out}

        ended = per_batch(ready, "net int, pack long, state array<double>", one, "net", "pack", "x", "y")
        # summed in the order of the packs, so that the result is the same each time
        total = F.aggregate(F.sort_array(F.collect_list(F.struct("pack", "v")))["v"], F.lit(0.0), lambda x, v: x + v)
        mean = ended.select("net", "pack", F.posexplode("state").alias("i", "v")).groupBy("net", "i").agg((total / F.count("*")).alias("v")).toPandas()
        for net, v in mean.sort_values(["net", "i"]).groupby("net")["v"]:
            flat, cuts = v.to_numpy(dtype=np.float32), np.cumsum([np.prod(s, dtype=int) for s in shapes])[:-1]
            states[net] = [w.reshape(s).copy() for w, s in zip(np.split(flat, cuts), shapes, strict=True)]
        steps = {net: steps[net] + -(-n // (packs[net] * BATCH)) for net, (n, _) in sizes.items()}
        held.unpersist()
    return {net: Network().loaded(state) for net, state in states.items()}


def _order(pack: int, epoch: int, n: int) -> np.random.Generator:
    """A pack's source of orders, as it is after those of earlier epochs."""
    r = np.random.default_rng((7, pack) if pack else 7)
    for _ in range(epoch):
        r.permutation(n)
    return r


def _doubtful(single: DataFrame, made: DataFrame) -> DataFrame:
    """With ``doubtful``: candidates no pattern found that a network trained on the other half takes for
    secrets: they may be what the patterns miss, so they are not learnt as harmless."""
    both = {h for h in (0, 1) if {r.label for r in single.where(F.col("half") != h).select("label").distinct().collect()} == {0, 1}}
    if not both:
        return single.withColumn("doubtful", F.lit(False))
    others = single.select((1 - F.col("half")).alias("net"), "i", "window", "label", "made").where(F.col("net").isin(*both))
    nets = F.explode(F.array(*(F.lit(h) for h in sorted(both)))).alias("net")
    held = single.sparkSession.sparkContext.broadcast(_train(others.unionByName(made.select(nets, "i", "window", "label", "made"))))

    def judge(numbers: list, seen: list, truth: list, asides: list, halves: list, mades: list) -> dict:
        x, half, label = np.frombuffer(b"".join(seen), dtype=np.uint8).reshape(-1, WIDTH), np.array(halves), np.array(truth)
        out = np.zeros(len(seen), dtype=bool)
        for h, net in held.value.items():
            out[half == h] = net.probability(x[half == h]) >= 0.5
        return {"i": numbers, "window": seen, "label": truth, "aside": asides, "half": halves, "made": mades, "doubtful": out & (label == 0)}

    judged = written(per_batch(single, "i long, window binary, label int, aside boolean, half int, made boolean, doubtful boolean", judge, "i", "window", "label", "aside", "half", "made"))
    kept = {r.label for r in judged.where("not doubtful").select("label").distinct().collect()}
    return judged if kept == {0, 1} else judged.withColumn("doubtful", F.lit(False))


def _expanded(seen: list, truth: list, made: list) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels: findings as they are shown, templates as they are."""
    x, y, m = np.frombuffer(b"".join(seen), dtype=np.uint8).reshape(-1, WIDTH), np.array(truth, dtype=np.float32), np.array(made, dtype=bool)
    shown, labels = _shown(x[~m], y[~m])
    return np.concatenate([shown, x[m]]), np.concatenate([labels, y[m]])


def _shown(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Findings as they are, without context, and so in capitals: what patterns miss may look like any."""
    bare = x.copy()
    bare[:, :BEFORE] = bare[:, BEFORE + INSIDE :] = 0
    return np.concatenate([x, bare, _UPPER[bare]]), np.concatenate([y] * 3)


def scan(documents: DataFrame, model: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind,start,end>>`` of every document, base and added."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def rows(ids: list, texts: list) -> dict:
        found = [base_spans(t) if t else [] for t in texts]
        where, seen = [], []
        for i, t in enumerate(texts):
            if t and held.value is not None:
                base = Spans(found[i])
                for s, e in candidates(t):
                    if not base.overlap(s, e):
                        own = windows(t, s, e)
                        where += [(i, s, e)] * len(own)
                        seen += own
        if seen:
            p = held.value.probability(np.frombuffer(b"".join(seen), dtype=np.uint8).reshape(-1, WIDTH))
            for i, s, e in sorted({x for x, score in zip(where, p, strict=True) if score >= held.value.threshold}):
                found[i].append((s, 3, e))
        return {"doc_id": ids, "spans": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(x)] for x in found]}

    plain = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return per_batch(plain, "doc_id long, spans array<struct<kind:string,start:long,end:long>>", rows, "doc_id", "text")


def report(documents: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    found = scan(documents, learn(documents))

    def line(x):
        return F.concat_ws(":", x["kind"], x["start"], x["end"])

    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "model")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
