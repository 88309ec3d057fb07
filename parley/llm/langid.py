"""Language identification with bit-sliced Bloom filters of character n-grams.

Learning: character n-grams (2 to 4 code points, lower-cased, letters with a blank at word
edges) of a bounded sample of labelled documents per language; each language keeps its most
frequent ones. They go into one table whose slot is a bitmask with one bit per language (of as many words as they need), so a
single look-up (the AND of the slots that the hash functions name) returns every language that
contains an n-gram.

Predicting: popcounts per language over all n-grams of the whole text, corrected for the false
positives that the fill of the language's slice predicts; the largest count wins.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the
alphabetically first language; with nothing to learn from every text is ``und``; texts whose
n-grams no language holds get the first language with score 0. Lang, source and id are never
looked at when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, letter_table, per_batch, remainder, slices

SIZES = (2, 3, 4)
#: Most labelled documents per language that n-grams are counted over (expected number; a hash of the id decides).
SAMPLE_DOCS = 2_000
#: n-grams that each language keeps.
KEEP = 10_000
#: Slots of the filter (a power of two) and hash functions.
SLOTS_LOG2, HASHES = 18, 2
#: A document whose best language holds fewer of its n-grams than this has no known language.
LEAST_SHARE = 0.5
UNKNOWN = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Code points handled at once.
RUN = 1_000_000


def gram_codes(text: str) -> np.ndarray:
    """All n-grams of a text as 64-bit codes (21 bits a code point at most, mixed beyond three)."""
    points = code_points(text.lower())
    letter = letter_table()[points]
    # one blank for each run of other characters, and one at both ends
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64)
    x = np.concatenate([[np.uint64(32)], x, [np.uint64(32)]]) if len(x) else np.zeros(0, dtype=np.uint64)
    out = []
    for n in SIZES:
        if len(x) >= n:
            code = np.full(len(x) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                code *= np.uint64(0x100000001B3)
                code ^= x[k : len(x) - n + 1 + k]
            out.append(code)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def slots_of(codes: np.ndarray) -> Iterator[np.ndarray]:
    for m in _MIX[:HASHES]:
        yield ((codes ^ (codes >> np.uint64(29))) * m) >> np.uint64(64 - SLOTS_LOG2)


class Filter:
    """``table[slot]`` is the bitmask of languages, a word for each 64 of them; ``fill`` the share of set
    slots per language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        self.fill = np.array([float(((table[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean()) for i in range(len(languages))])

    def masks(self, codes: np.ndarray) -> np.ndarray:
        mask = None
        for s in slots_of(codes):
            found = self.table[s]
            mask = found if mask is None else mask & found
        return mask

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Per language, the n-grams of the text it contains; and the number of n-grams."""
        total, n = np.zeros(len(self.languages)), 0
        codes = gram_codes(text)
        for a in range(0, len(codes), RUN):
            mask = self.masks(codes[a : a + RUN])
            n += len(mask)
            if len(self.languages) <= 8:
                total += self._by_value(mask)
            else:
                total += [float(np.count_nonzero(mask[:, i >> 6] & np.uint64(1 << (i & 63)))) for i in range(len(self.languages))]
        return total, n

    def _by_value(self, mask: np.ndarray) -> np.ndarray:
        seen = np.bincount(mask[:, 0].astype(np.int64), minlength=1 << len(self.languages))
        values = np.arange(len(seen))
        return np.array([float(seen[(values >> i) & 1 == 1].sum()) for i in range(len(self.languages))])

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the (corrected) share of the text's n-grams that the language holds."""
        if not text or not self.languages or not letter_table()[code_points(text)].any():
            return UNKNOWN, 0.0, 0.0
        got, n = self.counts(text)
        false = self.fill**HASHES
        share = np.clip((got / max(1, n) - false) / np.maximum(1e-9, 1 - false), 0.0, 1.0)
        best = int(np.argmax(share))
        total = float(share.sum())
        return self.languages[best], float(share[best] / total) if total > 0 else 0.0, float(share[best])


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filter:
    """Count n-grams of a bounded, hash-chosen sample per language, and fill the filter.

    What reaches the driver is ``KEEP`` n-grams a language.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.where(F.col(lang).isNotNull()).groupBy(lang).count().collect()
    languages = sorted(r[lang] for r in sizes)
    if not languages:
        return Filter([], np.zeros((1 << SLOTS_LOG2, 1), dtype=np.uint64))
    number = {x: i for i, x in enumerate(languages)}
    cut = {r[lang]: min(1.0, SAMPLE_DOCS / r["count"]) for r in sizes}
    chance = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[v for k, c in cut.items() for v in (F.lit(k), F.lit(c))]), F.col(lang))
    sample = known.where(chance < share)

    def count(langs: list, texts: list) -> dict:
        out = {"lang": [], "code": [], "n": []}
        for x in sorted(set(langs)):
            for a, b in slices(own := [t for k, t in zip(langs, texts, strict=True) if k == x], RUN):
                codes, n = np.unique(np.concatenate([gram_codes(t) for t in own[a:b]]), return_counts=True)
                out["lang"] += [number[x]] * len(codes)
                out["code"] += codes.view(np.int64).tolist()
                out["n"] += n.tolist()
        return out

    from pyspark.sql import Window

    plain = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = per_batch(plain, "lang int, code long, n long", count, "lang", "text").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the best of each 32nd of the codes first, so that no window holds all n-grams of a language
    part = F.pmod(F.xxhash64("code"), F.lit(32))
    first = counted.withColumn("p", part).withColumn("r", F.row_number().over(Window.partitionBy("lang", "p").orderBy(F.desc("n"), "code"))).where(F.col("r") <= KEEP // 8)
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= KEEP)
    table = np.zeros((1 << SLOTS_LOG2, -(-len(languages) // 64)), dtype=np.uint64)
    rows = top.select("lang", "code").toPandas()
    for i in range(len(languages)):
        for s in slots_of(rows.code[rows.lang == i].to_numpy(dtype=np.int64).view(np.uint64)):
            table[s, i >> 6] |= np.uint64(1 << (i & 63))
    return Filter(languages, table)


def predict(documents: DataFrame, model: Filter, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, whatever its other columns are called."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def rows(ids: list, texts: list) -> dict:
        decided = [held.value.decide(t) for t in texts]
        return {"doc_id": ids, "lang_pred": [x[0] for x in decided], "score": [x[1] for x in decided]}

    plain = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return per_batch(plain, "doc_id long, lang_pred string, score double", rows, "doc_id", "text")


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.where(remainder("doc_id", 4) != 2)


def report(documents: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    model = learn(training_rows(documents))
    return predict(documents, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def with_language(documents: DataFrame) -> DataFrame:
    """The rows whose language is known, with all their columns.

    ``und`` rows go, and those of which no language holds ``LEAST_SHARE`` of the n-grams; with nothing to
    learn from, no language is known.
    """
    import pyarrow as pa

    held = documents.sparkSession.sparkContext.broadcast(learn(training_rows(documents)))
    where = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [held.value.decide(t)[2] >= LEAST_SHARE for t in batch.column(where).to_pylist()]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
