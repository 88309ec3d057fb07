"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Each rule is a ratio that is high in bad documents. Labelled documents of a stratum (a
language) are its holdout: for each cutoff of a fixed grid, the documents labelled good that the
cutoff would reject are counted, and the exact binomial tail P(Bin(n, ALPHA) <= rejected) tests
whether the false-rejection rate is under ``ALPHA``. Strata and rules share ``DELTA`` by
Bonferroni; within a rule cutoffs are tested from the loosest on and testing stops at the first
failure (a fixed sequence, which needs no further correction). So with probability 1 - DELTA no
rule wrongly rejects more than ALPHA of the good documents of any stratum. A rule without a
proven cutoff rejects nothing.

Defined cases: a null or empty text has no words and fails the base rule; every language is a
stratum, and so are the documents without one; without labels only the base
rules hold; repeated labels of an id count once (the lowest); repeated documents count each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\x20\x09-\x0D]+"
#: Limit on the false-rejection rate of one rule in one stratum, and the chance that any limit is broken.
ALPHA, DELTA = 0.02, 0.05
REPEAT_WINDOW = 8
#: Grids of cutoffs per rule, loosest first; fixed before any label is seen.
GRIDS = {
    "symbols_per_word": [5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.2, 0.15, 0.1, 0.05],
    "dup_line_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_share": [0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
}
#: Terms of a tail that are summed, in standard deviations; those beyond are under 1e-400 of it.
TERMS = 45


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), use), 0)


def _words_repeated(words: Column) -> Column:
    """Words in windows of eight that occur twice or more in the text."""

    def joined(h: Column, by: int) -> Column:
        return F.zip_with(h, F.slice(h, by + 1, F.greatest(F.size(h) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def spans(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        return let(
            same,
            lambda nx: F.sort_array(
                F.filter(
                    F.zip_with(s, F.zip_with(nx, F.concat(F.array(F.lit(False)), nx), lambda x, y: F.coalesce(x, F.lit(False)) | y), lambda e, f: F.when(f, e["p"])),
                    lambda p: p.isNotNull(),
                )
            ),
        )

    def covered(p: Column) -> Column:
        step = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(REPEAT_WINDOW), F.coalesce(b - a, F.lit(REPEAT_WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda t, x: t + x)

    def of(windows: Column) -> Column:
        numbered = F.zip_with(windows, F.sequence(F.lit(1), F.size(windows)), lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(F.sort_array(numbered), lambda s: let(spans(s), covered)))

    h1 = F.transform(words, lambda w: F.xxhash64(w))
    eight = let(h1, lambda a: let(joined(a, 1), lambda b: let(joined(b, 2), lambda c: joined(c, 4))))
    return F.when(F.size(words) <= REPEAT_WINDOW, F.lit(0).cast("long")).otherwise(let(F.slice(eight, 1, F.greatest(F.size(words) - REPEAT_WINDOW + 1, F.lit(1))), of))


def features(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The counts and ratios of every document; one pass over the text, nothing shuffled."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(F.col(stratum).isNull(), "").otherwise(F.concat(F.lit("="), F.col(stratum).cast("string"))).alias("stratum"), body.alias("t"))
    split = base.withColumn("words", F.array_remove(F.split("t", SPACE), "")).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    letters = F.octet_length(F.regexp_replace("t", "[^A-Za-z]+", ""))
    upper = F.octet_length(F.regexp_replace("t", "[^A-Z]+", ""))
    counted = split.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.octet_length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _words_repeated(F.col("words")).alias("n_repeat_words"),
        (upper / F.greatest(letters, F.lit(1))).alias("upper_share"),
    )
    return counted.select(
        "*",
        (F.col("n_symbols") / F.greatest("n_words", F.lit(1))).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))).alias("repeat_share"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )


def log_factorial(n: Column) -> Column:
    """ln n! by the Stirling series at n + 9, which gives all digits of a double."""
    x = n + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    for i in range(1, 9):
        series = series - F.log(n + float(i))
    return series


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) where k < n*p; 1 elsewhere (there it is about a half or more).

    The terms from k down, each from the one before; their number grows with the standard deviation.
    """
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    last = F.least(k, F.ceil(TERMS * F.sqrt(n * (p * (1 - p)))) + 100)

    def step(state: Column, j: Column) -> Column:
        term = state["term"] * ((k - j + 1) / (n - k + j)) * odds
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.when(k == 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1).cast("long"))), start, step)["sum"])
    return F.when((n == 0) | (k >= n * F.lit(p)), F.lit(1.0)).otherwise(F.exp(first) * total)


def cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum, rule, cutoff``: the tightest proven cutoff of each rule, where there is one.

    ``good``: the feature rows of documents labelled good, with their final strata. Sums are
    taken before the shuffle; what follows is one row per stratum, rule and cutoff.
    """
    sums = [F.sum((F.col(rule) > c).cast("long")).alias(f"{rule}:{i}") for rule, grid in GRIDS.items() for i, c in enumerate(grid)]
    wide = written(good.groupBy("stratum").agg(F.count("*").alias("n"), *sums))
    cells = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"`{rule}:{i}`").alias("k")) for rule, grid in GRIDS.items() for i, c in enumerate(grid)])
    long = wide.select("stratum", "n", F.explode(cells).alias("c")).select("stratum", "n", "c.*")
    tested = long.withColumn("passed", binomial_tail(F.col("n"), F.col("k"), alpha) <= F.lit(delta / (max(1, wide.count()) * len(GRIDS))))
    looser = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    proven = tested.withColumn("so_far", F.min(F.col("passed").cast("int")).over(looser)).where("so_far = 1")
    return proven.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(documents: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Feature rows with ``kept``: false where a base rule or a proven cutoff rejects."""
    rows = written(features(documents))
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    good = rows.join(marks.where("quality = 1"), F.col("doc_id") == F.col("label_id"))
    cut = cutoffs(good, alpha, delta).groupBy("stratum").pivot("rule", list(GRIDS)).agg(F.min("cutoff"))
    cut = cut.select(F.col("stratum").alias("own"), *[F.col(r).alias(f"cut_{r}") for r in GRIDS])
    over = F.lit(False)
    for r in GRIDS:
        over = over | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    joined = rows.join(cut, F.col("stratum") == F.col("own"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~over)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return judge(documents, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
