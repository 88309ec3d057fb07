"""Labels of what happens within a horizon after each sample point of a conversation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import BACKCHANNEL_WORDS, is_backchannel_token, sample_key

from .dyads import perspectives
from .intervals import overlapping, voiced_at, words_in_utterance
from .timeindex import at_points, holds, stored, time_index, touching, turn_end

TAUS = (100, 200, 400, 500, 800, 1600)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), use), 0)


@dataclass(frozen=True)
class Thresholds:
    """What makes a listener utterance substantive or a backchannel."""

    substantive_ms: float = 700.0
    substantive_words: int = 3
    backchannel_ms: float = 500.0
    backchannel_words: int = 2
    yield_tolerance_s: float = 0.3
    lexicon: tuple[str, ...] = BACKCHANNEL_WORDS


def grid_points(manifest: DataFrame, stride_ms: int = 500, window_s: float = 2.0, max_tau_ms: int = 1600) -> DataFrame:
    """Sample points of both perspectives of each dyad, voiced or not.

    ``manifest`` holds ``interaction_id, file_id_a, file_id_b, split, duration_s``.
    """
    p = perspectives(manifest, ["interaction_id", "split", "duration_s"])
    last = F.col("duration_s") - max_tau_ms / 1000.0
    n = F.floor((last - window_s) / (stride_ms / 1000.0)).cast("int")
    grid = p.where(last > window_s).withColumn("i", F.explode(F.sequence(F.lit(0), n))).withColumn("t", F.lit(window_s) + F.col("i") * (stride_ms / 1000.0)).where(F.col("t") <= last)
    return grid.drop("duration_s")


def sample_grid(manifest: DataFrame, intervals: DataFrame, stride_ms: int = 500, window_s: float = 2.0, max_tau_ms: int = 1600) -> DataFrame:
    """Sample points of both perspectives of each dyad where the speaker is voiced."""
    return voiced_at(grid_points(manifest, stride_ms, window_s, max_tau_ms), intervals, "file_id", "t")


def is_substantive(duration_ms: Column, n_words: Column, n_other: Column, th: Thresholds) -> Column:
    return (duration_ms >= th.substantive_ms) | (n_words >= th.substantive_words) | (n_other > 0)


def is_backchannel(duration_ms: Column, n_words: Column, n_other: Column, th: Thresholds) -> Column:
    return (duration_ms <= th.backchannel_ms) & ((n_words <= th.backchannel_words) | (n_other == 0))


def classify(a_turn_end: Column, first_start: Column, a_voiced: Column, b_voiced: Column, any_backchannel: Column, th: Thresholds) -> Column:
    """The precedence tree; ``first_start`` is null without a substantive utterance."""
    return (
        F.when(first_start.isNotNull() & (a_turn_end <= first_start + th.yield_tolerance_s), 1)
        .when(first_start.isNotNull() & ~b_voiced & a_voiced, 4)
        .when(first_start.isNotNull(), 3)
        .when(a_voiced & any_backchannel, 2)
        .when(a_voiced, 0)
        .otherwise(5)
    )


def utterance_stats(samples: DataFrame, intervals: DataFrame, words: DataFrame, taus: tuple[int, ...] = TAUS, th: Thresholds = Thresholds()) -> DataFrame:
    """Per sample, listener segment and tau: clipped start, duration, words, words off the lexicon,
    and whether the segment is voiced at the horizon's end.

    One join with the longest horizon serves all taus: a clipped start does not depend on tau, and
    the words of a shorter horizon are counted by condition.
    """
    longest = max(taus) / 1000.0
    horizon = samples.select("file_id", "i", "t", "other_file_id").withColumn("h", F.col("t") + longest)
    seg = overlapping(horizon, intervals, "other_file_id", "t", "h").withColumn("c_start", F.greatest("iv_start_s", "t")).withColumn("c_end", F.least("iv_end_s", "h"))
    flagged = words.select("file_id", "start_s", (~is_backchannel_token("word", th.lexicon)).cast("int").alias("other"))
    # words starting at c_start count even where the clipped part is a point, so bound by c_end >= c_start
    with_words = words_in_utterance(seg.select("file_id", "i", "other_file_id", "iv_seg_idx", "c_start", F.greatest("c_end", "c_start").alias("c_end")), flagged, "other_file_id", how="inner")

    def inside(tau: int) -> Column:
        return F.col("w_start_s") <= F.least(F.col("iv_end_s"), F.col("t") + tau / 1000.0)

    keyed = with_words.select("file_id", "i", "iv_seg_idx", "w_start_s", "w_other")
    joined = seg.select("file_id", "i", "t", "iv_seg_idx", "iv_start_s", "iv_end_s", "c_start").join(keyed, ["file_id", "i", "iv_seg_idx"], "left")
    counts = [x for tau in taus for x in (F.count(F.when(inside(tau), 1)).alias(f"n{tau}"), F.sum(F.when(inside(tau), F.col("w_other")).otherwise(0)).alias(f"o{tau}"))]
    per_seg = joined.groupBy("file_id", "i", "t", "iv_seg_idx", "iv_start_s", "iv_end_s", "c_start").agg(*counts)
    cells = F.array(*[F.struct(F.lit(tau).alias("tau_ms"), (F.col("t") + tau / 1000.0).alias("h"), F.col(f"n{tau}").alias("n_words"), F.col(f"o{tau}").alias("n_other")) for tau in taus])
    long = per_seg.select("file_id", "i", "iv_seg_idx", "iv_start_s", "iv_end_s", "c_start", F.explode(cells).alias("x")).select("*", "x.*").drop("x")
    c_end = F.least("iv_end_s", "h")
    return long.select("file_id", "i", "tau_ms", "iv_seg_idx", "iv_start_s", "c_start", c_end.alias("c_end"), (F.col("c_start") < c_end).alias("is_part"), ((c_end - F.col("c_start")) * 1000.0).alias("duration_ms"), "n_words", "n_other", F.col("h").between(F.col("iv_start_s"), F.col("iv_end_s")).alias("voiced_h"))


def _label_at(t: Column, tau_s: Column, own: Column, utterances: Column, th: Thresholds) -> Column:
    """The label at one horizon. ``own``: intervals of the speaker around ``t``; ``utterances``: the
    listener's intervals that start or go on after ``t``, with clipped start and words."""
    h = t + tau_s

    def measured(u: Column) -> Column:
        end = F.least(u["end_s"], h)
        heard = F.filter(u["words"], lambda w: w["start_s"] <= end)
        total = lambda f: F.aggregate(heard, F.lit(0).cast("long"), lambda a, w: a + f(w))
        args = ((end - u["c_start"]) * 1000.0, total(lambda w: w["n"]), total(lambda w: w["n"] * w["other"]), th)
        part = u["c_start"] < end
        return F.struct(u["c_start"].alias("c_start"), (part & is_substantive(*args)).alias("substantive"), (part & is_backchannel(*args)).alias("backchannel"), h.between(u["start_s"], u["end_s"]).alias("voiced"))

    def tree(m: Column) -> Column:
        first = F.array_min(F.transform(F.filter(m, lambda u: u["substantive"]), lambda u: u["c_start"]))
        return classify(turn_end(own, t), first, holds(own, h), F.exists(m, lambda u: u["voiced"]), F.exists(m, lambda u: u["backchannel"]), th)

    return let(F.transform(utterances, measured), tree)


def _labelled(joined: DataFrame, taus: tuple[int, ...], th: Thresholds) -> DataFrame:
    """Rows with ``t``, ``_own``, ``_other`` and ``_words`` to a row for each tau, with ``label``."""
    t, last = F.col("t"), F.col("t") + max(taus) / 1000.0
    none = F.expr("cast(array() as array<struct<start_s: double, seg_idx: bigint, end_s: double>>)")
    words = F.coalesce("_words", F.expr("cast(array() as array<struct<start_s: double, other: int, n: bigint>>)"))

    def clipped(v: Column) -> Column:
        start = F.greatest(v["start_s"], t)
        return F.struct(start.alias("c_start"), v["start_s"], v["end_s"], F.filter(words, lambda w: (w["start_s"] >= start) & (w["start_s"] <= v["end_s"])).alias("words"))

    heard = F.transform(F.coalesce(touching(F.col("_other"), t, last), none.cast(joined.schema["_other"].dataType)), clipped)
    ready = joined.withColumn("_u", heard).drop("_other", "_words")
    horizons = F.array(*[F.struct(F.lit(tau).alias("tau_ms"), F.lit(tau / 1000.0).alias("s")) for tau in taus])
    cells = F.transform(horizons, lambda x: F.struct(x["tau_ms"].alias("tau_ms"), _label_at(t, x["s"], F.col("_own"), F.col("_u"), th).alias("label")))
    return ready.withColumn("_x", F.explode(cells)).withColumns({"tau_ms": F.col("_x.tau_ms"), "label": F.col("_x.label")}).drop("_own", "_u", "_x")


def label_samples(samples: DataFrame, intervals: DataFrame, words: DataFrame, taus: tuple[int, ...] = TAUS, th: Thresholds = Thresholds(), index: DataFrame | None = None) -> DataFrame:
    """``samples`` (columns ``file_id, other_file_id, i, t`` and more) times taus, with ``label``.

    ``index``: a stored time index that reaches the longest tau at least, made from ``intervals``
    and ``words`` if there is none. The samples are dealt twice, by either side's recording and time
    bucket; intervals and words aren't moved, and nothing is grouped. Samples whose speaker has
    no interval from the point to the longest horizon are left out.
    """
    index = stored(time_index(intervals, words, max(taus) / 1000.0, th.lexicon)) if index is None else index
    t, last = F.col("t"), F.col("t") + max(taus) / 1000.0
    own = at_points(samples, index, "file_id", "t", {"intervals": "_own"}).where(F.size(touching(F.col("_own"), t, last)) > 0)
    both = at_points(own, index, "other_file_id", "t", {"intervals": "_other", "words": "_words"}, "left")
    return _labelled(both, taus, th)


def label_windows(manifest: DataFrame, intervals: DataFrame, words: DataFrame, taus: tuple[int, ...] = TAUS, th: Thresholds = Thresholds(), stride_ms: int = 500, window_s: float = 2.0, skip_empty: bool = False, max_tau_ms: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """``sample_key, interaction_id, file_id, split, t_ms, tau_ms, label`` for every sample and tau.

    With ``skip_empty`` dyads of which a side has no interval at all are left out. ``max_tau_ms``
    (the longest tau if not given) ends the sample points. A stored ``index`` can serve many calls;
    filters on splits, dyads and taus of the result reach the manifest and the taus.
    """
    ok = manifest
    if skip_empty:
        for side in ("file_id_a", "file_id_b"):
            ok = ok.join(intervals.select(F.col("file_id").alias(side)).distinct(), side, "left_semi")
    index = stored(time_index(intervals, words, max(taus) / 1000.0, th.lexicon)) if index is None else index
    grid = grid_points(ok, stride_ms, window_s, max_tau_ms or max(taus))
    spoken = at_points(grid, index, "file_id", "t", {"intervals": "_own"}).where(holds(F.col("_own"), F.col("t")))
    both = at_points(spoken, index, "other_file_id", "t", {"intervals": "_other", "words": "_words"}, "left")
    out = _labelled(both, taus, th)
    return out.select(sample_key("file_id", "t").alias("sample_key"), "interaction_id", "file_id", "split", F.rint(F.col("t") * 1000.0).cast("long").alias("t_ms"), "tau_ms", "label")


def label_counts(labels: DataFrame) -> DataFrame:
    """``tau_ms, split, n_samples`` and a count per class."""
    n = [F.count(F.when(F.col("label") == c, 1)).alias(f"n_{c}") for c in range(6)]
    return labels.groupBy("tau_ms", "split").agg(F.count("*").alias("n_samples"), *n)


def dyad_summary(manifest: DataFrame, labels: DataFrame, words: DataFrame) -> DataFrame:
    """Per dyad: samples, whether each side has a transcript, duration; dyads without samples stay."""
    n = labels.groupBy("interaction_id").agg(F.countDistinct("sample_key").alias("n"))
    has = words.select("file_id").distinct()
    a = has.select(F.col("file_id").alias("file_id_a"), F.lit(True).alias("a"))
    b = has.select(F.col("file_id").alias("file_id_b"), F.lit(True).alias("b"))
    joined = manifest.join(n, "interaction_id", "left").join(a, "file_id_a", "left").join(b, "file_id_b", "left")
    return joined.select("interaction_id", F.coalesce("n", F.lit(0)).alias("n_samples"), F.coalesce("a", F.lit(False)).alias("transcript_a"), F.coalesce("b", F.lit(False)).alias("transcript_b"), "duration_s")
