"""Windowed signals: z-scores, lagged correlation, its summaries, pooling and stream assembly.

Frames come in long form (``window_id, frame, feature, x, y``: speaker and listener). Lagged
correlation packs the frames of a window and feature into two short arrays once, and each lag
works on slices of them; frames are never joined with themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import written
from .medians import with_medians
from .small import few

MAX_LAG = 10
FPS = 30.0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), use), 0)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def sliding_windows(signals: DataFrame, length_s: float, stride_s: float) -> DataFrame:
    """``file_id, rate, samples`` to windows of ``length_s`` each ``stride_s`` that fit."""
    n, rate = F.size("samples"), F.col("rate")
    most = F.floor((n / rate + 1e-9 - length_s) / stride_s).cast("int")
    i = signals.where(most >= 0).withColumn("i", F.explode(F.sequence(F.lit(0), most)))
    begin = F.rint(F.col("i") * stride_s * rate).cast("int")
    size = F.rint(F.lit(length_s) * rate).cast("int")
    cut = i.withColumn("first", begin).withColumn("size", size).where(F.col("first") + F.col("size") <= n)
    return cut.select("file_id", "i", (F.col("i") * stride_s).alias("start_s"), (F.col("i") * stride_s + length_s).alias("end_s"), F.slice("samples", F.col("first") + 1, F.col("size")).alias("samples"))


def zscore_series(frames: DataFrame, by: list[str], columns: tuple[str, ...] = ("x", "y"), eps: float = 1e-8) -> DataFrame:
    """(v - mean) / (population deviation + eps) within each group, as ``z_<column>``."""
    stats = frames.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    joined = frames.join(stats, by)
    return joined.select(*frames.columns, *[((F.col(c) - F.col(f"mean_{c}")) / (F.col(f"std_{c}") + eps)).alias(f"z_{c}") for c in columns])


def series(frames: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """``keys, xs, ys``: the values of each series by frame. A series is as long as its window."""
    packed = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", F.col(x).alias("x"), F.col(y).alias("y")))).alias("_s"))
    return packed.select(*keys, F.transform("_s", lambda s: s["x"]).alias("xs"), F.transform("_s", lambda s: s["y"]).alias("ys"))


def _lagged(df: DataFrame, max_lag: int) -> DataFrame:
    """One row per lag with the paired parts: lag < 0 pairs x[t] with y[t + |lag|]."""
    lag, n = F.col("lag"), F.size("xs")
    m = F.greatest(n - F.abs(lag), F.lit(0))
    pairs = df.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    cut = {"xs": F.slice("xs", F.greatest(lag, F.lit(0)) + 1, m), "ys": F.slice("ys", F.greatest(-lag, F.lit(0)) + 1, m)}
    return pairs.withColumns(cut)


def wcc_fast(frames: DataFrame, max_lag: int = MAX_LAG, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """``keys, feature, lag, corr``: mean product of z-scores over the overlap of each lag.

    A window of ``max_lag + 2`` frames or fewer raises an error.
    """
    z = zscore_series(frames, [*keys, "feature"])
    s = series(z, [*keys, "feature"], "z_x", "z_y")
    checked = s.withColumn("xs", F.when(F.size("xs") <= max_lag + 2, F.raise_error(F.lit("window too short")).cast("array<double>")).otherwise(F.col("xs")))
    product = _sum(F.zip_with("xs", "ys", lambda a, b: a * b)) / F.size("xs")
    return _lagged(checked, max_lag).select(*keys, "feature", "lag", product.alias("corr"))


def _pearson(xs: Column, ys: Column) -> Column:
    n = F.size(xs)

    def with_means(m: Column) -> Column:
        sxy = _sum(F.zip_with(xs, ys, lambda a, b: (a - m["x"]) * (b - m["y"])))
        sxx = _sum(F.transform(xs, lambda a: (a - m["x"]) * (a - m["x"])))
        syy = _sum(F.transform(ys, lambda b: (b - m["y"]) * (b - m["y"])))
        return let(F.struct(sxy.alias("xy"), sxx.alias("xx"), syy.alias("yy")), lambda s: F.when((F.sqrt(s["xx"] / n) < 1e-8) | (F.sqrt(s["yy"] / n) < 1e-8), 0.0).otherwise(s["xy"] / F.sqrt(s["xx"] * s["yy"])))

    r = let(F.struct((_sum(xs) / n).alias("x"), (_sum(ys) / n).alias("y")), with_means)
    return F.when(n < 3, 0.0).otherwise(F.when(r.isNull() | F.isnan(r) | (F.abs(r) == float("inf")), 0.0).otherwise(r))


def _subs(n: Column, win: int, stride: int) -> tuple[Column, Column, Column]:
    """Length, step and number (from 0) of the sub-windows of a series of ``n`` frames."""
    w = F.least(n, F.lit(win))
    step = F.when(n < win, n).otherwise(F.lit(stride))
    return w, step, F.explode(F.sequence(F.lit(0), F.floor((n - w) / step).cast("int")))


def wcc_pearson(frames: DataFrame, win: int = 60, stride: int = 60, max_lag: int = MAX_LAG) -> DataFrame:
    """``window_id, sub, feature, lag, corr``: Pearson correlation per lag in each sub-window.

    A series shorter than ``win`` is one sub-window. Too short or constant parts give 0.
    Sub-windows that overlap share running sums, so their number costs two look-ups each.
    """
    return _pearson_by_sums(frames, win, stride, max_lag) if stride < win else _pearson_by_slices(frames, win, stride, max_lag)


def _pearson_by_slices(frames: DataFrame, win: int, stride: int, max_lag: int) -> DataFrame:
    s = series(frames, ["window_id", "feature"])
    w, step, sub = _subs(F.size("xs"), win, stride)
    cut = s.withColumn("_w", w).withColumn("_step", step).withColumn("sub", sub)
    part = cut.select("window_id", "sub", "feature", F.slice("xs", F.col("sub") * F.col("_step") + 1, F.col("_w")).alias("xs"), F.slice("ys", F.col("sub") * F.col("_step") + 1, F.col("_w")).alias("ys"))
    return _lagged(part, max_lag).select("window_id", "sub", "feature", "lag", _pearson(F.col("xs"), F.col("ys")).alias("corr"))


#: A part whose variance is under this share of its series' sum of squares is computed from its
#: slice: the difference of two running sums would have lost the digits.
FAINT = 1e-5


def _pearson_by_sums(frames: DataFrame, win: int, stride: int, max_lag: int) -> DataFrame:
    """Running sums of x, y, their squares and, for each lag, their products, taken once a series."""
    keys = ["window_id", "feature"]
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("frame")
    to_here = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lags = list(range(-max_lag, max_lag + 1))
    # sums are taken of what lies around the mean of the series; correlation does not change by that
    around = frames.select(*keys, "frame", *[(F.col(c) - F.avg(c).over(whole)).alias(c) for c in ("x", "y")])
    # the product of a lag stands at the later of its two frames
    product = lambda k: F.coalesce(F.col("x") * F.lag("y", k).over(ordered) if k >= 0 else F.col("y") * F.lag("x", -k).over(ordered), F.lit(0.0))
    pairs = around.withColumns({f"_p{i}": product(k) for i, k in enumerate(lags)})
    sums = pairs.select(
        *keys, "frame", "x", "y",
        *[F.sum(v).over(to_here).alias(c) for c, v in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")))],
        F.array(*[F.sum(f"_p{i}").over(to_here) for i in range(len(lags))]).alias("sxy"),
    )
    fields = ("x", "y", "sx", "sy", "sxx", "syy", "sxy")
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", *fields))).alias("_s"))
    s = packed.select(*keys, *[F.col("_s")[f].alias(f) for f in fields])
    w, step, sub = _subs(F.size("x"), win, stride)
    cut = s.withColumn("_w", w).withColumn("_step", step).withColumn("sub", sub).withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    lag, size = F.col("lag"), F.col("_w")
    first, m = F.col("sub") * F.col("_step"), F.greatest(size - F.abs(lag), F.lit(0))
    x0, y0 = first + F.greatest(lag, F.lit(0)), first + F.greatest(-lag, F.lit(0))

    def between(sum_: str, start: Column) -> Column:
        """The sum over ``m`` frames from ``start``."""
        return F.get(F.col(sum_), start + m - 1) - F.coalesce(F.get(F.col(sum_), start - 1), F.lit(0.0))

    at = lambda i: F.coalesce(F.get(F.get(F.col("sxy"), i), lag + max_lag), F.lit(0.0))
    end = first + size - 1
    parts = F.struct(between("sx", x0).alias("x"), between("sy", y0).alias("y"), between("sxx", x0).alias("xx"), between("syy", y0).alias("yy"), (at(end) - at(first + F.abs(lag) - 1)).alias("xy"))
    slices = _pearson(F.slice("x", x0 + 1, m), F.slice("y", y0 + 1, m))

    def r(p: Column) -> Column:
        xx, yy = p["xx"] - p["x"] * p["x"] / m, p["yy"] - p["y"] * p["y"] / m
        clear = (xx > FAINT * F.element_at("sxx", -1)) & (yy > FAINT * F.element_at("syy", -1)) & (xx / m > 1e-14) & (yy / m > 1e-14)
        return F.when(clear, (p["xy"] - p["x"] * p["y"] / m) / F.sqrt(xx * yy)).otherwise(slices)

    return cut.select("window_id", "sub", "feature", "lag", F.when(m < 3, 0.0).otherwise(let(parts, r)).alias("corr"))


def _peaks(wcc: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: the lag of the largest absolute correlation (lowest lag on ties), and lag 0."""
    best = F.max(F.struct(F.abs("corr").alias("a"), (-F.col("lag")).alias("nl"), F.col("corr").alias("c")))
    return wcc.groupBy(*keys).agg(best.alias("b"), F.max(F.when(F.col("lag") == 0, F.col("corr"))).alias("zero")).select(*keys, F.col("b.a").alias("peak"), F.col("b.c").alias("signed"), (-F.col("b.nl")).alias("best_lag"), "zero")


def _lead_columns(fps: float) -> list[Column]:
    lag = F.col("best_lag")
    return [
        F.avg(lag).alias("mean_best_lag_frames"),
        F.stddev_pop(lag).alias("std_best_lag_frames"),
        F.avg(F.abs(lag)).alias("mean_abs_best_lag_frames"),
        (F.avg(lag) / fps).alias("mean_best_lag_sec"),
        (F.avg(F.abs(lag)) / fps).alias("mean_abs_best_lag_sec"),
        F.avg((lag > 0).cast("double")).alias("listener_lead_ratio"),
        F.avg((lag < 0).cast("double")).alias("speaker_lead_ratio"),
        F.avg((lag == 0).cast("double")).alias("zero_lag_ratio"),
    ]


def wcc_summary(wcc: DataFrame, threshold: float = 0.5, fps: float = FPS, keys: tuple[str, ...] = ("window_id",), sub: tuple[str, ...] = ("sub",)) -> DataFrame:
    """19 scalars per window over its sub-windows and features."""
    p = written(_peaks(wcc, [*keys, *sub, "feature"]))
    plain = p.groupBy(*keys).agg(
        F.avg("peak").alias("mean_max_abs_corr"),
        F.stddev_pop("peak").alias("std_max_abs_corr"),
        F.max("peak").alias("max_abs_corr"),
        F.avg("signed").alias("mean_signed_peak_corr"),
        F.stddev_pop("signed").alias("std_signed_peak_corr"),
        F.avg("zero").alias("mean_zero_lag_corr"),
        F.avg(F.abs("zero")).alias("mean_abs_zero_lag_corr"),
        F.stddev_pop("zero").alias("std_zero_lag_corr"),
        *_lead_columns(fps),
        (F.avg((F.col("best_lag") > 0).cast("double")) - F.avg((F.col("best_lag") < 0).cast("double"))).alias("listener_speaker_lead_score"),
        F.avg((F.col("peak") > threshold).cast("double")).alias("high_sync_ratio"),
    )
    return with_medians(plain, p, list(keys), {"median_max_abs_corr": "peak"})


def window_coordination_stats(wcc: DataFrame, threshold: float = 0.3, fps: float = FPS, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """23 scalars per window: the global peak, per-feature peaks, and the lag of the mean profile."""
    k = list(keys)
    # the global peak: largest |corr|, then lowest lag, then lowest feature
    top = F.max(F.struct(F.abs("corr").alias("a"), (-F.col("lag")).alias("nl"), (-F.col("feature")).alias("nf"), F.col("corr").alias("c")))
    peak = wcc.groupBy(*k).agg(top.alias("g"))
    profile = wcc.groupBy(*k, "lag").agg(F.avg(F.abs("corr")).alias("a"), F.avg("corr").alias("s")).groupBy(*k).agg(F.max(F.struct("a", (-F.col("lag")).alias("nl"), "s")).alias("m"))
    per_feature = written(_peaks(wcc, [*k, "feature"]))
    plain = per_feature.groupBy(*k).agg(
        F.avg("peak").alias("mean_max_abs_corr"),
        F.stddev_pop("peak").alias("std_max_abs_corr"),
        F.avg("zero").alias("mean_zero_lag_corr"),
        F.avg(F.abs("zero")).alias("mean_abs_zero_lag_corr"),
        F.stddev_pop("zero").alias("std_zero_lag_corr"),
        *_lead_columns(fps),
        F.avg((F.col("peak") >= threshold).cast("double")).alias("high_sync_ratio"),
    )
    rest = with_medians(plain, per_feature, k, {"median_max_abs_corr": "peak"})
    both = rest.join(peak, k).join(profile, k)
    lag = lambda c: (-F.col(c)).cast("int")
    return both.select(
        *k,
        F.col("g.a").alias("global_peak_abs_corr"),
        F.col("g.c").alias("global_peak_signed_corr"),
        lag("g.nl").alias("global_peak_lag_frames"),
        (lag("g.nl") / fps).alias("global_peak_lag_sec"),
        lag("m.nl").alias("best_mean_lag_frames"),
        (lag("m.nl") / fps).alias("best_mean_lag_sec"),
        F.col("m.a").alias("best_mean_abs_corr"),
        F.col("m.s").alias("best_mean_signed_corr"),
        *[c for c in rest.columns if c not in k],
    )


def mean_pool(frames: DataFrame, source_hz: float, target_hz: float, by: tuple[str, ...] = ("window_id", "feature"), columns: tuple[str, ...] = ("x",)) -> DataFrame:
    """Means of each ``source/target`` frames; a last incomplete group is dropped."""
    ratio = source_hz / target_hz
    k = round(ratio)
    if k < 1 or abs(ratio - k) > 1e-9:
        raise ValueError(f"{source_hz} Hz is not a whole multiple of {target_hz} Hz")
    pooled = frames.groupBy(*by, F.floor(F.col("frame") / k).alias("frame")).agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in columns])
    return pooled.where(F.col("_n") == k).drop("_n")


def fix_seq_len(matrix: Column, target_t: int, dim: int) -> Column:
    """Rows cut or padded with zero rows to ``target_t``; a row of another width is an error."""
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), dim), target_t)
    fixed = F.slice(F.concat(matrix, zeros), 1, target_t)
    return F.when(F.exists(matrix, lambda r: F.size(r) != dim), F.raise_error(F.lit("wrong feature width")).cast("array<array<double>>")).otherwise(fixed)


def orient_lag_matrix(matrix: Column, max_lag: int = MAX_LAG) -> Column:
    """Lags first: the matrix as it is, or transposed, by which side has 2 * max_lag + 1; else an error."""
    n = 2 * max_lag + 1
    flipped = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(matrix, lambda row: F.get(row, i)))
    bad = F.raise_error(F.lit("no side has as many entries as there are lags")).cast("array<array<double>>")
    return F.when(F.size(matrix) == n, matrix).when(F.size(F.get(matrix, 0)) == n, flipped).otherwise(bad)


def assemble_streams(samples: DataFrame, streams: DataFrame, features: DataFrame) -> DataFrame:
    """Per sample the arrays of its streams in configured order; samples that lack one are left out.

    ``samples``: sample_key, window_id, speaker_file_id, listener_file_id; ``streams``:
    stream_idx, modality, role; ``features``: modality, file_id, window_id, values.
    """
    asked = samples.crossJoin(few(streams))
    file_id = F.when(F.col("role") == "speaker", F.col("speaker_file_id")).otherwise(F.col("listener_file_id"))
    found = asked.withColumn("file_id", file_id).join(features, ["modality", "file_id", "window_id"])
    packed = found.groupBy("sample_key").agg(F.array_sort(F.collect_list(F.struct("stream_idx", "values"))).alias("s"))
    whole = packed.crossJoin(F.broadcast(streams.agg(F.count("*").alias("_n")))).where(F.size("s") == F.col("_n"))
    return whole.select("sample_key", F.transform("s", lambda x: x["values"]).alias("streams"))


def label_segments(windows: DataFrame, partition: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Runs of windows with one label in which each starts where the one before ended.

    ``partition`` keeps files apart; an empty one treats all files as one. Windows are dealt by
    ranges of their order, so neither a long file nor all files together meet in one task: each
    task finds the runs of its own range, and a small table of the ranges' first and last windows
    says which runs go on and how many came before.
    """
    keys, order = list(partition), ["start_s", "end_s", "window_id", "label"]
    spark = windows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(windows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    follows = lambda label, end: F.coalesce((F.col("label") == label) & (F.col("start_s") == end), F.lit(False))
    marked = dealt.withColumn("_goes_on", follows(F.lag("label").over(inside), F.lag("end_s").over(inside))).withColumn("_row", F.row_number().over(inside))
    marked = marked.withColumn("_run", F.sum((~F.col("_goes_on")).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # one row a range (and file in it): its first and last window, and its runs
    ends = dealt.groupBy(*keys, "_part").agg(F.min(F.struct(*order)).alias("_first"), F.max(F.struct(*order)).alias("_last"))
    runs = marked.groupBy(*keys, "_part").agg(F.max("_run").alias("_runs"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*keys, "_part"]]
    table = written(ends.alias("e").join(runs.alias("r"), same("e", "r")).select("e.*", "r._runs"))
    before = Window.partitionBy(*keys).orderBy("_part")
    carried = table.withColumn("_last", F.lag("_last").over(before))
    carried = carried.withColumn("_joins", F.coalesce((F.col("_last.label") == F.col("_first.label")) & (F.col("_last.end_s") == F.col("_first.start_s")), F.lit(False)).cast("long"))
    # a range whose first run goes on has one new run less
    added = F.sum(F.col("_runs") - F.col("_joins")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_runs")
    carried = carried.select(*keys, "_part", added.alias("_before"))
    numbered = marked.alias("w").join(carried.alias("c"), same("w", "c")).select("w.*", (F.col("w._run") + F.col("c._before")).alias("segment_id"))
    return numbered.groupBy(*partition, "segment_id", "label").agg(
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        F.count("*").alias("n_windows"),
        F.avg("mean_max_abs_corr").alias("mean_peak_corr"),
        F.avg("mean_abs_zero_lag_corr").alias("mean_zero_lag_abs_corr"),
        F.avg("mean_best_lag_sec").alias("mean_best_lag_sec"),
        F.avg("speaker_lead_ratio").alias("mean_speaker_lead_ratio"),
        F.avg("listener_lead_ratio").alias("mean_listener_lead_ratio"),
    ).withColumn("duration_s", F.col("end_s") - F.col("start_s"))
