"""Scalar functions on columns: ids, names, times, words, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes, and the words that count as backchannels once normalised.
CLASS_NAMES = {0: "HOLD", 1: "YIELD", 2: "BACKCHANNEL", 3: "INTERRUPT", 4: "FAILED", 5: "LAPSE"}
BACKCHANNEL_WORDS = ("mm", "hm", "hmm", "mhm", "mmhmm", "uhhuh", "huh", "ah", "aha", "oh", "yeah", "yep", "yup", "ok", "okay", "sure", "right", "true", "exactly", "totally", "wow", "really", "gotcha")
ASSET_BASE = "https://assets.example.org"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def interaction_id(file_id: Column | str) -> Column:
    """What stands before the last underscore; null without one."""
    return F.nullif(F.regexp_extract(_c(file_id), "^(.*)_([^_]*)$", 1), F.lit(""))


def participant_id(file_id: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(file_id), "^(.*)_([^_]*)$", 2), F.lit(""))


def prompt_hash(interaction: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(interaction), r"I(\d+)", 1), F.lit(""))


def vendor(interaction: Column | str) -> Column:
    return F.split_part(_c(interaction), F.lit("_"), F.lit(1))


def session(interaction: Column | str) -> Column:
    """Second part without its first character."""
    part = F.split_part(_c(interaction), F.lit("_"), F.lit(2))
    return F.substring(part, 2, 1 << 20)


def asset_url(label: Column | str, split: Column | str, category: str, file_id: Column | str, ext: str, base: str = ASSET_BASE) -> Column:
    return F.concat_ws("/", F.lit(base), _c(label), _c(split), F.lit(category), F.concat(_c(file_id), F.lit("." + ext)))


def to_ms(seconds: Column | str) -> Column:
    """Whole milliseconds, half to even."""
    return F.rint(_c(seconds) * 1000.0).cast("long")


def sample_key(file_id: Column | str, seconds: Column | str) -> Column:
    return F.format_string("%s_t_%07d", _c(file_id), to_ms(seconds))


def key_file_id(key: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(key), r"^(.*)_t_(\d+)$", 1), F.lit(""))


def key_end_s(key: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(key), r"^(.*)_t_(\d+)$", 2), F.lit("")).cast("long") / 1000.0


def key_start_s(key: Column | str, window_s: float = 2.0) -> Column:
    return F.bround(key_end_s(key) - window_s, 3)


def window_name(start: Column | str, end: Column | str, file_id: Column | str, width: int = 7, places: int = 2) -> Column:
    number = f"%0{width}.{places}f"
    return F.format_string(f"{number}-{number}_%s", _c(start), _c(end), _c(file_id))


def parse_window_name(name: Column | str) -> Column:
    """Struct ``start, end, file_id`` of a window name."""
    pattern = r"^(\d+\.\d+)-(\d+\.\d+)_(.+)$"
    return F.struct(*[F.nullif(F.regexp_extract(_c(name), pattern, i), F.lit("")).cast(t).alias(n) for i, n, t in ((1, "start", "double"), (2, "end", "double"), (3, "file_id", "string"))])


def clean_file_id(col: Column | str) -> Column:
    out = _c(col)
    for ext in (".mp4", ".npy", ".wav"):
        out = F.replace(out, F.lit(ext), F.lit(""))
    return out


def normalize_word(word: Column | str) -> Column:
    """Lower case, no punctuation, no blanks or hyphens."""
    bare = F.regexp_replace(F.trim(F.lower(_c(word))), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(bare, r"(?U)[\s-]+", "")


def is_backchannel_token(word: Column | str, lexicon: tuple[str, ...] = BACKCHANNEL_WORDS) -> Column:
    return normalize_word(word).isin(*lexicon)


def clip_interval(start: Column | str, end: Column | str, t: Column | str, tau: Column | str) -> Column:
    """Struct ``start, end`` of the part within [t, t + tau]; null if it is empty or a point."""
    a, b = F.greatest(_c(start), _c(t)), F.least(_c(end), _c(t) + _c(tau))
    return F.when(a < b, F.struct(a.alias("start"), b.alias("end")))


def fmt_clock(seconds: Column | str) -> Column:
    """``M:SS.s`` of a time rounded to milliseconds; of two nearest tenths the even one; null gives ``?``."""
    ms = to_ms(seconds)
    minutes = F.floor(ms / 60_000)
    left = ms - minutes * 60_000
    below, over = F.floor(left / 100), left % 100
    tenths = below + F.when((over > 50) | ((over == 50) & (below % 2 == 1)), 1).otherwise(0)
    return F.when(ms.isNull(), F.lit("?")).otherwise(F.format_string("%d:%02d.%d", minutes, F.floor(tenths / 10), tenths % 10))


def class_name(label: Column | str, names: dict[int, str] | None = None) -> Column:
    pairs = [F.lit(x) for kv in (names or CLASS_NAMES).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(label).cast("int"))


def try_float(col: Column | str) -> Column:
    return F.nullif(F.trim(_c(col)), F.lit("")).try_cast("double")


def resolve_column(df: DataFrame, candidates: list[str], required: bool = True) -> str | None:
    """The first candidate that is a column, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    if required:
        raise ValueError(f"none of {candidates} is a column of {df.columns}")
    return None


def window_mid(start: Column | str, end: Column | str) -> Column:
    return (_c(start) + _c(end)) / 2.0


def lag_seconds(lag: Column | str, fps: float = 30.0) -> Column:
    return _c(lag) / fps
