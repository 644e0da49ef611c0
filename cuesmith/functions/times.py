"""Time texts, durations and speeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms of a publishing time.
TIME_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd")


def parse_timecode(text: Column) -> Column:
    """Seconds of [[h:]m:]s with . or , before the fraction; null for other texts."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":", -1)
    part = lambda k: F.get(F.reverse(parts), F.lit(k)).try_cast("double")
    n = F.size(parts)
    sum_ = part(0) + F.when(n > 1, part(1) * 60).otherwise(0.0) + F.when(n > 2, part(2) * 3600).otherwise(0.0)
    return F.when(n <= 3, sum_)


def parse_seconds(value: Column, default: float) -> Column:
    """A number of seconds or a time code; the default for other or negative ones."""
    s = F.coalesce(F.trim(value).try_cast("double"), parse_timecode(value))
    return F.when(s >= 0, s).otherwise(default)


def srt_timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm; negative as zero."""
    ms = F.greatest(F.round(seconds * 1000), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def publish_time(value: Column) -> Column:
    """yyyy-MM-dd HH:mm, or yyyy-MM-dd for a date alone; null for other texts."""
    at = lambda forms: F.coalesce(*[F.try_to_timestamp(F.trim(value), F.lit(f)) for f in forms])
    return F.coalesce(F.date_format(at(TIME_FORMS), "yyyy-MM-dd HH:mm"), F.date_format(at(DATE_FORMS), "yyyy-MM-dd"))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: a whole number, or an HTTP date's distance from now (epoch
    seconds); never negative, null for other texts."""
    at = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^\w+, (.*) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.when(F.trim(value).rlike(r"^\d+$"), F.trim(value).try_cast("double")).otherwise(F.when(at.isNotNull(), F.greatest(at - now, F.lit(0.0))))


def fit_video(video: Column, audio: Column, mode: str) -> tuple[Column, Column, Column]:
    """(target seconds, speed, seconds to trim to) that bring a video to its audio:
    ``trim`` cuts what is over and slows what is short, ``speed`` changes the
    speed, ``none`` leaves it."""
    v, a = F.greatest(video, F.lit(0.01)), F.greatest(audio, F.lit(0.01))
    null = F.lit(None).cast("double")
    if mode == "none":
        return v, F.lit(1.0), null
    if mode == "speed":
        return a, v / a, null
    return a, F.when(v >= a, 1.0).otherwise(v / a), F.when(v >= a, a)


def sync_strategy(audio: Column, video: Column, anchor: str = "head") -> Column:
    """as_is within 0.1 s; else trim by the anchor, slow down by up to 15 % or freeze."""
    gap = audio - video
    trim = {"tail": "trim_head", "center": "trim_center"}.get(anchor, "trim_tail")
    return F.when(F.abs(gap) <= 0.1, "as_is").when(gap < 0, trim).when(gap <= audio * 0.15, "slow").otherwise("freeze")


def tempo_chain(speed: Column) -> Column:
    """Factors of 0.5 to 2 whose product is the speed, which is brought within 0.25
    to 4; whole factors first, the last one to four places, 1.0 for no change."""
    s = F.least(F.greatest(speed.cast("double"), F.lit(0.25)), F.lit(4.0))
    return F.when(s > 2, F.array(F.lit(2.0), F.bround(s / 2, 4))).when(s < 0.5, F.array(F.lit(0.5), F.bround(s / 0.5, 4))).otherwise(F.array(F.bround(s, 4)))


def strict_tempo_chain(speed: Column, least: float = 0.5, most: float = 100.0) -> Column:
    """Factors of `least` to `most` with six places as text, none at a speed of 1; a
    speed that is no positive finite number fails the query."""
    near, s = 1e-3, speed.cast("double")
    count = lambda edge, by: F.greatest(F.ceil(F.log(s / edge) / F.log(F.lit(by)) - 1e-12), F.lit(0))
    up, down = F.when(s > 1, count(most + near, most)).otherwise(0), F.when(s < 1, count(least - near, least)).otherwise(0)
    rest = s / F.pow(F.lit(most), up) / F.pow(F.lit(least), down)
    six = lambda x: F.format_string("%.6f", x)
    chain = F.concat(F.array_repeat(six(F.lit(most)), up.cast("int")), F.array_repeat(six(F.lit(least)), down.cast("int")), F.when(F.abs(rest - 1) >= near, F.array(six(rest))).otherwise(F.array().cast("array<string>")))
    bad = s.isNull() | F.isnan(s) | (s <= 0) | (s == float("inf"))
    return F.when(bad, F.raise_error(F.concat(F.lit("no speed: "), F.coalesce(speed.cast("string"), F.lit("null")))).cast("array<string>")).otherwise(chain)


def backoff(attempt: Column, base: float = 1.0, cap: float = 30.0, jitter: float = 0.2, seed: Column | None = None) -> Column:
    """min(cap, base * 2^(attempt - 1)), moved by up to `jitter` of it by the seed's
    hash, 0.1 at least."""
    wait = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
    if seed is None:
        return F.greatest(wait, F.lit(0.1))
    unit = F.pmod(F.xxhash64(seed), F.lit(1 << 20)) / float(1 << 20)
    return F.greatest(wait * (1 + jitter * (2 * unit - 1)), F.lit(0.1))
