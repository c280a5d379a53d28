"""Time column functions. Times are seconds (double) at the edges and whole milliseconds inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import contains_any, let, normalize_phrase, strip


def to_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000.0).cast("long")


def to_s(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def fixed(c: Column, places: int) -> Column:
    """Decimal text with a fixed number of places, ties decided on the exact binary value."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * places))


def seconds_text(c: Column) -> Column:
    """12.500 -> 12.5s"""
    return F.concat(F.regexp_replace(F.regexp_replace(fixed(c, 3), "0+$", ""), r"\.$", ""), F.lit("s"))


def interval_text(start: Column, end: Column) -> Column:
    lo, hi = F.coalesce(start, end), F.coalesce(end, start)
    return F.when(lo == hi, seconds_text(lo)).otherwise(
        F.concat(seconds_text(lo), F.lit(" to "), seconds_text(hi))
    )


def anchor_text(intervals: Column | None, start: Column, end: Column, frame: Column) -> Column:
    """Time anchor of a row: its intervals, else its range, else its frame time, else empty."""
    single = F.coalesce(interval_text(start, end), seconds_text(frame), F.lit(""))
    if intervals is None:
        return single
    listed = F.array_join(F.transform(intervals, lambda i: interval_text(i["start_s"], i["end_s"])), "; ")
    return F.when(F.coalesce(F.size(intervals), F.lit(0)) > 0, listed).otherwise(single)


COLON_TIME = r"(?<!\d)(\d{1,3}(?::\d{1,2}){1,2}(?:\.\d+)?)(?!\d)"
SECONDS = r"(?i)(\d+(?:\.\d+)?)\s*(?:seconds?|secs?|s)\b"
# Fixed value: words that may stand before a time of a hint; such a time goes before any other.
LED_SECONDS = r"(?i)(?:frame|timestamp|time|at|around|near|second|sec|s)\s*(?:=|:)?\s*(\d+(?:\.\d+)?)\s*(?:seconds?|secs?|s)\b"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"


def parse_timecode(c: Column) -> Column:
    """``m:s`` or ``h:m:s`` anywhere in a text, else seconds after a leading word, else any seconds."""

    def clock(t: Column) -> Column:
        part = lambda i: F.try_element_at(t["p"], F.lit(i)).try_cast("double")
        hours = part(1) * 3600.0 + part(2) * 60.0 + part(3)
        return F.when(F.size(t["p"]) == 3, hours).otherwise(part(1) * 60.0 + part(2))

    colon = let({"p": F.split(F.regexp_extract(c, COLON_TIME, 1), ":")}, clock)
    seconds = [F.regexp_extract(c, p, 1).try_cast("double") for p in (LED_SECONDS, SECONDS)]
    return F.coalesce(colon, *seconds)


# Words that place a hint inside a clip.
HINT_AFTER = ["after", "from start", "into"]
HINT_BEFORE_END = ["before end", "before the end", "from end"]
HINT_LOCAL = ["clip", "window", "segment", "local"]
HINT_START = ["start", "begin", "opening", "onset", "first"]
HINT_END = ["end", "finish", "closing", "last"]
HINT_MIDDLE = ["mid", "center", "centre"]


def hint_anchor(hint: Column, clip_start: Column, clip_end: Column) -> Column:
    """Second of a clip that a time hint points to, or null.

    A percentage is read from the raw hint, so ``50%`` works.
    """

    def place(h: Column) -> Column:
        words, sec, start, end = h["words"], h["sec"], h["start"], h["end"]
        span = F.greatest(F.lit(0.0), end - start)
        return (
            F.when(words == "", F.lit(None).cast("double"))
            .when(h["percent"].isNotNull(), start + span * F.least(F.lit(1.0), h["percent"] / 100.0))
            .when(sec.isNotNull() & contains_any(words, HINT_AFTER), F.least(end, start + sec))
            .when(sec.isNotNull() & contains_any(words, HINT_BEFORE_END), F.greatest(start, end - sec))
            .when((sec >= start) & (sec <= end), sec)
            .when((sec <= span) & contains_any(words, HINT_LOCAL), F.least(end, start + sec))
            .when((start <= 0.001) & (sec <= end), sec)
            .when(contains_any(words, HINT_START), start)
            .when(contains_any(words, HINT_END), end)
            .when(contains_any(words, HINT_MIDDLE), start + span / 2.0)
        )

    read = {
        "words": normalize_phrase(hint),
        "percent": F.regexp_extract(hint, PERCENT, 1).try_cast("double"),
        "sec": parse_timecode(hint),
        "start": clip_start,
        "end": clip_end,
    }
    return let(read, place)


def hint_clip(hint: Column, duration: Column) -> Column:
    """Clip named by a loose hint such as ``last 20%`` or ``first 30 seconds``."""

    def cut(h: Column) -> Column:
        # greatest and least pass over nulls, so a missing percentage is tested for.
        share = F.greatest(F.lit(0.01), F.least(F.lit(1.0), h["percent"] / 100.0))
        part = F.when(h["percent"].isNotNull(), h["duration"] * share)
        window = F.coalesce(part, h["sec"], h["duration"] * 0.2)
        window = F.greatest(F.lit(1.0), F.least(h["duration"], window))
        return F.struct(h["word"].alias("word"), h["duration"].alias("d"), window.alias("w"))

    def place(h: Column) -> Column:
        word, d, w = h["word"], h["d"], h["w"]
        tail = F.greatest(F.lit(0.0), d - w)
        centred = F.greatest(F.lit(0.0), d / 2.0 - w / 2.0)
        start = F.when(word == "start", F.lit(0.0)).when(word == "middle", centred).otherwise(tail)
        end = F.when(word == "end", d).otherwise(F.least(d, start + w))
        empty = (d <= 0.0) | d.isNull()
        zero = F.lit(0.0)
        return F.struct(
            F.when(empty, zero).otherwise(start).alias("start_s"),
            F.when(empty, zero).otherwise(F.greatest(start, end)).alias("end_s"),
        )

    def read(t: Column) -> Column:
        text = t["text"]
        word = (
            F.when(contains_any(text, ["last", "final", "end"]), F.lit("end"))
            .when(contains_any(text, ["first", "opening", "start", "beginning"]), F.lit("start"))
            .when(F.contains(text, F.lit("mid")), F.lit("middle"))
            .otherwise(F.lit("end"))
        )
        parts = {
            "word": word,
            "percent": F.regexp_extract(text, PERCENT, 1).try_cast("double"),
            "sec": F.regexp_extract(text, SECONDS, 1).try_cast("double"),
            "duration": t["duration"],
        }
        return F.when(text != "", let({"c": let(parts, cut)}, lambda h: place(h["c"])))

    return let({"text": F.lower(strip(hint)), "duration": duration}, read)


def clamp_clip(start: Column, end: Column, duration: Column) -> Column:
    lo = F.greatest(F.lit(0.0), F.coalesce(start, F.lit(0.0)))
    hi = F.coalesce(end, duration)
    hi = F.when(duration > 0.0, F.least(duration, hi)).otherwise(hi)
    return F.struct(lo.alias("start_s"), F.greatest(lo, hi).alias("end_s"))


def anchor_scope(anchor: Column, radius: Column, start: Column, end: Column) -> Column:
    """Anchor ± radius cut to the scope; an empty cut gives the scope back."""
    lo = F.greatest(start, anchor - radius)
    hi = F.least(end, anchor + radius)
    keep = anchor.isNotNull() & (hi > lo)
    return F.struct(
        F.when(keep, lo).otherwise(start).alias("start_s"), F.when(keep, hi).otherwise(end).alias("end_s")
    )


def anchor_time(time_s: Column, timecode: Column, reference: Column, clip_start: Column) -> Column:
    """Second of an anchor: its time, else its timecode; counted from the clip's start where it refers to the clip or scope."""
    at = F.coalesce(time_s, parse_timecode(timecode))
    local = F.lower(F.coalesce(F.nullif(reference, F.lit("")), F.lit("video"))).isin("clip", "scope")
    return F.when(local, F.coalesce(clip_start, F.lit(0.0)) + at).otherwise(at)


def anchor_radius(radius_s: Column, default_s: Column) -> Column:
    """An anchor's own radius, else the scope's, else two seconds; the scope's zero counts as none."""
    return F.coalesce(radius_s, F.nullif(default_s, F.lit(0.0)), F.lit(2.0))


def clip_sample_count(start: Column, end: Column, fps: Column) -> Column:
    """Samples of a clip at a rate: what is begun counts, one at least."""
    span = F.greatest(F.lit(0.0), F.coalesce(end, start) - F.coalesce(start, F.lit(0.0)))
    return F.greatest(F.lit(1), F.ceil(span * fps).cast("int"))


def absolute_ms(raw_start: Column, raw_end: Column, clip_start: Column, clip_end: Column) -> Column:
    """Span times in ms, read as clip-relative or absolute, shifted and cut to the clip (1 ms slack)."""
    length = F.greatest(F.lit(0).cast("long"), clip_end - clip_start)
    lo = F.coalesce(raw_start, F.lit(0).cast("long"))
    hi = F.greatest(lo, F.coalesce(raw_end, F.when(length > 0, length).otherwise(lo)))
    relative = (length <= 0) | ((lo >= 0) & (hi <= length + 1))
    absolute = (lo >= clip_start - 1) & (hi <= clip_end + 1)
    shift = F.when(relative & ~absolute, clip_start).otherwise(F.lit(0).cast("long"))
    start = F.greatest(clip_start, F.least(clip_end, lo + shift))
    end = F.greatest(start, F.least(clip_end, hi + shift))
    none = raw_start.isNull() & raw_end.isNull()
    return F.struct(
        F.when(none, clip_start).otherwise(start).alias("start_ms"),
        F.when(none, clip_end).otherwise(end).alias("end_ms"),
    )


def sample_times(start: Column, end: Column, n: Column, collapse: str = "start") -> Column:
    """``n`` evenly spaced times; one sample sits in the middle; an empty span gives one time."""
    middle = (start + end) / 2.0
    step = (end - start) / F.nullif((n - 1).cast("double"), F.lit(0.0))
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * step)
    point = start if collapse == "start" else middle
    return F.when(end <= start, F.array(point)).when(n <= 1, F.array(middle)).otherwise(many)


def dense_times(start: Column, end: Column, fps: float = 1.0) -> Column:
    """Grid of 1/fps; spans under one second are widened by half a second on both sides."""
    short = (end - start) < 1.0
    lo = F.when(short, F.greatest(F.lit(0.0), start - 0.5)).otherwise(start)
    hi = F.when(short, end + 0.5).otherwise(end)
    n = F.greatest(F.lit(1), F.floor((hi - lo) * fps).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: lo + i * F.lit(1.0 / fps))


def run_id_time(c: Column) -> Column:
    """Wall clock in a run id such as ``20260428T184655Z_1be8c339``; null when it is no time."""
    iso = F.regexp_replace(
        F.regexp_extract(c, r"^(\d{8}T\d{6})Z", 1),
        r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})$",
        "$1-$2-$3 $4:$5:$6",
    )
    return iso.try_cast("timestamp_ntz")


def elapsed_s(started: Column, finished: Column) -> Column:
    """Seconds between two ISO time texts."""
    lo, hi = started.try_cast("timestamp_ntz"), finished.try_cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", lo, hi) / F.lit(1_000_000.0)


def clip_artifact_id(start: Column, end: Column) -> Column:
    """``clip_SSS_SS_EEE_EE`` from the two times at two places."""

    def part(c: Column) -> Column:
        text = fixed(c, 2)
        return F.replace(F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text), F.lit("."), F.lit("_"))

    return F.concat(F.lit("clip_"), part(start), F.lit("_"), part(end))


def intervals_sentence(intervals, shown: int = 4):
    """Sentence naming the first intervals and, when more exist, their total."""
    parts = F.transform(
        F.slice(intervals, 1, shown),
        lambda i: F.concat(fixed(i["start_s"], 3), F.lit("-"), fixed(i["end_s"], 3), F.lit("s")),
    )
    total = F.when(F.size(intervals) > shown, F.format_string(" (%d total)", F.size(intervals))).otherwise("")
    text_ = F.concat(F.lit("Found at: "), F.array_join(parts, ", "), total, F.lit("."))
    return F.when(F.size(intervals) > 0, text_).otherwise(F.lit("The queried event is absent."))
