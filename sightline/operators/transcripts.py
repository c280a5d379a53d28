"""Transcripts and captions. Text of a whole transcript comes in parts, so no row grows without bound."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import text, timing
from sightline.operators import intervals as I
from sightline.operators.core import keep_first, ordered_text

PART = 1000


def distinct_ngrams(segments):
    runs = I.segment_ngrams(segments).withColumn("_norm", text.normalize_phrase(F.col("text")))
    first = keep_first(runs, ["transcript_id", "_norm", "start_ms", "end_ms"], ["n_segments", "first_pos"])
    return first.select("transcript_id", "text", "start_ms", "end_ms", "n_segments")


def ordinal_ids(group, n):
    return [
        F.format_string("asr_%02d_%03d", group, n).alias("segment_id"),
        F.format_string("visual_seg_%03d", n).alias("visual_id"),
        F.format_string("audio_seg_%03d", n).alias("audio_id"),
        F.format_string("caption_%03d", n).alias("caption_id"),
    ]


def transcript_text(segments, part: int = PART):
    """Segment texts of a transcript in order, ``part`` segments per row (row 0, 1, … joined give the whole)."""
    placed = segments.withColumn("part", F.floor(F.col("seg_idx") / F.lit(part)))
    return placed.groupBy("transcript_id", "part").agg(
        F.trim(ordered_text(F.trim("text"), " ", F.col("seg_idx"))).alias("text"), F.count(F.lit(1)).alias("n_segments")
    )


def transcript_render(segments, part: int = PART):
    """Header and ``[a-b] speaker: text`` lines per transcript part; an unknown speaker is not shown."""
    start, end = timing.to_s(F.col("start_ms")), timing.to_s(F.col("end_ms"))
    span = F.concat(F.lit("["), timing.seconds_text(start), F.lit("-"), timing.seconds_text(end), F.lit("]"))
    known = F.lower(F.coalesce("speaker_id", F.lit(""))).isin("", "unknown_speaker")
    line = F.concat_ws(" ", span, F.when(~known, F.concat("speaker_id", F.lit(":"))), text.strip(F.col("text")))
    rows = segments.filter(text.strip(F.col("text")) != "").withColumn("line", line)
    rows = rows.withColumn("part", F.floor(F.col("seg_idx") / F.lit(part)))
    body = ordered_text(F.col("line"), "\n", F.col("seg_idx"))
    header = F.concat(F.lit("Transcript "), F.col("transcript_id"), F.lit(":\n"))
    return rows.groupBy("transcript_id", "part").agg(body.alias("body")).select("transcript_id", "part", F.concat(header, "body").alias("block"))


def segments_by_window(segments, width_ms: int):
    """Segments of every fixed caption window; one that crosses windows belongs where it starts."""
    placed = segments.withColumn("window", F.floor(F.col("start_ms") / F.lit(width_ms)))
    return placed.groupBy("transcript_id", "window", F.floor(F.col("seg_idx") / 1000).alias("part")).agg(
        ordered_text(text.strip(F.col("text")), " ", F.col("seg_idx")).alias("text"),
        F.count(F.lit(1)).alias("n_segments"),
        F.max("end_ms").alias("end_ms"),
    )


def transcript_ids(segments, part: int = 1000):
    """Id of a transcript from its segments in order.

    Every ``part`` segments are hashed as one text, and the id is the hash of those hashes in order, so no
    transcript has to fit in one row.
    """
    line = F.concat_ws(":", "seg_idx", F.concat_ws("-", "start_ms", "end_ms"), "speaker_id", "text")
    placed = segments.withColumns({"_line": line, "_part": F.floor(F.col("seg_idx") / F.lit(part))})
    parts = placed.groupBy("transcript_id", "_part").agg(
        F.sha2(ordered_text(F.col("_line"), "\n", F.col("seg_idx")), 256).alias("_h"), F.count(F.lit(1)).alias("_n")
    )
    whole = parts.groupBy("transcript_id").agg(
        ordered_text(F.col("_h"), "", F.col("_part")).alias("_all"), F.sum("_n").alias("n_segments")
    )
    return whole.select("transcript_id", F.concat(F.lit("tx_"), F.substring(F.sha2("_all", 256), 1, 12)).alias("tx"), "n_segments")


def captions_summary(captions, key: str = "video_id", part: int = PART):
    """Texts and ``name: a, b`` lists of every caption, captions in order, ``part`` captions per row."""
    texts = [F.when(~text.is_low_signal(F.col(c)), text.strip(F.col(c))) for c in ("visual", "audio", "on_screen_text")]

    def listed(name):
        good = F.filter(F.transform(F.col(name), text.strip), lambda t: ~text.is_low_signal(t))
        joined = F.array_join(text.distinct_casefold(good), ", ")
        return F.when(joined != "", F.concat(F.lit(f"{name}: "), joined))

    combined = F.concat_ws("; ", *texts, *[listed(n) for n in ("actions", "objects", "attributes")])
    rows = captions.withColumn("_c", combined).filter("_c <> ''").withColumn("part", F.floor(F.col("idx") / F.lit(part)))
    return rows.groupBy(key, "part").agg(ordered_text(F.col("_c"), " ", F.col("idx")).alias("summary"))


# Other names under which caption records hold a text, and lists.
CAPTION_TEXTS = ["id", "timestamp", "time", "start", "end", "visual", "segment_detail_caption", "caption", "description", "audio", "speech_content", "acoustics_content"]
CAPTION_NOTES = ["camera_state", "video_background", "storyline", "shooting_style"]
CAPTION_LISTS = ["on_screen_text", "text_content", "screen_text", "text_overlay", "actions", "key_actions", "objects", "entities", "props", "attributes"]


def caption_spans(raw, clip_start, clip_end):
    """Raw caption records (many names for one thing) as canonical spans; times become clip-absolute.

    Any of the fixed names may be missing. A stamp holds two clock times, one, or seconds around a dash or word
    (``3s - 5s``); it counts where neither start nor end is given, as ``timestamp`` or else ``time``.
    """
    missing = {n: F.lit(None).cast("string") for n in [*CAPTION_TEXTS, *CAPTION_NOTES] if n not in raw.columns}
    raw = raw.withColumns(missing | {n: F.lit(None).cast("array<string>") for n in CAPTION_LISTS if n not in raw.columns})

    def clean(name):
        return F.when(~text.is_low_signal(F.col(name)), text.strip(F.col(name)))

    def tagged(name, tag):
        return F.concat(F.lit(f"{tag}: "), clean(name))

    def distinct(items):
        kept = F.filter(F.transform(items, text.strip), lambda t: t.isNotNull() & ~text.is_low_signal(t))
        return text.distinct_casefold(kept)

    none = F.array().cast("array<string>")
    lists = lambda *names: F.concat(*[F.coalesce(F.col(n), none) for n in names])
    quoted = F.regexp_extract_all("segment_detail_caption", F.lit("""['"]([^'"]{2,200})['"]"""), 1)
    stamp = F.coalesce(text.blank_to_null(F.col("timestamp")), text.blank_to_null(F.col("time")))
    clocks = F.regexp_extract_all(stamp, F.lit(r"(\d+(?::\d{2}){1,2}(?:\.\d+)?)"), 1)
    halves = F.split(stamp, r"\s*(?:-|to|until|through)\s*", 2)
    seconds_ms = lambda c: timing.to_ms(F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"))
    clock_ms = lambda i: timing.to_ms(timing.parse_timecode(F.try_element_at(clocks, F.lit(i))))
    stamp_ms = lambda i: F.when(F.size(clocks) > 0, clock_ms(i)).otherwise(seconds_ms(F.try_element_at(halves, F.lit(i))))
    own = seconds_ms(F.col("start")).isNotNull() | seconds_ms(F.col("end")).isNotNull()
    start = F.when(own, seconds_ms(F.col("start"))).otherwise(stamp_ms(1))
    end = F.when(own, seconds_ms(F.col("end"))).otherwise(stamp_ms(2))
    span = timing.absolute_ms(start, end, clip_start, clip_end)
    audio = distinct(F.array(F.col("audio"), tagged("speech_content", "speech"), tagged("acoustics_content", "acoustics")))
    named = [tagged(n, n) for n in CAPTION_NOTES]
    return raw.select(
        "id",
        span.alias("_t"),
        F.coalesce(*[clean(n) for n in ("visual", "segment_detail_caption", "caption", "description")], F.lit("")).alias("visual"),
        F.array_join(audio, "; ").alias("audio"),
        F.array_join(distinct(F.concat(lists("on_screen_text", "text_content", "screen_text", "text_overlay"), F.coalesce(quoted, none))), " | ").alias("on_screen_text"),
        distinct(lists("actions", "key_actions")).alias("actions"),
        distinct(lists("objects", "entities", "props")).alias("objects"),
        distinct(F.concat(lists("attributes"), F.array(*named))).alias("attributes"),
    ).select("id", "_t.start_ms", "_t.end_ms", "visual", "audio", "on_screen_text", "actions", "objects", "attributes")


def caption_rows(captions):
    """Captions with an id when none is given and one caption text (visual, else summary)."""
    cid = F.coalesce(text.blank_to_null(F.col("caption_id")), F.format_string("caption_%03d", F.col("idx") + 1))
    return captions.select(
        "video_id",
        cid.alias("caption_id"),
        timing.to_s(F.col("start_ms")).alias("start_s"),
        timing.to_s(F.col("end_ms")).alias("end_s"),
        F.coalesce(text.blank_to_null(F.col("visual")), text.blank_to_null(F.col("summary")), F.lit("")).alias("caption"),
    )
