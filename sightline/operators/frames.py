"""Frames: canonical rows, temporal re-ranking, sequences, regions, windows for a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import markers, text, timing
from sightline.operators import intervals as I
from sightline.operators.core import keep_first, ordered_text, top_n


def frame_rows(raw):
    """Retrieved frames in canonical form: one time, one path, clip, rationale and score."""
    return raw.select(
        "video_id",
        F.coalesce("timestamp_s", "timestamp").alias("timestamp_s"),
        F.col("frame_path").alias("relpath"),
        F.col("clip.start_s").alias("clip_start_s"),
        F.coalesce(text.blank_to_null(F.col("rationale")), F.lit("retrieved")).alias("rationale"),
        F.col("score").alias("relevance_score"),
    )


def stability(share: float):
    """Share of the mean score of the other rows nearby; none gives zero."""
    return F.when(F.col("others_n") > 0, share * (F.col("others_sum") / F.col("others_n"))).otherwise(F.lit(0.0))


def temporal_rerank(frames, clips, structured: bool, anchors_ms: list[int]):
    """Re-rank scored frames by their neighbours, by anchors (a short list of one request) and by progress.

    ``clips`` gives clip_start_ms and clip_end_ms per video. Scores are millionths; ties end at distance, then time.
    """
    span = F.greatest(F.lit(0), F.col("clip_end_ms") - F.col("clip_start_ms"))
    reach = F.greatest(F.lit(1000), F.least(F.lit(2000), F.when(span > 0, F.floor(span * 0.15)).otherwise(1000)))
    placed = frames.join(clips, "video_id").withColumn("_reach", reach)
    rows = I.neighbour_sums_within(placed, ["video_id"], "t_ms", "score_u", "_reach")
    t, lo, hi = F.col("t_ms"), F.col("clip_start_ms"), F.col("clip_end_ms")
    bonus = stability(0.18 if structured else 0.08)
    if anchors_ms:
        window = F.greatest(F.lit(1000.0), F.least(F.lit(2500.0), F.when(span > 0, span * 0.2).otherwise(1000.0)))
        distance = F.array_min(F.array(*[F.abs(t - a) for a in anchors_ms]))
        rows = rows.withColumns({"distance_ms": distance, "_w": window})
        pull = 0.25 * F.greatest(F.lit(0.0), 1.0 - F.col("distance_ms") / F.col("_w"))
        alive = rows.groupBy("video_id").agg(F.bool_or(F.col("distance_ms") <= F.col("_w")).alias("_any"))
        rows = rows.join(alive, "video_id")
        outside = F.col("_any") & (F.col("distance_ms") > F.col("_w"))
        pull = F.when(outside, pull * 0.5).otherwise(pull) * 1_000_000.0
    else:
        rows = rows.withColumn("distance_ms", F.lit(None).cast("long"))
        pull = F.lit(0.0)
    progress = F.when(span > 0, 0.04 * ((t - lo) / span)).otherwise(0.0) * 1_000_000.0 if structured else F.lit(0.0)
    score = F.round(F.col("score_u") + bonus + pull + progress).cast("long")
    return rows.withColumn("temporal_u", score).select("seq", "video_id", "t_ms", "score_u", "distance_ms", "temporal_u")


def frame_sequence_context(frames, keys):
    """Sentence on a frame sequence: first anchor, radius and the first twelve times."""
    first = top_n(frames, keys, [F.col("t_ms"), F.col("seq")], 12, "_pos")
    seconds = timing.seconds_text(timing.to_s(F.col("t_ms")))
    listed = first.groupBy(*keys).agg(ordered_text(seconds, ", ", F.col("_pos")).alias("_times"))
    head = frames.groupBy(*keys).agg(F.min_by("anchor_ms", "seq").alias("_a"), F.min_by("radius_ms", "seq").alias("_r"))
    said = F.concat_ws(
        " ",
        F.concat(F.lit("Frames in time order around "), F.coalesce(timing.seconds_text(timing.to_s(F.col("_a"))), F.lit("the requested time")), F.lit(".")),
        F.concat(F.lit("Radius "), timing.seconds_text(timing.to_s(F.col("_r"))), F.lit(".")),
        F.concat(F.lit("Times: "), F.col("_times"), F.lit(".")),
    )
    return head.join(listed, list(keys)).select(*keys, said.alias("context"))


def model_scan_windows(frames, durations, width_ms: int, top_k: int, radius: int = 1):
    """Windows worth a model call: those of the best frames and their neighbours, within a budget."""
    budget = max(top_k, max(top_k * 4, 12))
    best = top_n(frames, ["video_id"], [F.desc("score_u"), F.asc("t_ms"), F.asc("seq")], max(top_k * 4, budget * 2), "_n")
    return I.windows_for_points(best, durations, ["video_id"], width_ms, radius, budget)


def regions_from_detections(detections):
    """Detections with a box, each with its frame: the given one, or a virtual one at the stated time or mid-clip."""
    given = F.col("frame_path").isNotNull()
    middle = (F.col("clip_start_ms") + F.col("clip_end_ms")) / F.lit(2000.0)
    t = F.when(given, timing.to_s(F.col("frame_ms"))).otherwise(F.coalesce(timing.to_s(F.col("t_ms")), middle))
    frame = F.struct("video_id", t.alias("timestamp_s"), F.coalesce("frame_path", F.lit("")).alias("frame_path"))
    return detections.filter(F.col("bbox").isNotNull()).withColumn("frame", frame)


def frames_from_evidence(evidence):
    """Image artifacts of evidence as frames; time and clip come from the artifact, else from the entry.

    One row per (path, time), the first in ledger order.
    """
    rows = evidence.select("*", F.posexplode("artifact_refs").alias("_p", "a"))
    rows = rows.filter(markers.is_image_artifact(F.col("a.kind"), F.col("a.media_type"), F.col("a.relpath")))
    rows = rows.select(
        "seq",
        F.col("_p").alias("position"),
        "a.relpath",
        F.coalesce("a.t_ms", "frame_ms").alias("t_ms"),
        F.coalesce("a.video_id", "video_id").alias("video_id"),
        F.coalesce("start_ms", "end_ms").alias("clip_start_ms"),
        F.coalesce("end_ms", "start_ms").alias("clip_end_ms"),
    )
    keyed = rows.withColumn("_t", F.coalesce(F.col("t_ms").cast("string"), F.lit("")))
    return keep_first(keyed, ["relpath", "_t"], ["seq", "position"]).drop("_t")
