"""One-line renderings of evidence and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import text, timing


def evidence_line(evidence_id, anchor, body):
    parts = F.concat_ws(" | ", text.blank_to_null(evidence_id), text.blank_to_null(anchor))
    line = F.when(parts == "", body).otherwise(F.concat(F.lit("["), parts, F.lit("] "), body))
    return F.when(text.strip(body) != "", line)


def media_line(index, artifact_id, timestamp, path, video, clip_start, clip_end):
    clip = F.concat(F.lit("source_clip=["), timing.seconds_text(clip_start), F.lit("-"), timing.seconds_text(clip_end), F.lit("]"))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Image "), index),
        F.concat(F.lit("artifact_id="), artifact_id),
        F.concat(F.lit("timestamp="), timing.seconds_text(timestamp)),
        F.concat(F.lit("relpath="), path),
        F.concat(F.lit("video_id="), video),
        clip,
    )
