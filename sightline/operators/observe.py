"""Tool results to atomic observations. Times are whole milliseconds; ids follow ``functions.ids``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import text
from sightline.functions.ids import observation_id
from sightline.functions.timing import fixed, to_s
from sightline.operators.core import keep_first

COLUMNS = [
    "observation_id",
    "source_tool",
    "subject",
    "subject_type",
    "predicate",
    "object_text",
    "object_type",
    "atomic_text",
    "numeric_value",
    "time_start_s",
    "time_end_s",
    "frame_ts_s",
    "bbox",
    "speaker_id",
    "confidence",
    "source_artifact_refs",
    "direct_or_derived",
]
KINDS = {"numeric_value": "double", "bbox": "array<double>", "confidence": "double", "source_artifact_refs": "array<string>"}
KINDS |= {"time_start_s": "double", "time_end_s": "double", "frame_ts_s": "double"}


def facts(df: DataFrame, keep: list[str], tool: str, **given: Column | str) -> DataFrame:
    """Rows of the observation schema from the given fields, with their id; ``keep`` columns pass through."""
    cols = {n: F.lit(v) if isinstance(v, str) else v for n, v in given.items()}
    cols.setdefault("object_text", F.lit(""))
    cols.setdefault("object_type", F.lit("text"))
    cols.setdefault("direct_or_derived", F.lit("direct"))
    cols["source_tool"] = F.lit(tool)
    rows = df.select(*keep, *[cols.get(n, F.lit(None)).cast(KINDS.get(n, "string")).alias(n) for n in COLUMNS[1:]])
    names = ["source_tool", "subject", "predicate", "atomic_text", "object_text", "time_start_s", "time_end_s", "frame_ts_s"]
    return rows.withColumn("observation_id", observation_id(*[F.col(n) for n in names])).select(*keep, *COLUMNS)


def _span(start: Column, end: Column, sep: str) -> Column:
    return F.concat(fixed(start, 2), F.lit("s" + sep), fixed(end, 2), F.lit("s"))


def from_intervals(clips: DataFrame, keep: list[str], audio: bool = False) -> DataFrame:
    """Grounded clips (query, start_ms, end_ms, confidence, refs): the query is present in the interval."""
    start, end = to_s(F.col("start_ms")), to_s(F.coalesce("end_ms", "start_ms"))
    asked = F.coalesce(text.blank_to_null(F.col("query")), F.lit("audio event" if audio else "visual event"))
    return facts(
        clips,
        keep,
        "audio_temporal_grounder" if audio else "visual_temporal_grounder",
        subject=asked,
        subject_type="event_query",
        predicate="present_in_interval",
        object_text=_span(start, end, "-"),
        object_type="time_interval",
        atomic_text=F.concat(F.lit('"'), asked, F.lit('" is present from '), _span(start, end, " to "), F.lit(".")),
        time_start_s=start,
        time_end_s=end,
        confidence=F.col("confidence"),
        source_artifact_refs=F.col("refs"),
    )


def from_frames(frames: DataFrame, keep: list[str]) -> DataFrame:
    """Retrieved frames (query, t_ms, score, own_refs, refs): own artifacts first, else the tool's."""
    t = to_s(F.col("t_ms"))
    own = F.filter("own_refs", lambda r: F.trim(F.coalesce(r, F.lit(""))) != "")
    return facts(
        frames,
        keep,
        "frame_retriever",
        subject=F.coalesce(text.blank_to_null(F.col("query")), F.lit("requested frame")),
        subject_type="frame_query",
        predicate="retrieved_frame_at",
        object_text=F.concat(fixed(t, 2), F.lit("s")),
        object_type="timestamp",
        atomic_text=F.concat(F.lit("A candidate frame was retrieved at "), fixed(t, 2), F.lit("s.")),
        frame_ts_s=t,
        confidence=F.col("score"),
        source_artifact_refs=F.when(F.size(own) > 0, F.array_distinct(own)).otherwise(F.col("refs")),
    )


def from_transcripts(segments: DataFrame, keep: list[str]) -> DataFrame:
    """Segments (speaker_id, text, start_ms, end_ms, confidence, refs): one fact per sentence."""
    start, end = to_s(F.col("start_ms")), to_s(F.coalesce("end_ms", "start_ms"))
    who = F.coalesce(text.blank_to_null(F.col("speaker_id")), F.lit("unknown_speaker"))
    said = segments.withColumn("_s", F.explode(text.sentence_chunks(F.col("text"))))
    return facts(
        said,
        keep,
        "asr",
        subject=who,
        subject_type="speaker",
        predicate="said",
        object_text=F.col("_s"),
        object_type="utterance",
        atomic_text=F.concat(who, F.lit(' said "'), F.col("_s"), F.lit('" from '), _span(start, end, " to "), F.lit(".")),
        time_start_s=start,
        time_end_s=end,
        speaker_id=who,
        confidence=F.col("confidence"),
        source_artifact_refs=F.col("refs"),
    )


def chunk_rows(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Distinct atomic pieces of a text per row identity ``keys`` (case ignored, first spelling kept)."""
    pieces = df.select("*", F.posexplode(text.atomic_pieces(F.col(column))).alias("_i", "chunk")).drop(column)
    pieces = pieces.withColumn("_low", F.lower("chunk"))
    return keep_first(pieces, [*keys, "_low"], ["_i"]).drop("_low", "_i")


def from_captions(captions: DataFrame, keys: list[str]) -> DataFrame:
    """Dense captions (start_ms, end_ms, visual, audio, on_screen_text, actions, objects, attributes, refs).

    Six kinds of facts. Screen text ``none`` and audio ``none`` or ``unknown`` are no facts.
    """
    start, end = to_s(F.col("start_ms")), to_s(F.coalesce("end_ms", "start_ms"))
    time = _span(start, end, " to ")
    base = [*keys, "start_ms", "end_ms", "refs"]

    def made(rows: DataFrame, subject: Column | str, kind: str, predicate: str, what: str, said: Column, obj: Column | None = None) -> DataFrame:
        return facts(
            rows, keys, "dense_captioner", subject=subject, subject_type=kind, predicate=predicate, object_type=what,
            object_text=F.col("chunk") if obj is None else obj, atomic_text=said,
            time_start_s=start, time_end_s=end, source_artifact_refs=F.col("refs"),
        )

    def items(name: str) -> DataFrame:
        rows = captions.select(*base, F.explode(name).alias("chunk")).withColumn("chunk", text.strip(F.col("chunk")))
        return rows.filter("chunk <> ''")

    def chunks(name: str, *blanks: str) -> DataFrame:
        rows = chunk_rows(captions.select(*base, name), keys, name)
        return rows.filter(~F.lower("chunk").isin(*blanks)) if blanks else rows

    c = F.col("chunk")
    out = made(items("actions"), "video_segment", "clip", "shows_action", "action", F.concat(F.lit("The clip from "), time, F.lit(" shows: "), c, F.lit(".")))
    parts = [
        made(items("objects"), c, "entity", "appears_in_clip", "time_interval", F.concat(c, F.lit(" appears from "), time, F.lit(".")), _span(start, end, "-")),
        made(chunks("on_screen_text", "none"), "screen", "frame", "shows_text", "text", F.concat(F.lit("Visible text from "), time, F.lit(': "'), c, F.lit('".'))),
        made(chunks("visual"), "video_segment", "clip", "visual_fact", "text", F.concat(F.lit("Visual fact from "), time, F.lit(": "), c, F.lit("."))),
        made(chunks("audio", "none", "unknown"), "audio_track", "audio", "contains_audio_event", "text", F.concat(F.lit("Audio fact from "), time, F.lit(": "), c, F.lit("."))),
        made(items("attributes"), "video_segment", "clip", "has_attribute", "attribute", F.concat(F.lit("An observed attribute from "), time, F.lit(" is: "), c, F.lit("."))),
    ]
    for part in parts:
        out = out.unionByName(part)
    return out


def from_text_reads(reads: DataFrame, keep: list[str]) -> DataFrame:
    """Text reads (lines, text, t_ms, region_box, region_refs, frame_refs, refs): one fact per line.

    Without lines the sentences of the whole text count. A line's own box wins over its region's.
    """
    sentences = F.transform(text.sentence_chunks(F.col("text")), lambda s: F.struct(s.alias("text"), F.lit(None).cast("array<double>").alias("bbox")))
    lines = F.when(F.coalesce(F.size("lines"), F.lit(0)) > 0, F.col("lines")).otherwise(sentences)
    rows = reads.withColumn("_l", F.explode(lines)).withColumn("_t", text.strip(F.col("_l.text"))).filter("_t <> ''")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return facts(
        rows,
        keep,
        "ocr",
        subject="screen",
        subject_type="frame",
        predicate="contains_text",
        object_text=F.col("_t"),
        atomic_text=F.concat(F.lit('OCR detected text: "'), F.col("_t"), F.lit('".')),
        numeric_value=text.numeric_from_text(F.col("_t")),
        bbox=F.coalesce("_l.bbox", "region_box"),
        frame_ts_s=to_s(F.col("t_ms")),
        source_artifact_refs=F.coalesce(some("region_refs"), some("frame_refs"), F.col("refs")),
    )


def box_text(box: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(box, lambda v: v.cast("string")), ", "), F.lit("]"))


def from_detections(detections: DataFrame, keep: list[str]) -> DataFrame:
    """Boxes (label, bbox, t_ms, confidence, refs): where an entity is in its frame."""
    who = F.coalesce(text.blank_to_null(F.col("label")), F.lit("entity"))
    where = box_text(F.col("bbox"))
    return facts(
        detections,
        keep,
        "spatial_grounder",
        subject=who,
        subject_type="entity",
        predicate="located_in_frame",
        object_text=where,
        object_type="bbox",
        atomic_text=F.concat(who, F.lit(" is located at "), where, F.lit(" in the frame.")),
        bbox=F.col("bbox"),
        frame_ts_s=to_s(F.col("t_ms")),
        confidence=F.col("confidence"),
        source_artifact_refs=F.col("refs"),
    )


def from_reports(reports: DataFrame, keys: list[str], raw: Column | None = None) -> DataFrame:
    """Free answers (answer, points, refs): one derived fact per chunk.

    ``frame N`` in a chunk narrows its sources to the N-th artifact. A report without any text falls back to
    the first 500 characters of ``raw``.
    """
    pieces = F.concat(F.transform("points", lambda p: p), F.filter(F.array("answer"), lambda a: F.trim(F.coalesce(a, F.lit(""))) != ""))
    texts = reports.select(*keys, "refs", F.posexplode(pieces).alias("part_no", "body"))
    chunks = chunk_rows(texts, [*keys, "part_no"], "body")
    n = F.regexp_extract(F.lower("chunk"), r"\bframe\s+(\d+)\b", 1).try_cast("int")
    one = F.when(n > 0, F.try_element_at("refs", n))
    refs = F.when(one.isNotNull(), F.array(one)).otherwise(F.col("refs"))
    out = facts(
        chunks, keys, "generic_purpose", subject="generic_tool", subject_type="tool", predicate="reported",
        object_text=F.col("chunk"), atomic_text=F.col("chunk"), source_artifact_refs=refs, direct_or_derived="derived",
    )
    if raw is None:
        return out
    empty = reports.withColumn("_raw", F.substring(raw, 1, 500)).filter(F.size(pieces) == 0)
    rest = facts(
        empty, keys, "generic_purpose", subject="generic_purpose", subject_type="tool", predicate="reported", object_type="json",
        object_text=F.col("_raw"), atomic_text=F.col("_raw"), source_artifact_refs=F.col("refs"), direct_or_derived="derived",
    )
    return out.unionByName(rest)


def atomic_chunks(docs, key: str, column: str):
    """Distinct atomic facts per key (case ignored, first spelling kept) with their position."""
    pieces = docs.select(key, F.posexplode(text.atomic_pieces(F.col(column))).alias("pos", "chunk"))
    pieces = pieces.withColumns({"_low": F.lower("chunk"), "pos": F.col("pos").cast("long")})
    return keep_first(pieces, [key, "_low"], ["pos"]).drop("_low")
