"""Runs and rounds: evidence building, round and result summaries, request fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import text
from sightline.operators import ledger as L
from sightline.operators.core import global_rank, keep_first, ordered_list, ordered_text, rank_rows, top_n
from sightline.operators.intervals import SLAB_MS

PART = 1000


def build_evidence(results, observations, limit: int = 2000):
    """Evidence entry per tool result (step_id, tool_name, request_hash, ok): digest, time bounds, counts, id.

    Failed results give an entry with state ``unknown``. Without a digest the summary stands in, cut at the same
    limit. Observation ids stay in the link table (evidence_key, observation_id), which no entry can overflow.
    """
    eid = F.format_string("ev_%02d_%s", F.col("step_id"), F.substring("request_hash", 1, 8))
    digest = L.evidence_digest(observations, "evidence_key", "predicate", limit=limit)
    bounds = L.temporal_bounds(observations, ["evidence_key"])
    made = results.withColumn("evidence_id", eid).join(digest, "evidence_key", "left").join(bounds, "evidence_key", "left")
    status = F.when(F.col("ok"), F.lit("candidate")).otherwise(F.lit("unknown"))
    short = lambda c: F.substring(c, 1, limit)
    body = F.when(F.col("ok"), F.coalesce("digest", short(text.strip(F.col("summary"))))).otherwise(short(F.concat(F.lit("Step failed: "), F.col("summary"))))
    return made.select("evidence_key", "evidence_id", "tool_name", status.alias("status"), body.alias("evidence_text"), "n_observations", "start_ms", "end_ms", "frame_ms", "n_listed")


def evidence_summary(evidence, observations, entries: int = 10, ids: int = 12):
    """Last entries of every run with their state and first observation ids."""
    last = top_n(evidence, ["video_id"], [F.desc("seq")], entries, "_back")
    first = top_n(observations, ["evidence_id"], [F.asc("seq")], ids, "_pos")
    listed = first.groupBy("evidence_id").agg(ordered_text(F.col("observation_id"), ",", F.col("_pos")).alias("observation_ids"))
    status = L.clean_status(F.col("status")).alias("status")
    return last.join(listed, "evidence_id").select("video_id", "evidence_id", "tool_name", status, "observation_ids")


def ledger_by_subject(observations):
    """Readable ledger: one numbered line per observation inside its subject, in time order."""
    placed = rank_rows(observations, ["subject"], "start_ms", "seq", SLAB_MS, out="line_no")
    line = F.concat(F.lit("- ["), L.anchors_of(placed), F.lit("] "), F.col("predicate"))
    return placed.select("subject", "line_no", line.alias("line"))


def group_flags(groups, keys):
    """Fan-out groups of a request: all hit, most frames, bounded frames in total."""
    return groups.groupBy(*keys).agg(
        F.bool_and("hit").alias("cache_hit"),
        F.max("frames").alias("frame_count"),
        F.sum("bounded").alias("bounded_count"),
        F.count(F.lit(1)).alias("groups"),
    )


def round_summary(steps):
    """Steps per round in order, ``PART`` steps per row, with the verdict of the round's last step on each.

    Steps (round_id, line, order, tool, verdict) are numbered by ranges of their order, so neither a round nor one of
    its lines is ever in one task.
    """
    numbered = global_rank(steps, ["round_id"], [F.col("line"), F.col("order")], "pos").withColumn("pos", F.col("pos") - 1)
    parts = numbered.withColumn("part", F.floor(F.col("pos") / PART)).groupBy("round_id", "part").agg(
        ordered_text(F.col("tool"), ",", F.col("pos")).alias("tools"),
        F.count(F.lit(1)).alias("n_steps"),
    )
    verdicts = steps.groupBy("round_id").agg(F.max_by("verdict", F.struct("line", "order")).alias("verdict"))
    return parts.join(verdicts, "round_id")


def final_results(runs, parts):
    """One row per run (run_id, ...) beside its parts (run_id, part, tools, n_steps): its columns, the number of parts and steps, and the first part's tools."""
    counted = parts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.sum("n_steps").alias("n_steps"),
        F.min_by("tools", "part").alias("first_tools"),
    )
    return runs.join(counted, "run_id", "left").fillna({"n_parts": 0, "n_steps": 0, "first_tools": ""})


def result_parts(runs, parts):
    """Every part of a run's steps (run_id, part, tools, n_steps) with the run's columns; a run without steps has one empty part."""
    return runs.join(parts, "run_id", "left").fillna({"part": 0, "tools": "", "n_steps": 0})


COUNT_FIELDS = ["clips", "frames", "reads", "segments", "captions", "transcripts", "regions"]


def result_item_counts(lists):
    """Lengths of the named list fields, empty ones left out."""
    pairs = [x for name, c in lists.items() for x in (F.lit(name), F.coalesce(F.size(c), F.lit(0)))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def merge_group_outputs(groups, part: int = PART):
    """Fan-out results of a request back into one: lists appended, texts joined by a blank line.

    A request comes in parts of ``part`` groups; ``query_absent`` (no group found a clip) is the request's, on each.
    """
    rows = groups.withColumns({"part": F.floor(F.col("idx") / F.lit(part)), "_t": text.blank_to_null(F.col("text"))})
    texts = F.filter(ordered_list(F.coalesce("_t", F.lit("")), F.col("idx")), lambda t: t != "")
    parts = rows.groupBy("request_id", "part").agg(
        F.array_join(texts, "\n\n").alias("text"),
        F.flatten(ordered_list(F.col("clips"), F.col("idx"))).alias("clips"),
        F.count(F.lit(1)).alias("groups"),
    )
    absent = groups.groupBy("request_id").agg((F.max(F.size("clips")) == 0).alias("query_absent"))
    return parts.join(absent, "request_id")


def fanout_requests(requests):
    """One request per region, else per frame, else per clip, else per time hint, else the request itself."""

    def each(name):
        return F.transform(name, lambda v: F.struct(F.lit(name[:-1]).alias("field"), v.alias("item")))

    pick = F.array(F.struct(F.lit("request").alias("field"), F.lit(None).cast("string").alias("item")))
    for name in ("time_hints", "clips", "frames", "regions"):
        pick = F.when(F.coalesce(F.size(name), F.lit(0)) > 0, each(name)).otherwise(pick)
    rows = requests.withColumn("_f", pick).select("request_id", F.posexplode("_f").alias("group_no", "f"))
    return rows.select("request_id", "group_no", "f.field", "f.item")


def artifacts_from_requests(items, source_tool: str):
    """Media items of requests (seq, kind, artifact_id, relpath) as artifact rows, each once.

    The id falls back to the file's stem; an item with neither id nor path gives no row.
    """
    stem = F.regexp_replace(F.regexp_extract("relpath", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    aid = F.coalesce(text.blank_to_null(F.col("artifact_id")), text.blank_to_null(stem))
    media = F.when(F.col("kind") == "clip", "video").when(F.col("kind").isin("frame", "region"), "image")
    rows = items.withColumns({"artifact_id": aid, "media_type": media, "source_tool": F.lit(source_tool)}).filter("artifact_id IS NOT NULL")
    return keep_first(rows, ["artifact_id", "relpath", "kind"], ["seq"])
