"""Checks over stored plan tables.

``steps``(plan_id, step_id, pos, tool_name, literals array<string> of filled input fields),
``refs``(plan_id, step_id, target_field, source_step_id, field_path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import strip
from sightline.session import materialize

# What each tool emits, and which inputs each tool cannot do without (one of them).
TOOL_OUTPUTS = {
    "asr": ["clips", "transcripts", "phrase_matches"],
    "audio_temporal_grounder": ["query", "clips", "events", "retrieval_backend", "query_absent", "summary"],
    "dense_captioner": ["clips", "captions", "overall_summary", "captioned_range", "sampled_frames"],
    "frame_retriever": ["query", "frames", "mode", "cache_metadata", "rationale"],
    "generic_purpose": ["answer", "supporting_points", "confidence", "analysis"],
    "ocr": ["query", "text", "lines", "reads", "timestamp_s", "source_frame_path", "backend"],
    "spatial_grounder": ["query", "frames", "detections", "regions", "groundings", "spatial_description", "backend"],
    "visual_temporal_grounder": [
        "query",
        "clips",
        "video_duration",
        "retrieval_backend",
        "query_absent",
        "summary",
        "prefilter",
    ],
}
NEEDS_ONE_OF = {
    "asr": ["clips"],
    "audio_temporal_grounder": ["clips"],
    "dense_captioner": ["clips"],
    "frame_retriever": ["clips", "time_hints"],
    "generic_purpose": ["clips", "frames", "transcripts", "text_contexts", "evidence_ids"],
    "ocr": ["clips", "frames", "regions"],
    "spatial_grounder": ["clips", "frames"],
}
# Which output paths may be bound into fields of parts and of hints ([] stands for any one item or the list),
# and which outputs count as text.
PART_PATHS = {
    "clips": ["clips", "clips[]", "frames[].clip", "regions[].frame.clip", "transcripts[].clip"],
    "frames": ["frames", "frames[]", "regions[].frame"],
    "regions": ["regions", "regions[]"],
    "transcripts": ["transcripts", "transcripts[]"],
    "time_hints": ["phrase_matches[].time_hint"],
}
TEXT_OUTPUTS = ["text", "summary", "overall_summary", "analysis", "answer", "supporting_points", "spatial_description", "raw_output_text"]


def _listed(pairs: dict[str, list[str]], tool: Column) -> Column:
    """Values a rule table holds for a tool (null for a tool it does not name)."""
    entries = [x for name, values in pairs.items() for x in (F.lit(name), F.array(*[F.lit(v) for v in values]))]
    return F.try_element_at(F.create_map(*entries), tool)


def _violations(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """All broken rules of a row in one pass; ``rules`` maps a name to (test, detail)."""
    tested = [
        F.when(test, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
        for rule, (test, detail) in rules.items()
    ]
    rows = df.select("plan_id", "step_id", F.explode(F.array_compact(F.array(*tested))).alias("v"))
    return rows.select("plan_id", "step_id", "v.rule", "v.detail")


def plan_lint(steps: DataFrame, refs: DataFrame, cited: DataFrame | None = None, retrieved: DataFrame | None = None, conditioned: DataFrame | None = None) -> DataFrame:
    """One row (plan_id, step_id, rule, detail) per broken rule.

    Steps counted per id, and references with the tools at both ends, are written once and read by every rule.

    ``cited``(plan_id, step_id, evidence_id) are literal evidence ids of steps and ``retrieved``(plan_id, evidence_id)
    what was retrieved for the plan; ``conditioned``(plan_id) are plans whose sound question depends on something
    visible, so their sound steps need clips of a visual step. Rules without their table are not tested.
    """
    key = ["plan_id", "step_id"]
    counts = steps.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min_by("tool_name", "pos").alias("tool_name"))
    counts = materialize(counts, "tools")
    known = counts.select("plan_id", F.col("step_id").alias("source_step_id"), F.col("tool_name").alias("source_tool"))
    wired = refs.join(known, ["plan_id", "source_step_id"], "left").join(counts.select(*key, "tool_name"), key)
    wired = materialize(wired, "wired")
    source, tool, at = F.col("source_tool"), F.col("tool_name"), F.col("source_step_id")
    head = F.regexp_extract("field_path", r"^([^.\[]*)", 1)
    target, path = F.col("target_field"), strip(F.coalesce("field_path", F.lit("")))
    # One index of a list counts as the list's items.
    general = F.regexp_replace(path, r"\[\d+\]|\.\d+(?=\.|$)", "[]")
    bound = F.concat_ws(" -> ", path, target)
    of_refs = {
        "missing_source": (source.isNull(), at),
        "self_reference": (at == F.col("step_id"), F.col("target_field")),
        "later_source": (source.isNotNull() & (at > F.col("step_id")), at),
        # Only outputs of tools with a known output list can be judged.
        "path_not_emitted": (~F.array_contains(_listed(TOOL_OUTPUTS, source), head), F.concat_ws(".", source, "field_path")),
        "time_hints_not_from_speech": ((F.col("target_field") == "time_hints") & (source != "asr"), source),
        "regions_into_text_reader": ((tool == "ocr") & (source == "spatial_grounder"), at),
        "evidence_ids_by_reference": (target == "evidence_ids", at),
        # A field of parts or hints takes only paths that lead to such parts.
        "path_of_other_parts": (~F.array_contains(_listed(PART_PATHS, target), path) & ~F.array_contains(_listed(PART_PATHS, target), general), bound),
        "no_text_output": ((target == "text_contexts") & ~path.isin(TEXT_OUTPUTS), path),
        "speech_not_as_transcripts": ((tool == "generic_purpose") & (source == "asr") & ((target == "text_contexts") | ((target == "transcripts") & (path != "transcripts"))), bound),
    }
    fields = wired.groupBy(*key).agg(F.collect_set("target_field").alias("_bound"))
    literal = steps.select(*key, F.explode("literals").alias("f")).groupBy(*key).agg(F.collect_set("f").alias("_literal"))
    fed = counts.join(fields, key, "left").join(literal, key, "left")
    none = F.array().cast("array<string>")
    given = F.array_union(F.coalesce("_bound", none), F.coalesce("_literal", none))
    of_steps = {
        "duplicate_step_id": (F.col("_n") > 1, F.col("_n")),
        # A general step takes whatever an earlier step hands it; the other tools need one of their own fields.
        "missing_context": (~F.arrays_overlap(_listed(NEEDS_ONE_OF, tool), given) & ~((tool == "generic_purpose") & F.col("_bound").isNotNull()), tool),
    }
    out = _violations(wired, of_refs).unionByName(_violations(fed, of_steps))
    if cited is not None and retrieved is not None:
        lost = cited.filter(strip(F.col("evidence_id")) != "").join(retrieved.select("plan_id", "evidence_id").distinct(), ["plan_id", "evidence_id"], "left_anti")
        out = out.unionByName(lost.select(*key, F.lit("evidence_not_retrieved").alias("rule"), F.col("evidence_id").alias("detail")))
    if conditioned is not None:
        seen = wired.filter((target == "clips") & (source == "visual_temporal_grounder")).select(*key).distinct()
        heard = counts.filter(tool == "audio_temporal_grounder").join(conditioned.select("plan_id").distinct(), "plan_id", "left_semi")
        out = out.unionByName(heard.join(seen, key, "left_anti").select(*key, F.lit("sound_before_sight").alias("rule"), F.col("tool_name").alias("detail")))
    return out.distinct()


#: Level of steps in or behind a cycle while levels are searched.
ENDLESS = 1 << 40


def _jumped(reach: DataFrame, limit: int) -> DataFrame:
    """Every step's pointer moved on by its target's pointer, twice; a way longer than any plan has steps goes round a cycle.

    Steps that point nowhere stay as they are, and both moves meet the same targets, dealt once.
    """
    ahead = reach.select("plan_id", F.col("step_id").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
    moved = reach.filter("up IS NOT NULL")
    level = F.col("level") + F.coalesce("_level", F.lit(0))
    for _ in range(2):
        moved = moved.join(ahead, ["plan_id", "up"], "left").withColumns({"level": F.when(level > limit, ENDLESS).otherwise(level), "up": F.when(level <= limit, F.col("_up"))})
        moved = moved.select("plan_id", "step_id", "up", "level")
    return reach.filter("up IS NULL").unionByName(moved)


def plan_levels(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependency level of every step (0 = needs nothing); steps in or behind a cycle get no level.

    ``edges``(plan_id, step_id, source_step_id); sources outside the plan do not count. Every step follows one source;
    the length of that way comes by pointer jumping, and every written table holds ways three times as long as the one before. Steps that another source would put deeper then follow that one, and only their plans are gone over again,
    until no step gets deeper. Ways that go round a cycle count as endless, and so does all that can follow them.
    """
    key = ["plan_id", "step_id"]
    nodes = materialize(steps.select(*key).distinct(), "steps")
    limit = nodes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("size")).agg(F.max("size")).first()[0] or 0
    inside = nodes.select("plan_id", F.col("step_id").alias("source_step_id"))
    wires = materialize(edges.select(*key, "source_step_id").distinct().join(inside, ["plan_id", "source_step_id"], "left_semi"), "edges")
    follows = wires.groupBy(*key).agg(F.max("source_step_id").alias("up"))
    settled, live = [], nodes
    while True:
        reach = live.join(follows.select(*key, "up"), key, "left").withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"))
        reach = materialize(reach.select(*key, "up", "level"), "levels")
        while reach.filter("up IS NOT NULL").limit(1).count():
            reach = materialize(_jumped(reach, limit), "levels")
        level = reach.select("plan_id", F.col("step_id").alias("source_step_id"), F.least(F.col("level") + 1, F.lit(ENDLESS)).alias("_deep"))
        best = wires.join(level, ["plan_id", "source_step_id"]).groupBy(*key).agg(F.max("_deep").alias("_deep"), F.max_by("source_step_id", "_deep").alias("_best"))
        follows = best.join(reach, key).select(*key, F.col("_best").alias("up"), (F.col("_deep") > F.col("level")).alias("deeper"))
        follows = materialize(follows, "sources")
        open_plans = follows.filter("deeper").select("plan_id").distinct()
        if not open_plans.limit(1).count():
            settled.append(reach)
            break
        settled.append(reach.join(open_plans, "plan_id", "left_anti"))
        live, follows = live.join(open_plans, "plan_id", "left_semi"), follows.join(open_plans, "plan_id", "left_semi")
        wires = materialize(wires.join(open_plans, "plan_id", "left_semi"), "edges")
    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    endless = F.col("level") >= ENDLESS
    return out.select(*key, F.when(~endless, F.col("level").cast("int")).alias("level"), endless.alias("in_cycle"))
