"""Literal rows for rules that the bound tables only touch lightly: stamps, anchors, sample counts, objects inside prose."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sightline.functions import jsons, timing
from sightline.operators import transcripts
from sightline.plans import checks


@pytest.mark.parametrize(
    "stamp, span",
    [
        ("3s - 5s", (13_000, 15_000)), ("3 to 5.5 seconds", (13_000, 15_500)), ("2s until 4s", (12_000, 14_000)), ("0:03-0:05", (13_000, 15_000)), ("0:00:12 through 0:00:14.5", (12_000, 14_500)),
        ("0:04", (14_000, 30_000)), ("4s", (14_000, 30_000)), ("12s - 14s", (12_000, 14_000)), ("soon", (10_000, 30_000)), (" ", (10_000, 30_000)), ("9s - 2s", (19_000, 19_000)),
    ],
)
def test_stamps(spark, stamp, span):
    """In a clip from 10 to 30 s: times that fit its length and not the clip itself count from its start."""
    for name in ("timestamp", "time"):
        raw = spark.createDataFrame([(1, stamp)], f"id long, {name} string")
        row = transcripts.caption_spans(raw, F.lit(10_000).cast("long"), F.lit(30_000).cast("long")).first()
        assert (row["start_ms"], row["end_ms"]) == span


def test_names_of_caption_fields(spark):
    raw = spark.createDataFrame(
        [(1, None, "shown", "told", ["A"], ["a", "B"], ["cup"], "15", "bad"), (2, "--", None, "told", None, ["x"], None, None, "7")],
        "id long, visual string, caption string, description string, screen_text array<string>, text_overlay array<string>, props array<string>, start string, end string",
    )
    got = transcripts.caption_spans(raw, F.lit(10_000).cast("long"), F.lit(30_000).cast("long")).orderBy("id").collect()
    assert [(r["visual"], r["on_screen_text"], r["objects"], r["start_ms"], r["end_ms"]) for r in got] == [("shown", "A | B", ["cup"], 15_000, 20_000), ("told", "x", [], 10_000, 17_000)]


def test_anchor_times(spark):
    rows = [(5.0, "1:00", "video", 5.0), (None, "1:00", None, 60.0), (None, "at 1:05", "CLIP", 165.0), (3.0, None, "scope", 103.0), (None, None, "clip", None), (None, "none", "", None)]
    df = spark.createDataFrame(rows, "t double, code string, ref string, want double").withColumn("start", F.lit(100.0))
    for r in df.withColumn("got", timing.anchor_time(F.col("t"), F.col("code"), F.col("ref"), F.col("start"))).collect():
        assert r["got"] == r["want"]
    radii = spark.createDataFrame([(0.0, 9.0, 0.0), (None, 9.0, 9.0), (None, 0.0, 2.0), (None, None, 2.0)], "own double, scope double, want double")
    assert all(r["got"] == r["want"] for r in radii.withColumn("got", timing.anchor_radius(F.col("own"), F.col("scope"))).collect())


def test_sample_counts(spark):
    rows = [(0.0, 1.0, 2), (0.0, 1.01, 3), (0.0, 0.1, 1), (5.0, 5.0, 1), (5.0, 1.0, 1), (3.0, None, 1), (0.0, 10.0, 20)]
    df = spark.createDataFrame(rows, "a double, b double, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", timing.clip_sample_count(F.col("a"), F.col("b"), F.lit(2.0))).collect())


def test_objects_inside_prose(spark):
    deep = {"a": {"b": {"c": {"d": 1}}}, "intervals": [{"start": 1, "end": 2}]}
    texts = {
        'so {x} it is {"clips": [[3, 4]]} and {y: 1}': [(3.0, 4.0)],
        f"{{note}} {json.dumps(deep)} {{}}": [(1.0, 2.0)],
        '{"clips": [[3, 4]]} {"clips": [[5, 6]]}': [(3.0, 4.0)],
        "{ no object 7 - 8 {": [(7.0, 8.0)],
        "x" * 200_000 + '{{"clips": [[3, 4]]}': [(3.0, 4.0)],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", jsons.text_intervals(F.col("t"), F.lit(0.0)).alias("i")).collect()
    assert {r["t"]: [tuple(i) for i in r["i"]] for r in rows} == texts


def test_plan_rules(spark):
    tools = ["asr", "visual_temporal_grounder", "frame_retriever", "generic_purpose", "audio_temporal_grounder", "ocr"]
    steps = spark.createDataFrame([("p", i, i, t, ["clips", "frames"]) for i, t in enumerate(tools, 1)], "plan_id string, step_id long, pos long, tool_name string, literals array<string>")
    refs = [
        (3, "clips", 2, "clips[3]", None), (3, "clips", 2, "clips.id", "path_of_other_parts"), (3, "time_hints", 1, "phrase_matches.0.time_hint", None), (3, "time_hints", 1, "transcripts", "path_of_other_parts"),
        (4, "transcripts", 1, "transcripts", None), (4, "transcripts", 1, "transcripts[]", "speech_not_as_transcripts"), (4, "frames", 3, "frames.2", None), (4, "text_contexts", 2, "summary", None),
        (4, "text_contexts", 2, "clips", "no_text_output"), (6, "evidence_ids", 4, "answer", "evidence_ids_by_reference"),
    ]
    df = spark.createDataFrame([("p", s, t, src, path) for s, t, src, path, _ in refs], "plan_id string, step_id long, target_field string, source_step_id long, field_path string")
    cited = spark.createDataFrame([("p", 4, "e1"), ("p", 4, "e2"), ("p", 4, " ")], "plan_id string, step_id long, evidence_id string")
    retrieved = spark.createDataFrame([("p", "e1"), ("q", "e2")], "plan_id string, evidence_id string")
    conditioned = spark.createDataFrame([("p",)], "plan_id string")
    got = sorted((r["step_id"], r["rule"]) for r in checks.plan_lint(steps, df, cited, retrieved, conditioned).collect())
    assert got == sorted([(s, rule) for s, _, _, _, rule in refs if rule] + [(4, "evidence_not_retrieved"), (5, "sound_before_sight")])
    seen = df.union(spark.createDataFrame([("p", 5, "clips", 2, "clips")], df.schema))
    assert "sound_before_sight" not in {r["rule"] for r in checks.plan_lint(steps, seen, conditioned=conditioned).collect()}
