"""Rows that real ledgers hold and easy bindings leave out, as literals."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sightline.functions import jsons, text, timing
from sightline.operators import ledger, lookups, models, ranking, runs, transcripts
from sightline.plans import checks

OBS = "evidence_key string, predicate string, seq long, start_ms long, end_ms long, frame_ms long"


def test_digest_shows_frames_and_open_ends(spark):
    rows = [("e", "frame fact", 1, None, None, 2500), ("e", "from", 2, 1000, None, None), ("e", "until", 3, None, 3000, None), ("e", "both", 4, 1000, 2000, 7), ("e", "bare", 5, None, None, None)]
    got = ledger.evidence_digest(spark.createDataFrame(rows, OBS), "evidence_key", "predicate").first()["digest"]
    assert got.split("\n") == ["[frame 2.50s] frame fact", "[1.00s] from", "[3.00s] until", "[1.00-2.00s] both", "bare"]


def test_evidence_keeps_frame_times_and_long_ids(spark):
    results = spark.createDataFrame(
        [("a", 100, "ocr", "0123456789", True, "s"), ("b", 7, "ocr", "fedcba9876", False, "x" * 3000), ("c", 8, "ocr", "fedcba9876", True, " y " * 1500)],
        "evidence_key string, step_id long, tool_name string, request_hash string, ok boolean, summary string",
    )
    got = {r["evidence_key"]: r for r in runs.build_evidence(results, spark.createDataFrame([("a", "p", 1, None, None, 2500)], OBS)).collect()}
    assert (got["a"]["evidence_id"], got["a"]["frame_ms"], got["a"]["start_ms"]) == ("ev_100_01234567", 2500, None)
    assert got["b"]["evidence_id"] == "ev_07_fedcba98" and len(got["b"]["evidence_text"]) == 2000
    assert len(got["c"]["evidence_text"]) == 2000 and got["c"]["evidence_text"].startswith("y")


def path(spark, doc, field):
    return spark.range(1).select(jsons.json_path(F.parse_json(F.lit(json.dumps(doc))), field)).first()[0]


def test_json_paths(spark):
    doc = {"none": None, "a": [{"b": [1, 2, None]}, {"b": []}, {"c": 1}, {"b": [3]}], "regions": [{"id": None}, {"label": "", "name": "Spare", "id": 5}, {"id": 6}]}
    assert path(spark, doc, "none") is None
    assert path(spark, doc, "a[].b[]") == "[[1,2],[3]]"
    assert path(spark, doc, "regions[].id") == "[5,6]"
    assert path(spark, doc, "regions.spare.id") == "5"
    assert path(spark, doc, "regions[].nothing") is None


def test_json_null_is_unresolved(spark):
    refs = spark.createDataFrame([("p", 2, "f", 1, "x"), ("p", 2, "g", 1, "y"), ("p", 2, "h", 9, "y")], "plan_id string, step_id long, target_field string, source_step_id long, field_path string")
    outputs = spark.createDataFrame([("p", 1, 1, '{"x": null, "y": [0]}')], "plan_id string, step_id long, seq long, output string")
    got = {r["target_field"]: (r["value"], r["error"]) for r in lookups.resolved_refs(refs, outputs).collect()}
    assert got == {"f": (None, "unresolved_dependency"), "g": ("[0]", None), "h": (None, "unresolved_dependency")}


def test_led_time_goes_first(spark):
    texts = ["wait 3s then look at 5 seconds", "3s", "at 1:05 or 3s", "nothing"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(timing.parse_timecode(F.col("t"))).collect()
    assert [r[0] for r in rows] == [5.0, 3.0, 65.0, None]


def test_general_step_takes_any_bound_input(spark):
    steps = spark.createDataFrame([("p", 1, 1, "asr", ["clips"]), ("p", 2, 2, "generic_purpose", ["query"]), ("p", 3, 3, "generic_purpose", ["query"])], "plan_id string, step_id long, pos long, tool_name string, literals array<string>")
    refs = spark.createDataFrame([("p", 2, "query", 1, "clips")], "plan_id string, step_id long, target_field string, source_step_id long, field_path string")
    assert [(r["step_id"], r["rule"]) for r in checks.plan_lint(steps, refs).collect()] == [(3, "missing_context")]


def test_levels_of_a_long_chain(spark):
    n = 24
    steps = spark.createDataFrame([("p", i) for i in range(n)] + [("q", 1), ("q", 2)], "plan_id string, step_id long")
    edges = spark.createDataFrame([("p", i + 1, i) for i in range(n - 1)] + [("q", 1, 2), ("q", 2, 1)], "plan_id string, step_id long, source_step_id long")
    got = {(r["plan_id"], r["step_id"]): (r["level"], r["in_cycle"]) for r in checks.plan_levels(steps, edges).collect()}
    assert got == {("p", i): (i, False) for i in range(n)} | {("q", 1): (None, True), ("q", 2): (None, True)}


def test_absence_belongs_to_the_request(spark):
    groups = spark.createDataFrame([("r", 0, "a", ["c"]), ("r", 1, " ", []), ("r", 2, "b", []), ("s", 0, "", [])], "request_id string, idx long, text string, clips array<string>")
    got = {(r["request_id"], r["part"]): (r["text"], r["query_absent"]) for r in runs.merge_group_outputs(groups, 2).collect()}
    assert got == {("r", 0): ("a", False), ("r", 1): ("b", False), ("s", 0): ("", True)}


def test_one_rule_for_transcript_ids(spark):
    rows = [("t", i, i * 10, i * 10 + 5, "s", f"w{i}") for i in range(3)]
    segments = spark.createDataFrame(rows, "transcript_id string, seg_idx long, start_ms long, end_ms long, speaker_id string, text string")
    one, two = (transcripts.transcript_ids(segments.filter(F.col("seg_idx") < n), 2).first() for n in (2, 3))
    assert one["tx"] != two["tx"] and (one["n_segments"], two["n_segments"]) == (2, 3)


def test_intervals_in_prose_and_fences(spark):
    texts = ['```json\n{"intervals":[{"start":1,"end":2}]}\n```', "see [[1, 2]] there", "from 1 to 2", '{"intervals": []}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(jsons.text_intervals(F.col("t"), F.lit(0.0)).alias("i")).collect()
    assert [[tuple(i) for i in r["i"]] for r in rows] == [[(1.0, 2.0)]] * 3 + [[]]


def test_equal_objects_print_alike(spark):
    rows = spark.createDataFrame([(1, '{"s": 1.0}'), (2, 'so {"s": 1.0} it is')], "id long, raw string")
    assert {r["object"] for r in models.salvage_json(rows, "id", "raw").collect()} == {'{"s":1}'}


def test_path_keys_are_dropped_at_any_depth(spark):
    doc = {"path": "x", "a": [{"video_path": 1, "note": "see /srv/app/run/1 and /data/x"}, "/data"], "keep": None}
    got = spark.createDataFrame([(json.dumps(doc),), ("no json",)], "c string").select(text.redact_record(F.col("c"), "/srv/app")).collect()
    assert json.loads(got[0][0]) == {"a": [{"note": "see run/1 and <redacted-path>"}, "<redacted-path>"], "keep": None} and got[1][0] is None


def test_anchors_share_one_list(spark):
    frames = spark.createDataFrame([("v", i, t * 1000, s) for i, (t, s) in enumerate([(4, 1), (5, 9), (6, 2), (7, 3), (8, 8), (40, 1)])], "video_id string, seq long, t_ms long, score_u long")
    got = ranking.anchor_window_select(frames, "video_id", [6000, 7000], 3, 2000).collect()
    assert [(r["seq"], r["role"], r["anchor_ms"]) for r in got] == [(0, "before", 6000), (1, "before", 6000), (2, "anchor", 6000), (3, "after", 6000), (4, "after", 6000)]
    got = ranking.anchor_window_select(frames, "video_id", [6000, 40_000], 1, 2000, neighbours=False).collect()
    assert [(r["seq"], r["role"]) for r in got] == [(2, "anchor"), (5, "anchor")]


def test_equal_times_are_ranked_by_number(spark):
    from sightline.operators.core import rank_rows

    rows = spark.createDataFrame([("v", i, 5, 7) for i in (3, 1, 2)], "k string, seq long, d long, t long")
    got = {r["seq"]: r["rank"] for r in rank_rows(rows, ["k"], "d", "t", 100, last=["seq"]).collect()}
    assert got == {1: 1, 2: 2, 3: 3}
