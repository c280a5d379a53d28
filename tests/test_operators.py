"""Selection, ledger, transcripts, plans, files and model surface on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import filters, ledger, lookups, models, observe, ranking, runs
from sightline.operators.intervals import SLAB_MS
from sightline.plans import checks
from sightline.sources import readers


def frames(spark, times, score=0):
    data = [("v", i, int(t * 1000), score) for i, t in enumerate(times)]
    return spark.createDataFrame(data, "video_id string, seq long, t_ms long, score_u long")


def picked(df):
    return [r.t_ms // 1000 for r in sorted(df.collect(), key=lambda r: r.t_ms)]


def test_anchor_window(spark):
    out = ranking.anchor_window_select(frames(spark, [4, 5, 6, 7, 8]), "video_id", [6000], 3, 2000)
    assert picked(out) == [4, 5, 6, 7, 8]
    assert {r.role for r in out.collect() if r.t_ms == 6000} == {"anchor"}
    out = ranking.anchor_window_select(frames(spark, [127, 129, 131]), "video_id", [129_000], 3, 2000)
    assert picked(out) == [127, 129, 131]
    assert picked(ranking.anchor_window_select(frames(spark, [3, 1, 2]), "video_id", [], 1, 0)) == [1, 2, 3]


def test_diverse_pick_equals_walk(spark):
    rows = [(i, (i * 37) % 90 * 100, (i * 53) % 101) for i in range(60)]
    df = spark.createDataFrame([("v", i, t, s, None) for i, t, s in rows], "video_id string, seq long, t_ms long, temporal_u long, distance_ms long")
    got = [r.seq for r in sorted(ranking.diverse_topk(df, "video_id", 5, 1000).collect(), key=lambda r: r.pick)]
    walk, ordered = [], sorted(rows, key=lambda r: (-r[2], r[1], r[0]))
    for r in ordered:
        if len(walk) < 5 and all(abs(r[1] - w[1]) >= 1000 for w in walk):
            walk.append(r)
    assert got == [w[0] for w in walk]
    crowd = spark.createDataFrame([("v", i, 5, 10 - i, None) for i in range(6)], df.schema)
    got = [r.seq for r in sorted(ranking.diverse_topk(crowd, "video_id", 3, 1000).collect(), key=lambda r: r.pick)]
    assert got == [0, 1, 2]


def test_tree_top_keeps_the_best(spark):
    df = spark.range(5000).select(F.lit("v").alias("k"), F.floor(F.col("id") * SLAB_MS / 3).alias("t"), (F.col("id") * 7919 % 5003).alias("s"))
    got = {r.s for r in ranking.tree_top(df, ["k"], [F.desc("s")], 10, "t").collect()}
    assert got == {r.s for r in df.orderBy(F.desc("s")).limit(10).collect()}


def test_keyword_search_counts_values_only(spark):
    df = spark.createDataFrame([(1, "speaker_1", "hello"), (2, "user", "subject matter"), (3, "x", "y")], "seq long, subject string, body string")
    assert [r.seq for r in ranking.keyword_topk(df, ["subject", "body"], ["Hello"], 5, "seq").collect()] == [1]
    assert [r.seq for r in ranking.keyword_topk(df, ["subject", "body"], ["subject"], 5, "seq").collect()] == [2]
    assert len(ranking.keyword_topk(df, ["subject", "body"], ["subject"], 5, "seq", compat=True).collect()) == 3


def test_select_out_of_range(spark):
    with pytest.raises(IndexError):
        ranking.select_rows(spark.range(3), "id", index=3)


def test_legacy_status(spark):
    df = spark.createDataFrame([("provisional",), ("",), ("Stale",), ("odd",)], "status string")
    kept, rejected = ledger.check_status(df)
    assert sorted(r.status for r in kept.collect()) == ["candidate", "stale"]
    assert sorted(r.status for r in rejected.collect()) == ["odd", "provisional"]
    assert df.select(ledger.clean_status(F.col("status"))).first()[0] == "candidate"


def test_low_confidence_zero_counts(spark):
    df = spark.createDataFrame([("g", "0.5"), ("g", "x"), ("g", "1"), ("h", None)], "g string, c string")
    got = ledger.confidence_stats(df, ["g"], F.col("c")).collect()
    assert [(r.g, r.confidence, r.confidence_avg, r.confidence_count) for r in got] == [("g", 1.0, 0.75, 2)]


def test_observed_sentences(spark):
    seg = spark.createDataFrame(
        [(1, "speaker_1", "Hello there. The score is 10.", 1000, 2500, None, ["t"])],
        "id int, speaker_id string, text string, start_ms long, end_ms long, confidence double, refs array<string>",
    )
    got = observe.from_transcripts(seg, ["id"]).collect()
    assert sorted(r.object_text for r in got) == ["Hello there.", "The score is 10."]
    assert {r.predicate for r in got} == {"said"}


def test_phrase_match(spark):
    seg = spark.createDataFrame(
        [("t", 0, 10_000, 10_800, "Come to Bill's"), ("t", 1, 10_800, 11_600, "ammunition now.")],
        "transcript_id string, seg_idx long, start_ms long, end_ms long, text string",
    )
    asked = spark.createDataFrame([("t", "When do they say 'come to bill's ammunition'?")], "transcript_id string, question string")
    got = lookups.phrase_matches(asked, seg).first()
    assert (got.matched_text, got.start_s, got.end_s, got.time_hint) == ("Come to Bill's ammunition now.", 10.0, 11.6, "10.800s")


def test_feedback_defaults(spark):
    finding = F.struct(F.lit("").alias("severity"), F.lit("x").alias("category"), F.lit("m").alias("message"), F.array(F.lit("b"), F.lit("a")).alias("evidence_ids"))
    got = spark.range(1).select(filters.audit_feedback(F.lit("pass"), F.array(finding), F.array(F.lit("w"), F.lit("w"))).alias("f")).first().f
    assert (got.verdict, got.findings[0].severity, got.findings[0].evidence_ids, got.missing_information) == ("PASS", "MEDIUM", ["a", "b"], ["w"])


def test_salvage(spark):
    raws = ['[{"a": 1}, {"a": 2}, {"a": 3}, {"a', '<think>{"x": 1}</think>{"y": {"z": 2}}']
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    items = models.salvage_json(df.filter("id = 0"), "id", "raw", items=True).collect()
    assert [r.object for r in sorted(items, key=lambda r: r.pos)] == ['{"a":1}', '{"a":2}', '{"a":3}']
    objects = models.salvage_json(df.filter("id = 1"), "id", "raw").collect()
    assert [r.object for r in sorted(objects, key=lambda r: r.pos)][0] == '{"y":{"z":2}}'


def test_plan_rules_and_levels(spark):
    steps = spark.createDataFrame(
        [("p", 1, 1, "asr", ["clips"]), ("p", 2, 2, "frame_retriever", ["query"]), ("p", 3, 3, "ocr", ["query"])],
        "plan_id string, step_id long, pos long, tool_name string, literals array<string>",
    )
    refs = spark.createDataFrame(
        [("p", 2, "time_hints", 1, "phrase_matches[].time_hint"), ("p", 3, "frames", 2, "clips"), ("p", 3, "frames", 9, "frames")],
        "plan_id string, step_id long, target_field string, source_step_id long, field_path string",
    )
    got = {(r.step_id, r.rule) for r in checks.plan_lint(steps, refs).collect()}
    assert got == {(3, "path_not_emitted"), (3, "missing_source"), (3, "path_of_other_parts")}
    levels = {r.step_id: r.level for r in checks.plan_levels(steps, refs.select("plan_id", "step_id", "source_step_id")).collect()}
    assert levels == {1: 0, 2: 1, 3: 2}
    loop = spark.createDataFrame([("p", 1, 2), ("p", 2, 1)], "plan_id string, step_id long, source_step_id long")
    assert {r.step_id for r in checks.plan_levels(steps, loop).filter("in_cycle").collect()} == {1, 2}


def test_run_folder(spark, tmp_path):
    tool = tmp_path / "video_6" / "run_1" / "round_01" / "tools" / "01_ocr"
    tool.mkdir(parents=True)
    (tool / "result.json").write_text(json.dumps({"tool_name": "ocr", "ok": True}, indent=2))
    (tool / "timing.json").write_text(json.dumps({"duration_s": 1.5}))
    (tool / "observations.json").write_text(json.dumps([{"a": 1}]))
    (tool.parents[1] / "planner_plan.json").write_text(json.dumps({"strategy": " s ", "steps": [{"step_id": 1, "tool_name": "ocr"}]}))
    rounds = readers.run_rounds(readers.documents(spark, f"{tmp_path}/*/*/round_*/*.json")).collect()
    assert [(r.run, r.round, r.strategy, r.step_count, r.verdict) for r in rounds] == [("video_6/run_1", 1, "s", 1, "")]
    steps = readers.tool_steps(readers.documents(spark, f"{tmp_path}/*/*/round_*/tools/*/*.json")).collect()
    assert [(r.tool_name, r.duration_s, r.observation_count) for r in steps] == [("ocr", 1.5, 1)]


def test_missing_log_is_empty_and_broken_line_fails(spark, tmp_path):
    assert readers.scan_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.scan_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_listing_and_fingerprints(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "frame_2.50.png").write_bytes(b"abc")
    (tmp_path / "v" / "frame_10.00.png").write_bytes(b"abc")
    files = readers.listing(spark, f"{tmp_path}/v")
    assert [r.timestamp_s for r in readers.dense_frames(files).collect()] == [2.5, 10.0]
    assert {r.media_type for r in readers.artifact_manifest(files, "frame").collect()} == {"image"}
    assert len({r.fingerprint for r in readers.file_fingerprints(spark, f"{tmp_path}/v").collect()}) == 1


def test_fanout_and_failures(spark):
    df = spark.createDataFrame([(1, ["r"], ["f"], None, None), (2, None, None, [], None)], "request_id int, regions array<string>, frames array<string>, clips array<string>, time_hints array<string>")
    got = {(r.request_id, r.field, r.item) for r in runs.fanout_requests(df).collect()}
    assert got == {(1, "region", "r"), (2, "request", None)}
