"""Run folder trees: filters reach the listing, listings open no file, files of any size are fingerprinted by their ends."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sightline.sources import folders, readers


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("runs"))
    rows = []
    for video in ("v1", "v 2"):
        for run in range(3):
            for k in (1, 2, 10):
                at = f"{video}/run_{run}/round_{k:02d}"
                rows += [(f"{at}/planner_plan.json", json.dumps({"strategy": f"s{k}", "steps": []})), (f"{at}/notes.txt", "é")]
                rows += [(f"{at}/tools/{t}/result.json", json.dumps({"tool_name": t[3:], "ok": True})) for t in ("01_ocr", "_tmp", "02_asr")]
            rows += [(f"{video}/run_{run}/run_manifest.json", "{}"), (f"{video}/run_{run}/round_x/planner_plan.json", "{}"), (f"{video}/run_{run}/evidence/a.jsonl", "{}")]
    folders.write_tree(spark.createDataFrame(rows, "path string, content string"), root)
    return root


def lowest_filters(df):
    """What the filter right above the scan of run folders says."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "BatchScan run_folders" in line)
    return lines[at - 1]


def test_every_file_of_rounds_and_tools(spark, tree):
    rows = folders.run_folders(spark, tree).collect()
    want = {os.path.relpath(os.path.join(d, f), tree) for d, _, names in os.walk(tree) for f in names if "/round_" in d and "round_x" not in d}
    assert {f"{r.run}/{r.relpath}" for r in rows} == want and len(rows) == len(want)
    assert {r.path for r in rows} == {os.path.join(tree, p) for p in want}
    assert all(r.length == len(r.content.encode()) for r in rows)
    assert {r.round for r in rows} == {1, 2, 10} and {r.tool for r in rows} == {None, "01_ocr", "02_asr", "_tmp"}


def test_filters_stand_in_front_of_the_listing(spark, tree):
    files = folders.run_folders(spark, tree)
    one = files.filter((F.col("run") == "v1/run_1") & (F.col("round") > 1) & (F.col("name") == "planner_plan.json"))
    assert sorted(r.round for r in one.collect()) == [2, 10]
    assert "Filter" in lowest_filters(one) and "v1/run_1" in lowest_filters(one)
    rounds = readers.run_rounds(files).filter("run = 'v 2/run_0' AND round = 10")
    assert [(r.run, r.round, r.strategy, r.planner_plan_path if "planner_plan_path" in rounds.columns else r.plan_path) for r in rounds.collect()] == [("v 2/run_0", 10, "s10", "round_10/planner_plan.json")]
    assert "v 2/run_0" in lowest_filters(rounds)
    # One listing may be used with other filters, or none, beside it.
    assert files.filter("run = 'v1/run_1'").union(files.filter("tool = '_tmp'")).count() == 15 + 18
    assert files.count() == 6 * 15


def test_listing_opens_no_file(spark, tmp_path):
    """A file that cannot be opened is listed all the same, and fails only where its content is asked for."""
    folder = tmp_path / "v" / "r" / "round_01"
    folder.mkdir(parents=True)
    (folder / "bad.json").write_bytes(b"\xff\xfe")
    files = folders.run_folders(spark, str(tmp_path))
    assert [(r.name, r.length) for r in files.drop("content").collect()] == [("bad.json", 2)]
    assert files.filter("name = 'other.json'").collect() == []
    with pytest.raises(Exception, match="(?i)decode"):
        files.collect()


def test_partitions_hold_few_folders(spark, tree):
    assert folders.run_folders(spark, tree, folders=1).rdd.getNumPartitions() == 6
    assert folders.run_folders(spark, tree, folders=4).rdd.getNumPartitions() == 2
    assert folders.run_folders(spark, tree + "/none").collect() == []


def test_tool_steps_skip_private_folders(spark, tree):
    steps = readers.tool_steps(folders.run_folders(spark, tree)).filter("round = 2").collect()
    assert sorted((r.run, r.tool_dir, r.tool_name) for r in steps if r.run == "v1/run_0") == [("v1/run_0", "01_ocr", "ocr"), ("v1/run_0", "02_asr", "asr")]


def test_written_again_changes_nothing(spark, tree):
    before = folders.run_folders(spark, tree).count()
    folders.write_tree(spark.createDataFrame([("v1/run_0/round_01/notes.txt", "é")], "path string, content string"), tree)
    assert folders.run_folders(spark, tree).count() == before


@pytest.mark.parametrize("size", [1, 5, 10, 11, 19, 20, 21, 300])
def test_ends_of_files(spark, tmp_path, size):
    data = bytes(range(256))[:size] * 2
    (tmp_path / "f.bin").write_bytes(data)
    edge = 10
    tail = data[-edge:] if len(data) > 2 * edge else data[edge:]
    want = hashlib.sha256(str(len(data)).encode() + data[:edge] + tail).hexdigest()
    row = readers.file_fingerprints(spark, str(tmp_path), edge).first()
    held = spark.createDataFrame([(data,)], "b binary").select(readers.fingerprint(F.col("b"), edge).alias("f")).first()
    assert row.fingerprint == want == held.f and row.length == len(data)
