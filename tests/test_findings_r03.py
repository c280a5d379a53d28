"""Rows that went wrong and plans that did not hold, one test per finding of the third round."""

from pyspark.sql import functions as F

from sightline.catalog import load_all
from sightline.catalog.registry import QUERIES
from sightline.functions import jsons
from sightline.operators import intervals as I
from sightline.operators import lookups, models
from sightline.plans import checks
from sightline.sources import folders, readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlap_never_broadcasts_rows_spread_over_levels(spark):
    windows = spark.range(20).selectExpr("id % 2 AS k", "id * 100 AS start_ms", "id * 100 + 50 AS end_ms")
    got = I.overlap_max(windows, windows.withColumn("score", F.col("start_ms")), ["k"], "score")
    assert not [line for line in plan(got).splitlines() if "BroadcastHashJoin" in line and "level" in line]
    assert got.count() == 20


def test_leading_number_of_prose_is_not_the_answer(spark):
    objects = '{"clips": [{"start": 1, "end": 2}, {"start_s": 3, "end_s": 4}]}'
    texts = [f"27 steps\n```json\n{objects}\n``` 7 - 8", "12 so [[1, 2], [3, 4], [null, 1]] is it", f"[1] see {objects}", f'"a" {{x: {{y}}}} {objects} {{end}}', "5 or 7 - 8"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", jsons.text_intervals(F.col("t"), F.lit(0.0)).alias("x")).orderBy("i").collect()
    assert [[tuple(p) for p in r["x"]] for r in rows] == [[(1.0, 2.0), (3.0, 4.0)]] * 4 + [[(7.0, 8.0)]]


def test_references_are_resolved_once(spark):
    refs = spark.range(1, 40).selectExpr("id % 3 AS plan_id", "id AS step_id", "'scope' AS target_field", "id % 5 AS pos", "id - 3 AS source_step_id", "'a' AS field_path")
    outputs = refs.selectExpr("plan_id", "step_id", "pos AS seq", "'{\"a\": 1}' AS output")
    inputs = refs.selectExpr("plan_id", "step_id", "target_field", "'2' AS value")
    got = lookups.merged_refs(refs, outputs, inputs)
    # The join of references with outputs is the only one, and nothing that follows reads its rows again.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {(r["value"], r["error"]) for r in got.collect()} == {("1", None), (None, "unresolved_dependency: a")}


def test_every_step_of_a_run_is_in_its_result(spark, tmp_path):
    load_all()
    orders = spark.range(2).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus")
    lines = spark.range(2500).selectExpr(
        "0L AS l_orderkey", "int(id) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "concat('t', id, '_') AS l_returnflag", "'O' AS l_linestatus"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = QUERIES["final_result_rollup"](spark, str(tmp_path)).orderBy("run_id", "part").collect()
    assert ",".join(r["tools"] for r in rows if r["run_id"] == 0) == ",".join(f"t{i}_O" for i in range(2500))
    assert [r["n_steps"] for r in rows] == [1000, 1000, 500, 0]


def test_partitions_of_run_folders_go_by_cores(spark, tmp_path):
    for i in range(600):
        (tmp_path / "v" / f"run_{i}" / "round_01").mkdir(parents=True)
    (tmp_path / "v" / "run_9" / "round_01" / "planner_plan.json").write_text("{}")
    files = folders.run_folders(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= folders.WAVES * spark.sparkContext.defaultParallelism
    assert [r["run"] for r in files.collect()] == ["v/run_9"]


def test_fingerprints_take_few_tasks_however_many_files(spark, tmp_path):
    for i in range(1200):
        (tmp_path / f"{i}.txt").write_text("x" * (i + 1))
    prints = readers.file_fingerprints(spark, str(tmp_path), 10)
    assert prints.rdd.getNumPartitions() <= folders.WAVES * spark.sparkContext.defaultParallelism
    assert prints.select("fingerprint").distinct().count() == 1200


def test_atomizer_sees_a_batch_in_slices(spark):
    import pyarrow as pa

    texts = [f"word{'' if i % 2 else i} is said" if i % 7 else None for i in range(450)]
    seen = {}

    real, F.arrow_udf = F.arrow_udf, lambda kind: lambda run: seen.setdefault("run", run) and real(kind)(run)
    try:
        models.atomize(spark.range(1).selectExpr("id", "'a' AS t"), ["id"], "t", lambda body: [{"atomic_text": body}])
    finally:
        F.arrow_udf = real
    parts = list(seen["run"](iter([pa.array(texts)])))
    assert [len(p) for p in parts] == [200, 200, 50]
    assert [f["atomic_text"] for p in parts for x in p.to_pylist() for f in x] == [t for t in texts if t]


def test_levels_deal_targets_once_for_two_jumps(spark):
    reach = spark.range(1000).selectExpr("0L AS plan_id", "id AS step_id", "nullif(id, 0L) - 1 AS up", "if(id = 0, 0L, 1L) AS level")
    got = checks._jumped(reach, 1000)
    # No step without a pointer goes through a join.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert {r["step_id"]: (r["up"], r["level"]) for r in got.collect()} == {i: (i - 3 if i >= 3 else None, min(i, 3)) for i in range(1000)}


def test_rules_share_the_steps_and_their_references(spark):
    steps = spark.range(8).selectExpr("id % 2 AS plan_id", "id AS step_id", "id AS pos", "if(id < 4, 'asr', 'audio_temporal_grounder') AS tool_name", "array('query') AS literals")
    refs = spark.range(2, 8).selectExpr("id % 2 AS plan_id", "id AS step_id", "'clips' AS target_field", "id - 2 AS source_step_id", "'clips' AS field_path")
    got = checks.plan_lint(steps, refs, conditioned=spark.range(1).toDF("plan_id"))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("min_by") == 0 and text.count("Range (") == 2  # the steps' literals and the conditioned plans
    assert {(r["step_id"], r["rule"]) for r in got.collect()} == {(0, "missing_context"), (1, "missing_context"), (4, "sound_before_sight"), (6, "sound_before_sight")}
