"""Rows that went wrong and plans that did not hold, one test per finding of the fourth round."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline.catalog import load_all
from sightline.catalog.registry import ORACLES, QUERIES
from sightline.llm import common, components, simhash
from sightline.operators import lookups
from sightline.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_spread_by_explode_are_never_broadcast(spark, tmp_path):
    spark.range(40_000).selectExpr("id * 7919 AS fp", "id AS rep").write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    cells = simhash._shared(simhash._placed(nodes.select("fp"), 0, 0, 32))
    hooks = nodes.selectExpr("fp AS root", "rep AS to")
    moved = components._moved(hooks, "to", hooks, 16)
    assert "BroadcastHashJoin" not in plan(cells) + plan(moved)
    assert moved.count() == 40_000
    few = common.all_salts(spark.range(3), 4)
    assert sorted(map(tuple, few.collect())) == [(i, k) for i in range(3) for k in range(4)]
    assert dict(few.dtypes)["_salt"] == dict(common.salted(spark.range(3), F.col("id"), 4).dtypes)["_salt"] == "int"


ODD_TEXTS = ["", " ", " \n ", "\n", "\t\n", " led by a space", "first\n line", "a\n", "\rword\r next", "\u00a0wide", "two\u00b2 and \u0663", "1 one, Two and two", "plain text", None, "7", "x" * 999 + "\u00e9" + "y" * 1500, "caf\u00e9 " * 300]


@pytest.mark.parametrize("name", ["atomize_udtf", "file_fingerprint"])
def test_odd_texts_and_repeated_ids_equal_the_sql(spark, tmp_path, name):
    load_all()
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (None, "again no id"), (-5, "negative"), (-5, "twice"), (5, "positive"), (6, "first\n line"), (1 << 40, ""), (11, "1 one. three")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    want = duckdb.sql(ORACLES[name].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) >= len(rows)


def test_driver_lists_no_folder(spark, tmp_path):
    for name in ("a/b/c.txt", "a/.draft", "a/_SUCCESS", "a/k=1/_d=2/e.txt", "top.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / "empty folder").mkdir()
    files = readers.listing(spark, str(tmp_path))
    # Spark's own listing keeps a status per file on the driver; here every scan is one of a written level.
    assert "binaryFile" not in plan(files)
    assert sorted(r["path"].rsplit(f"{tmp_path}/", 1)[1] for r in files.collect()) == ["a/b/c.txt", "a/k=1/_d=2/e.txt", "top.txt"]
    assert {r["length"] for r in files.collect()} == {0}
    assert [r["path"][-5:] for r in readers.listing(spark, f"{tmp_path}/t*.txt").collect()] == ["p.txt"]
    with pytest.raises(FileNotFoundError):
        readers.listing(spark, f"{tmp_path}/none")


def test_references_travel_as_one_row_of_a_step_and_source(spark):
    refs = spark.range(60).selectExpr("id % 2 AS plan_id", "10L AS step_id", "if(id < 40, 'clips', 'query') AS target_field", "id AS pos", "id % 5 AS source_step_id", "if(id = 55, 'none', 'a') AS field_path")
    outputs = spark.range(10).selectExpr("id % 2 AS plan_id", "id DIV 2 AS step_id", "id AS seq", "concat('{\"a\": ', id, '}') AS output")
    got = lookups.merged_refs(refs, outputs, refs.selectExpr("plan_id", "step_id", "'clips' AS target_field", "'\"given\"' AS value").distinct(), part=7)
    above, below = got._jdf.queryExecution().optimizedPlan().toString().split("Join ")
    # References are put together before they meet the outputs and are taken apart once they are dealt by step.
    assert "collect_list(struct(target_field" in below and "inline" in above
    rows = {(r["plan_id"], r["target_field"]): (r["value"], r["n_refs"], r["error"]) for r in got.collect()}
    told = ",".join(str(i % 5 * 2) for i in range(0, 40, 2))
    assert rows[0, "clips"] == (f'["given",{told}]', 20, None) and rows[0, "query"] == (str(58 % 5 * 2), 10, None)
    assert rows[1, "clips"] == (None, 20, "unresolved_dependency: none") and rows[1, "query"] == (None, 10, "unresolved_dependency: none")
