"""References between steps: paths as data, and several references merged into one field."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from sightline.functions import jsons
from sightline.operators import lookups

DOC = {
    "none": None, "n": 1, "s": "[x", "a": [{"b": [1, 2, None]}, {"b": []}, {"c": 1}, {"b": [3]}],
    "regions": [{"id": None}, {"label": "", "name": "Spare Part", "id": 5}, {"label": "part", "id": 6}, 7], "deep": {"a": {"b": [[1, [2]], [], [[3], 4]]}}, "q.r": 1, "2": "two",
}
PATHS = (
    "none n s a a[] a[].b a[].b[] a[].b[0] a[0].b[] a[1].b[] a[].c regions.part.id regions.spare.id regions.none.id regions[].id regions[1].name regions.3 regions.9 regions[9] "
    "deep.a.b[].[] deep.a.b deep.a.b[2].[] deep.a.b.2.0.0 n.x n[] [] x.y 2 2.x . a..[].b"
).split()


def test_paths_as_data_equal_paths_in_the_plan(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string").withColumn("v", F.parse_json(F.lit(json.dumps(DOC))))
    got = {r["path"]: r["found"] for r in rows.select("path", jsons.json_walk(F.col("v"), F.col("path")).alias("found")).collect()}
    one = spark.range(1).select(F.parse_json(F.lit(json.dumps(DOC))).alias("v"))
    want = one.select(*[jsons.json_path(F.col("v"), p).alias(f"p{i}") for i, p in enumerate(PATHS)]).first()
    assert got == {p: want[i] for i, p in enumerate(PATHS)}
    assert got["deep.a.b[].[]"] == "[[1,[2]],[[3],4]]" and got["a[].b[]"] == "[[1,2],[3]]" and got["regions.spare.id"] == "5"


def test_odd_tokens_are_keys(spark):
    doc = json.dumps({"b[][]": 1, "a b": {"é": 2}, "x-y": [{"label": "x-y z", "v": 3}]})
    rows = spark.createDataFrame([("b[][]",), ("a b.é",), ("x-y.x-y.v",), ("c[][]",), ("x-y[]",), ("",)], "path string")
    got = {r["path"]: r["v"] for r in rows.select("path", jsons.json_walk(F.parse_json(F.lit(doc)), F.col("path")).alias("v")).collect()}
    assert got.pop("") is not None and got == {"b[][]": "1", "a b.é": "2", "x-y.x-y.v": "3", "c[][]": None, "x-y[]": None}


def test_one_join_and_no_path_in_the_plan(spark):
    refs = spark.createDataFrame([("p", 2, "f", 1, p) for p in PATHS], "plan_id string, step_id long, target_field string, source_step_id long, field_path string")
    outputs = spark.createDataFrame([("p", 1, 1, json.dumps(DOC))], "plan_id string, step_id long, seq long, output string")
    found = lookups.resolved_refs(refs.repartition(2), outputs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "regions" not in plan
    assert found.count() == len(PATHS)


def plain_merge(held, values, is_list):
    """What a field holds after its references, one after the other."""
    for v in values:
        if is_list:
            old = [] if held is None else held if isinstance(held, list) else [held]
            held = old + (v if isinstance(v, list) else [v])
        elif isinstance(held, list):
            held = held + (v if isinstance(v, list) else [v])
        elif isinstance(v, list) and held is not None:
            held = [held, *v]
        else:
            held = v
    return held


def test_merging(spark):
    rng = random.Random(9)
    output = {"one": 1, "two": "2", "obj": {"k": [1]}, "l": [1, "a", None], "e": [], "ll": [[1], [2]], "bad": None}
    refs, inputs, want = [], [], {}
    for step in range(2, 160):
        fields, failed = {}, []
        for field in rng.sample(["clips", "query", "x.Frames", "scope", "a.b"], rng.randint(1, 4)):
            held = rng.choice([None, None, 0, "s", [], [9]])
            if held is not None:
                inputs.append(("p", step, field, json.dumps(held)))
            values, names = [], rng.choices(list(output), [6, 6, 4, 6, 2, 3, 0.4], k=rng.randint(1, 5))
            for pos, name in enumerate(names):
                refs.append(("p", step, field, pos, 1, name))
                values.append(output[name])
                if output[name] is None:
                    failed.append((field, pos, name))
            fields[field] = plain_merge(held, values, field.split(".")[-1].lower() in lookups.LIST_FIELDS)
        for field, value in fields.items():
            want[step, field] = (None, f"unresolved_dependency: {min(failed)[2]}") if failed else (value, None)
    df = spark.createDataFrame(refs, "plan_id string, step_id long, target_field string, pos int, source_step_id long, field_path string")
    outputs = spark.createDataFrame([("p", 1, 1, json.dumps({"one": 0})), ("p", 1, 2, json.dumps(output))], "plan_id string, step_id long, seq long, output string")
    given = spark.createDataFrame([*inputs, ("p", 1, "clips", "1")], "plan_id string, step_id long, target_field string, value string")
    for part in (1, 2, 1000):
        found = lookups.merged_refs(df, outputs, given, part).collect()
        assert {(r["step_id"], r["target_field"]): (r["value"] and json.loads(r["value"]), r["error"]) for r in found} == want
    assert {r["n_refs"] for r in found} == {1, 2, 3, 4, 5}
