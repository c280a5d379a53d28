"""Algorithms that replace one-task groups: serving clips in blocks, levels by pointer doubling, ranks by ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import core, ranking
from sightline.operators.runs import PART, final_results, round_summary
from sightline.plans import checks

FRAMES = "request_id string, clip_no int, frame_key long, score_u long, distance_ms long, t_ms long"


def serve_in_turn(rows, n, key):
    """One clip after the other, each with its first n frames that no clip before it has."""
    out, held = [], set()
    for clip in sorted({(r[0], r[1]) for r in rows}):
        mine = 0
        for r in sorted((r for r in rows if (r[0], r[1]) == clip), key=key):
            if mine < n and (r[0], r[2]) not in held:
                held.add((r[0], r[2]))
                out.append(r)
                mine += 1
    return out


def ranked(r):
    return -r[3], r[4] is None, r[4] or 0, r[5], r[2]


def placed(rows, key):
    out = {}
    for request in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == request), key=lambda r: (*key(r)[:-1], r[1], r[2]))
        out |= {(r[0], r[1], r[2]): i for i, r in enumerate(own, 1)}
    return out


@pytest.mark.parametrize("kind", ["same lists", "random", "chain"])
@pytest.mark.parametrize("clips", [1, 3, 256])
def test_clips_served_in_blocks(spark, kind, clips):
    rng = random.Random(f"{kind}{clips}")
    rows = []
    for request in "ab":
        for clip in range(12 if clips > 1 else 6):
            pool = range(40) if kind == "same lists" else rng.sample(range(40), 15) if kind == "random" else range(clip * 2, clip * 2 + 6)
            # Scores belong to the frame where lists are the same; elsewhere each clip has its own, with ties.
            rows += [(request, clip, k, 1000 - k if kind != "random" else rng.randint(0, 5), rng.choice([None, 1, 2]) if kind == "random" else None, k % 7) for k in pool]
    got = ranking.per_clip_topk(spark.createDataFrame(rows, FRAMES), 3, clips=clips).collect()
    want = serve_in_turn(rows, 3, ranked)
    assert {(r["request_id"], r["clip_no"], r["frame_key"]): r["place"] for r in got} == placed(want, ranked)


def test_window_mode_goes_by_time(spark):
    rows = [("a", c, k, 0, None, (k * 37) % 50) for c in range(4) for k in range(c, c + 12)]
    got = ranking.per_clip_topk(spark.createDataFrame(rows, FRAMES), 4, "anchor_window", clips=2).collect()
    by_time = lambda r: (r[5], r[5], 10**9, r[5], r[2])
    want = serve_in_turn(rows, 4, by_time)
    assert {(r["request_id"], r["clip_no"], r["frame_key"]): r["place"] for r in got} == placed(want, by_time)
    whole = ranking.per_clip_topk(spark.createDataFrame(rows, FRAMES), 4, "chronological").collect()
    assert len(whole) == 15 and sorted(r["place"] for r in whole) == list(range(1, 16))


def test_many_clips_are_served_in_few_passes(spark, monkeypatch):
    """2,000 clips whose neighbours share frames: blocks settle in a few passes."""
    written = []
    real = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, name: written.append(name) or real(df, name))
    frames = spark.range(2000 * 10).select(F.lit("r").alias("request_id"), F.floor(F.col("id") / 10).cast("int").alias("clip_no"), (F.floor(F.col("id") / 10) * 4 + F.col("id") % 10).alias("frame_key"))
    frames = frames.withColumns({"score_u": -F.col("frame_key"), "distance_ms": F.lit(None).cast("long"), "t_ms": F.col("frame_key")})
    got = ranking.per_clip_topk(frames, 4, clips=250)
    assert got.count() == 8000 and got.select("frame_key").distinct().count() == 8000
    assert written.count("served") <= 4


def graph_levels(nodes, edges):
    """Longest ways by walking; None in or behind a cycle."""
    sources, out = {}, {}
    for step, source in edges:
        if source in nodes:
            sources.setdefault(step, set()).add(source)
    waiting = set(nodes)
    while ready := {v for v in waiting if all(s in out for s in sources.get(v, ()))}:
        out |= {v: max((out[s] + 1 for s in sources.get(v, ())), default=0) for v in ready}
        waiting -= ready
    return {v: out.get(v) for v in nodes}


def test_levels_of_random_plans(spark):
    rng = random.Random(6)
    nodes, edges, want = [], [], {}
    for plan in range(60):
        n = rng.randint(1, 25)
        own = [(a, b) for a in range(n) for b in range(-1, n) if a != b and rng.random() < (0.15 if b < a else 0.01)]
        own += [(a, a) for a in range(n) if rng.random() < 0.01]
        nodes += [(plan, v) for v in range(n)]
        edges += [(plan, a, b) for a, b in own] * 2
        want |= {(plan, v): d for v, d in graph_levels(range(n), own).items()}
    got = checks.plan_levels(spark.createDataFrame(nodes, "plan_id long, step_id long"), spark.createDataFrame(edges, "plan_id long, step_id long, source_step_id long")).collect()
    assert {(r["plan_id"], r["step_id"]): r["level"] for r in got} == want
    assert all(r["in_cycle"] == (r["level"] is None) for r in got) and any(r["in_cycle"] for r in got)


def test_a_chain_of_ten_thousand_steps(spark, monkeypatch):
    rounds = []
    real = checks.materialize
    monkeypatch.setattr(checks, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    n = 10_000
    steps = spark.range(n).select(F.lit("p").alias("plan_id"), F.col("id").alias("step_id"))
    # Beside the step before, every step also needs one of the first ones, and three steps wait for each other at the end.
    chain = steps.filter("step_id > 0").select("plan_id", "step_id", (F.col("step_id") - 1).alias("source_step_id"))
    more = steps.filter("step_id > 9").select("plan_id", "step_id", F.col("step_id") % 7)
    loop = spark.createDataFrame([("p", n - 3, n - 1)], "plan_id string, step_id long, source_step_id long")
    got = {r["step_id"]: r["level"] for r in checks.plan_levels(steps, chain.union(more).union(loop)).collect()}
    assert got == {v: v if v < n - 3 else None for v in range(n)}
    assert rounds.count("levels") + rounds.count("sources") <= 20
    rounds.clear()
    assert {r["level"] for r in checks.plan_levels(steps, chain).collect()} == set(range(n))
    assert len(rounds) <= 15


def test_ranks_of_one_large_key(spark, monkeypatch):
    dealt = []
    real = core.materialize
    monkeypatch.setattr(core, "materialize", lambda df, name: dealt.append(real(df, name)) or dealt[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as a large table would be
    n = 20_000
    rows = spark.range(n).select(F.when(F.col("id") % 100 == 0, F.lit(None)).otherwise("k").alias("key"), F.lit(5).alias("line"), F.xxhash64("id").alias("order"))
    got = core.global_rank(rows, ["key"], [F.col("line"), F.desc("order")])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt[0].filter("key = 'k'").select(F.shiftright("_at", 33)).distinct().count() > 2
    for key in (None, "k"):
        own = got.filter(F.col("key").eqNullSafe(F.lit(key))).orderBy("rank").collect()
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [r["order"] for r in own] == sorted((r["order"] for r in own), reverse=True)


def test_rounds_with_one_line_number(spark):
    n = 2 * PART + 5
    steps = spark.range(n).select(F.lit("r").alias("round_id"), F.lit(1).alias("line"), (n - F.col("id")).alias("order"), F.col("id").cast("string").alias("tool"), F.when(F.col("id") == 0, "last").otherwise("no").alias("verdict"))
    parts = round_summary(steps).orderBy("part").collect()
    assert [r["n_steps"] for r in parts] == [PART, PART, 5] and {r["verdict"] for r in parts} == {"last"}
    assert ",".join(r["tools"] for r in parts).split(",") == [str(i) for i in reversed(range(n))]
    runs = spark.createDataFrame([("r", "x"), ("none", "y")], "run_id string, answer string")
    got = {r["run_id"]: (r["n_parts"], r["n_steps"]) for r in final_results(runs, round_summary(steps).withColumnRenamed("round_id", "run_id")).collect()}
    assert got == {"r": (3, n), "none": (0, 0)}
