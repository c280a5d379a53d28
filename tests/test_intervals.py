"""Interval algebra against plain loops, with slabs small enough to be crossed."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.operators import intervals as I
from sightline.operators.core import keep_first, keep_last, rank_rows

SPAN = st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 60), st.integers(0, 25))
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(autouse=True)
def small_slabs(monkeypatch):
    monkeypatch.setattr(I, "SLAB_MS", 10)


def table(spark, rows):
    data = [(k, i, s, s + n, (i * 7) % 5) for i, (k, s, n) in enumerate(rows)]
    return spark.createDataFrame(data, "k string, seq long, start_ms long, end_ms long, score long"), data


def loop_merge(data, tol):
    out = []
    for k in sorted({d[0] for d in data}):
        cur = None
        for _, _, s, e, _ in sorted((d for d in data if d[0] == k), key=lambda d: d[2:4]):
            if cur and s <= cur[1] + tol:
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                out.append((k, cur))
    return sorted((k, c[0], c[1]) for k, c in out)


@FEW
@given(rows=st.lists(SPAN, min_size=1, max_size=30), tol=st.sampled_from([0, 3]))
def test_merge_equals_loop_and_is_idempotent(spark, rows, tol):
    df, data = table(spark, rows)
    merged = I.merge_intervals(df, ["k"], tol)
    got = sorted((r.k, r.start_ms, r.end_ms) for r in merged.collect())
    assert got == loop_merge(data, tol)
    assert sum(r.n for r in merged.collect()) == len(data)
    again = I.merge_intervals(merged.drop("n"), ["k"], tol)
    assert sorted((r.k, r.start_ms, r.end_ms) for r in again.collect()) == got


@FEW
@given(rows=st.lists(SPAN, min_size=2, max_size=25))
def test_overlap_max_equals_nested_loop(spark, rows):
    df, data = table(spark, rows)
    windows, cands = df.filter("seq % 2 = 0").drop("score", "seq").distinct(), df.filter("seq % 2 = 1")
    got = {(r.k, r.start_ms, r.end_ms): r.score for r in I.overlap_max(windows, cands, ["k"], "score").collect()}
    for k, _, s, e, _ in (d for d in data if d[1] % 2 == 0):
        hits = [d[4] for d in data if d[1] % 2 == 1 and d[0] == k and d[2] <= e and d[3] >= s]
        assert got[(k, s, e)] == (max(hits) if hits else None)


@FEW
@given(rows=st.lists(SPAN, min_size=1, max_size=25))
def test_neighbours_equal_loop(spark, rows):
    df, data = table(spark, rows)
    df = df.withColumn("reach", F.lit(7))
    fixed = {r.seq: (r.others_sum, r.others_n) for r in I.neighbour_sums(df, ["k"], "start_ms", "score", 7).collect()}
    by_column = {r.seq: (r.others_sum, r.others_n) for r in I.neighbour_sums_within(df, ["k"], "start_ms", "score", "reach").collect()}
    for k, i, s, _, _ in data:
        near = [d[4] for d in data if d[0] == k and d[1] != i and abs(d[2] - s) <= 7]
        assert fixed[i] == by_column[i] == (sum(near), len(near))


@FEW
@given(rows=st.lists(SPAN, min_size=1, max_size=25))
def test_rank_dedupe_median(spark, rows):
    df, data = table(spark, rows)
    ranks = {r.seq: r.rank for r in rank_rows(df, ["k"], "start_ms", "seq", 10, tie_block=4).collect()}
    for k in {d[0] for d in data}:
        ordered = sorted((d for d in data if d[0] == k), key=lambda d: (d[2], d[1]))
        assert [ranks[d[1]] for d in ordered] == list(range(1, len(ordered) + 1))
    first = {r.k: r.seq for r in keep_first(df, ["k"], ["seq"]).collect()}
    last = {r.k: r.seq for r in keep_last(df, ["k"], ["seq"]).collect()}
    medians = {r.k: r["median"] for r in I.exact_medians(df, ["k"], "start_ms").collect()}
    for k in {d[0] for d in data}:
        mine = [d for d in data if d[0] == k]
        assert (first[k], last[k]) == (min(d[1] for d in mine), max(d[1] for d in mine))
        values = sorted(d[2] for d in mine)
        assert medians[k] == (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2


def test_windows_for_points(spark):
    points = spark.createDataFrame([("v", 65_000), ("v", 190_000)], "video_id string, t_ms long")
    length = spark.createDataFrame([("v", 240_000)], "video_id string, duration_ms long")
    got = I.windows_for_points(points, length, ["video_id"], 60_000, 1, 4).collect()
    assert sorted(r.idx for r in got) == [0, 1, 2, 3]


def test_fixed_windows(spark):
    length = spark.createDataFrame([("v", 180_000)], "video_id string, duration_ms long")
    got = I.fixed_windows(length, 60_000).collect()
    assert sorted((r.start_ms, r.end_ms) for r in got) == [(0, 60_000), (60_000, 120_000), (120_000, 180_000)]


def test_plateau_centre(spark):
    rows = [(1, 10, 950), (2, 11, 960), (3, 12, 970), (4, 13, 950), (5, 20, 600)]
    df = spark.createDataFrame([("v", i, t * 1000, s * 1000) for i, t, s in rows], "video_id string, seq long, t_ms long, temporal_u long")
    best = I.best_plateau(df, ["video_id"], "temporal_u").first()
    # 10..13 lie within 3 % of the best; their median time is 11.5, and 12 scores higher than 11.
    assert best.t_ms == 12_000
