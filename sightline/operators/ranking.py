"""Top-k and frame selection. Groups are cut to a proven size before any per-group Python runs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.vectors import dot, norm
from sightline.operators.core import global_rank, keep_first, top_n
from sightline.operators.intervals import SLAB_MS
from sightline.session import materialize


def keyword_topk(
    df: DataFrame, columns: list[str], terms: list[str], limit: int, seq: str, compat: bool = False
) -> DataFrame:
    """Rows by number of query terms found in their values; rows without any are dropped.

    ``compat`` also searches the column names, as a search over the row's JSON would.
    """
    body = F.lower(F.to_json(F.struct(*columns)) if compat else F.concat_ws("\n", *columns))
    wanted = sorted({t.strip().lower() for t in terms if t.strip()})
    score = F.lit(0)
    for term in wanted:
        score = score + F.contains(body, F.lit(term)).cast("int")
    hits = df.withColumn("score", score).filter(F.col("score") > 0)
    # One extra constant key: the window group limit cuts every task to ``limit`` rows first.
    return top_n(hits.withColumn("_all", F.lit(0)), ["_all"], [F.desc("score"), F.asc(seq)], limit).drop("_all")


def embedding_topk(frames: DataFrame, queries: dict[int, list[float]], k: int, places: int = 6) -> DataFrame:
    """Nearest frames per query by the dot product of unit vectors; ties go to the earlier time.

    ``queries`` is the short list of one request and travels inside the plan.
    """
    scale = F.greatest(norm(F.col("embedding")), F.lit(1e-8))
    scored = []
    for qid, vector in queries.items():
        size = max(sum(x * x for x in vector) ** 0.5, 1e-8)
        unit = F.array(*[F.lit(x / size) for x in vector])
        score = F.round(dot(F.col("embedding"), unit) / scale, places)
        scored.append(F.struct(F.lit(qid).alias("query_id"), score.alias("score")))
    rows = frames.withColumn("_q", F.explode(F.array(*scored))).select("seq", "video_id", "t_ms", "_q.query_id", "_q.score")
    return top_n(rows, ["query_id"], [F.desc("score"), F.asc("t_ms"), F.asc("seq")], max(1, k))


def midpoint_distance(frames: DataFrame, clips: DataFrame, anchors_ms: list[int] | None = None) -> DataFrame:
    """Rank key without a query: distance to the nearest anchor, else to the middle of the clip (doubled ms)."""
    joined = frames.join(clips, "video_id")
    if anchors_ms:
        twice = F.array_min(F.array(*[F.abs(F.col("t_ms") - a) * 2 for a in anchors_ms]))
    else:
        twice = F.abs(F.col("t_ms") * 2 - F.col("clip_start_ms") - F.col("clip_end_ms"))
    return joined.withColumn("distance2_ms", twice)


def tree_top(df: DataFrame, keys: Sequence[str], order: list[Column], m: int, t: str) -> DataFrame:
    """First ``m`` rows per key through cuts per slab of time, so no task ever holds a whole key."""
    out = df
    for width in (SLAB_MS, SLAB_MS * 64, SLAB_MS * 4096):
        out = out.withColumn("_cut", F.floor(F.col(t) / F.lit(width)))
        out = top_n(out, [*keys, "_cut"], order, m, "_n").drop("_cut", "_n")
    return top_n(out, keys, order, m, "_n").drop("_n")


def _greedy(rows: pd.DataFrame, n: int, gap: int) -> pd.DataFrame:
    """Walk rows by rank, skip those too near a chosen one, then fill up by rank."""
    rows = rows.sort_values(["first", "temporal_u", "distance_ms", "t_ms", "seq"], ascending=[False, False, True, True, True])
    times, taken = rows["t_ms"].to_numpy(), []
    for i in range(len(rows)):
        if len(taken) == n:
            break
        if all(abs(times[i] - times[j]) >= gap for j in taken):
            taken.append(i)
    chosen = set(taken)
    taken += [i for i in range(len(rows)) if i not in chosen][: n - len(taken)]
    return rows.iloc[taken].assign(pick=range(1, len(taken) + 1))


def diverse_topk(ranked: DataFrame, key: str, n: int, gap_ms: int, centre: DataFrame | None = None) -> DataFrame:
    """``n`` well-ranked frames per clip at least ``gap_ms`` apart, filled up by rank when there are too few.

    Exact cut: a chosen frame blocks fewer than 2·gap distinct milliseconds, so the best row of each
    millisecond and then the first n·2·gap + n of those are enough for the walk, and the first 2n rows for
    the fill. ``centre`` (one row per clip) is chosen first when given.
    """
    cols = [key, "seq", "t_ms", "temporal_u", "distance_ms"]
    rows = ranked.select(*cols).withColumn("distance_ms", F.coalesce("distance_ms", F.lit(2**62)))
    order = [F.desc("temporal_u"), F.asc("distance_ms"), F.asc("t_ms"), F.asc("seq")]
    one = keep_first(rows, [key, "t_ms"], [-F.col("temporal_u"), F.col("distance_ms"), F.col("seq")])
    walk = tree_top(one, [key], order, n * 2 * gap_ms + n, "t_ms")
    fill = top_n(rows, [key], order, 2 * n, "_n").drop("_n")
    pool = walk.unionByName(fill).distinct().withColumn("first", F.lit(0))
    if centre is not None:
        marked = centre.select(key, "seq").withColumn("_c", F.lit(1))
        extra = rows.join(marked, [key, "seq"]).drop("_c").withColumn("first", F.lit(1))
        pool = pool.join(marked, [key, "seq"], "left_anti").unionByName(extra)
    kind = dict(pool.dtypes)
    schema = f"{key} {kind[key]}, seq long, t_ms long, temporal_u long, distance_ms long, first int, pick long"
    picked = pool.groupBy(key).applyInPandas(lambda pdf: _greedy(pdf, n, gap_ms)[[key, "seq", "t_ms", "temporal_u", "distance_ms", "first", "pick"]], schema)
    return picked.drop("first", "distance_ms")


def anchor_window_select(
    frames: DataFrame, key: str, anchors_ms: list[int], n: int, radius_ms: int, neighbours: bool = True
) -> DataFrame:
    """Frames around each anchor of one request: closest, one before, one after, then fill by distance.

    Anchors are served in order and share one list: an anchor stops as soon as the list holds its target
    count (at least ``n``, and five or the window's size with neighbours). Without anchors all frames stay.
    At most target + number of anchors rows per (clip, anchor) can matter, which is where rows are cut.
    """
    if not anchors_ms:
        out = frames.withColumns({"role": F.lit("interval_frame"), "anchor_ms": F.lit(None).cast("long")})
        return out.select(key, "seq", "t_ms", "score_u", "anchor_ms", "role")
    spread = frames.withColumn("_a", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a")) for i, a in enumerate(anchors_ms)])))
    rows = spread.select(key, "seq", "t_ms", "score_u", F.col("_a.i").alias("i"), F.col("_a.a").alias("anchor_ms"))
    rows = rows.withColumn("distance_ms", F.abs(F.col("t_ms") - F.col("anchor_ms")))
    rows = rows.withColumn("outside", (F.lit(radius_ms > 0) & (F.col("distance_ms") > radius_ms)).cast("int"))
    most = max(n, 3, 5) + len(anchors_ms) + 3
    order = [F.asc("outside"), F.asc("distance_ms"), F.desc("score_u"), F.asc("t_ms"), F.asc("seq")]
    near = top_n(rows, [key, "i"], order, most, "_n").drop("_n").withColumn("side", F.lit(""))
    latest, soonest = F.struct("t_ms", -F.col("seq")), F.struct("t_ms", "seq")
    packed = F.struct("seq", "t_ms", "score_u", "anchor_ms", "distance_ms", "outside")
    ends = rows.groupBy(key, "i").agg(
        F.max_by(packed, F.when(F.col("t_ms") < F.col("anchor_ms"), latest)).alias("before"),
        F.min_by(packed, F.when(F.col("t_ms") > F.col("anchor_ms"), soonest)).alias("after"),
    )
    kept = near
    for side in ("before", "after") if neighbours else ():
        kept = kept.unionByName(ends.filter(F.col(side).isNotNull()).select(key, "i", f"{side}.*").withColumn("side", F.lit(side)))
    schema = f"{key} {dict(frames.dtypes)[key]}, seq long, t_ms long, score_u long, anchor_ms long, distance_ms long, role string"
    return kept.groupBy(key).applyInPandas(lambda pdf: _serve_anchors(pdf, key, n, neighbours), schema)


def _serve_anchors(pdf: pd.DataFrame, key: str, n: int, neighbours: bool) -> pd.DataFrame:
    """An anchor takes the head of its own list that no earlier anchor took: what the shared list lacks to its target, one row at least."""
    nearest = ["distance_ms", "t_ms", "seq"]
    taken: list[pd.DataFrame] = []
    held: set[int] = set()
    for _, own in pdf.groupby("i", sort=True):
        window = own[own["side"] == ""]
        window = window[window["outside"] == window["outside"].min()]
        centre = window.nsmallest(1, nearest)
        asked = pd.concat([centre, own[own["side"] == "before"].head(1), own[own["side"] == "after"].head(1)])
        target = max(n, asked["seq"].nunique(), min(5, len(window)) if neighbours else 0)
        wanted = pd.concat([asked, window.sort_values(["distance_ms", "score_u", "t_ms"], ascending=[True, False, True])])
        fresh = wanted.drop_duplicates("seq")
        fresh = fresh[~fresh["seq"].isin(held)].head(max(1, target - len(held)))
        side = fresh["t_ms"].lt(fresh["anchor_ms"]).map({True: "before", False: "after"})
        taken.append(fresh.assign(role=side.where(fresh["seq"] != centre["seq"].iloc[0], "anchor")))
        held.update(fresh["seq"])
    return pd.concat(taken)[[key, "seq", "t_ms", "score_u", "anchor_ms", "distance_ms", "role"]].sort_values(["t_ms", "seq"])


#: Clips of a request served in one pass, in their order.
CLIPS = 256

def _frame_order(mode: str, columns: Sequence[str]) -> list[Column]:
    """Ranked: best score, then nearest anchor, then time. Otherwise by clip, asked time, place in the sequence and time; what a frame lacks is its own time, and the last place."""
    if mode == "ranked":
        return [F.desc("score_u"), F.asc_nulls_last("distance_ms"), F.asc("t_ms")]
    given = {c: F.col(c) if c in columns else F.lit(None).cast("long") for c in ("clip_start_ms", "requested_ms", "sequence_index")}
    return [F.coalesce(given["clip_start_ms"], "t_ms"), F.coalesce(given["requested_ms"], "t_ms"), F.coalesce(given["sequence_index"], F.lit(10**9)), F.asc("t_ms")]


def _serve(n: int):
    """Reads candidates by (request_id, clip_no, _n); each clip keeps its first n that no clip before it in the block keeps."""

    def run(batches):
        import pyarrow as pa

        block = clip = None
        held: set = set()
        served = 0
        for batch in batches:
            keep = []
            rows = zip(*(batch[c].to_pylist() for c in ("request_id", "_block", "clip_no", "frame_key")), strict=True)
            for request, number, own, frame in rows:
                if (request, number) != block:
                    block, clip, held = (request, number), None, set()
                if own != clip:
                    clip, served = own, 0
                fresh = served < n and frame not in held
                if fresh:
                    held.add(frame)
                    served += 1
                keep.append(fresh)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def per_clip_topk(frames: DataFrame, n: int, mode: str = "ranked", clips: int = CLIPS) -> DataFrame:
    """``n`` frames for every clip of a request, a frame chosen for an earlier clip not chosen again, and their ``place``.

    Input: request_id, clip_no (from 0), frame_key, score_u, distance_ms, t_ms. ``mode`` is ranked; anchor_window (by
    time, ``n`` of each clip; clip_start_ms, requested_ms and sequence_index are used where given); or chronological
    (whole clips). ``place`` numbers a request's frames in the same order.

    Clips are served in blocks of ``clips``, all blocks at once, as if earlier blocks kept what they kept the time
    before; a pass repeats until nothing changes. After each pass one more block of a request is final, and most are
    when blocks share few frames. A task streams one block's rows and holds at most ``clips * n`` frames. Clip number g
    can lose at most n·g frames to earlier clips, so its first n·(g+1) rows decide it.
    """
    order = [*_frame_order(mode, frames.columns), F.asc("frame_key")]
    if mode == "chronological":
        chosen = keep_first(frames, ["request_id", "frame_key"], ["clip_no"])
        return global_rank(chosen, ["request_id"], [*order, F.asc("clip_no")], "place")
    ranked = global_rank(frames.filter("frame_key IS NOT NULL"), ["request_id", "clip_no"], order, "_n")
    rows = ranked.filter(F.col("_n") <= F.lit(n) * (F.col("clip_no") + 1)).withColumn("_block", F.floor(F.col("clip_no") / clips))
    rows = materialize(rows, "candidates")
    key = ["request_id", "frame_key"]

    def served(candidates: DataFrame) -> DataFrame:
        dealt = candidates.repartition("request_id", "_block").sortWithinPartitions("request_id", "_block", "clip_no", "_n")
        return materialize(dealt.mapInArrow(_serve(n), candidates.schema), "served")

    taken = served(rows)
    # Requests of one block are done.
    last = rows.groupBy("request_id").agg(F.max("_block").alias("_last")).filter("_last > 0")
    several = rows.join(last.drop("_last"), "request_id", "left_semi")
    final = 0
    while last.filter(F.col("_last") > final).limit(1).count():
        holders = taken.groupBy(*key).agg(F.min("_block").alias("_held"))
        left = several.filter(F.col("_block") > final).alias("r")
        lost = F.col("h._held") < F.col("r._block")
        on = (F.col("r.request_id") == F.col("h.request_id")) & (F.col("r.frame_key") == F.col("h.frame_key")) & lost
        now = served(left.join(holders.alias("h"), on, "left_anti"))
        before = taken.join(last.drop("_last"), "request_id", "left_semi").filter(F.col("_block") > final)
        same = ["request_id", "clip_no", "frame_key"]
        changed = now.select(*same).exceptAll(before.select(*same)).limit(1).count() or before.select(*same).exceptAll(now.select(*same)).limit(1).count()
        alone = taken.join(last.drop("_last"), "request_id", "left_anti")
        taken = materialize(alone.unionByName(taken.join(last.drop("_last"), "request_id", "left_semi").filter(F.col("_block") <= final)).unionByName(now), "taken")
        final += 1
        if not changed:
            break
    return global_rank(taken.select(*frames.columns), ["request_id"], [*order[:-1], F.asc("clip_no"), F.asc("frame_key")], "place")


def frame_pool(clips: DataFrame, anchors_ms: list[int], radius_ms: int) -> DataFrame:
    """Range of frames worth reading per clip: around the anchors in a long clip, else the clip widened."""
    if not anchors_ms:
        return clips.withColumns({"lo_ms": F.col("clip_start_ms"), "hi_ms": F.col("clip_end_ms")})
    lo, hi = F.col("clip_start_ms"), F.col("clip_end_ms")
    first, last = F.greatest(lo, F.lit(min(anchors_ms))), F.least(hi, F.lit(max(anchors_ms)))
    pool = max(500, radius_ms)
    spread = F.greatest(F.lit(0), last - first)
    long = F.greatest(F.lit(0), hi - lo) > F.greatest(F.lit(30_000), spread + 4 * pool)
    start = F.when(long, first - pool).otherwise(F.least(lo, first) - pool)
    end = F.when(long, last + pool).otherwise(F.greatest(hi, last) + pool)
    return clips.withColumns({"lo_ms": F.greatest(F.lit(0), start), "hi_ms": end})


def within_pool(frames: DataFrame, pools: DataFrame) -> DataFrame:
    """Frames inside the pool of their clip; a clip whose pool is empty keeps all of its frames."""
    placed = frames.join(pools, "video_id").withColumn("_in", F.col("t_ms").between(F.col("lo_ms"), F.col("hi_ms")))
    some = placed.groupBy("video_id").agg(F.bool_or("_in").alias("_any"))
    return placed.join(some, "video_id").filter(F.col("_in") | ~F.col("_any")).drop("_in", "_any")


def select_rows(df: DataFrame, order: str, index: int | None = None, limit: int | None = None) -> DataFrame:
    """One row by its place in ``order`` (out of range is an error) or the first ``limit`` rows."""
    if index is not None:
        picked = df.orderBy(order).offset(index).limit(1) if index >= 0 else df.limit(0)
        if index < 0 or not picked.take(1):
            raise IndexError(f"index {index} is out of range")
        return picked
    return df.orderBy(order).limit(limit) if limit is not None else df
