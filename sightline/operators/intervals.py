"""Interval algebra on whole milliseconds. Every operator works per key and stays exact under skew.

A slab is a fixed stretch of time; after rows are combined per (key, millisecond) it holds at most
``SLAB_MS`` rows, which bounds every window here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.timing import to_s
from sightline.operators.core import Running, Split, keep_first, rank_rows, running, split_by, top_n

SLAB_MS = 600_000


def _slab(t: str) -> Column:
    return F.floor(F.col(t) / F.lit(SLAB_MS))


def valid_intervals(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> Split:
    """(kept, rejected): an interval must not end before it starts."""
    return split_by(df, F.col(end) >= F.col(start))


def tidy_intervals(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Fill a missing end from the other one, drop rows without both, swap inverted ends."""
    lo, hi = F.coalesce(start, end), F.coalesce(end, start)
    filled = df.filter(F.col(start).isNotNull() | F.col(end).isNotNull())
    return filled.withColumns({start: F.least(lo, hi), end: F.greatest(lo, hi)})


def merge_intervals(
    df: DataFrame, keys: Sequence[str], tolerance_ms: int = 0, extra: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Merge intervals per key whose gap is at most ``tolerance_ms``.

    ``extra`` maps an output name to (input column, "max" | "sum") carried along with the merge.
    Columns out: keys, start_ms, end_ms, n (intervals merged), extras.
    """
    extra = extra or {}
    combine = {"max": F.max, "sum": F.sum}
    carried = [combine[how](name).alias(name) for name, (_, how) in extra.items()]
    per = df.groupBy(*keys, "start_ms").agg(
        F.max("end_ms").alias("end_ms"),
        F.count(F.lit(1)).alias("n"),
        *[combine[how](src).alias(name) for name, (src, how) in extra.items()],
    )
    # Islands inside a slab: one window by (keys, slab), no further shuffle.
    inside = Window.partitionBy(*keys, "_slab").orderBy("start_ms")
    reach = F.max("end_ms").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    local = per.withColumn("_slab", _slab("start_ms")).withColumn("_reach", reach)
    opens = F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach") + tolerance_ms)
    local = local.withColumn("_open", F.max(F.when(opens, F.col("start_ms"))).over(inside))
    local = local.groupBy(*keys, "_slab", "_open").agg(F.max("end_ms").alias("end_ms"), F.sum("n").alias("n"), *carried)
    # Across slabs: an island continues an earlier one when it starts within that one's reach. Those that do
    # are the first of their slab, so the last island of a slab tells whether any opened there.
    before = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = local.groupBy(*keys, "_slab").agg(F.max("end_ms").alias("_far"), F.max("_open").alias("_last"))
    slabs = slabs.withColumn("_carry", F.max("_far").over(before))
    fresh = F.col("_carry").isNull() | (F.col("_last") > F.col("_carry") + tolerance_ms)
    slabs = slabs.withColumn("_prior", F.max(F.when(fresh, F.col("_last"))).over(before))
    joined = local.join(slabs.select(*keys, "_slab", "_carry", "_prior"), [*keys, "_slab"])
    own = F.col("_carry").isNull() | (F.col("_open") > F.col("_carry") + tolerance_ms)
    named = joined.withColumn("start_ms", F.when(own, F.col("_open")).otherwise(F.col("_prior")))
    merged = named.groupBy(*keys, "start_ms").agg(F.max("end_ms").alias("end_ms"), F.sum("n").alias("n"), *carried)
    return merged.select(*keys, "start_ms", "end_ms", "n", *extra)


def first_intervals(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """First ``k`` merged intervals per key in time order."""
    return top_n(df, keys, [F.col("start_ms")], k, "pos")


# ---------------------------------------------------------------- overlap without pairs


def _shift(c: Column, k: Column) -> Column:
    return F.call_function("shiftright", c, k)


def _tiles(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row per power-of-two block (level, block) of the tiling of [start, end]: at most two per level."""
    bits = F.ceil(F.log2((end - start + 2).cast("double"))).cast("int")
    rows = df.withColumns({"_s": start, "_e": end}).withColumn("level", F.explode(F.sequence(F.lit(0), bits)))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    rows = rows.withColumns(
        {"_lo": _shift(F.col("_s") + size - 1, F.col("level")), "_hi": _shift(F.col("_e") + 1, F.col("level"))}
    ).filter("_lo < _hi")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    ends = F.array_compact(F.array(F.when(odd("_lo"), F.col("_lo")), F.when(odd("_hi"), F.col("_hi") - 1)))
    return rows.withColumn("block", F.explode(ends)).drop("_s", "_e", "_lo", "_hi")


def _stabs(df: DataFrame, t: str, top: int) -> DataFrame:
    """One row per block (level, block) that holds the time, up to level ``top``."""
    rows = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    return rows.withColumn("block", _shift(F.col(t), F.col("level")))


def _top_level(df: DataFrame) -> int:
    longest = df.agg(F.max(F.col("end_ms") - F.col("start_ms"))).first()[0]
    return max(1, int((longest or 0) + 2).bit_length())


def overlap_max(windows: DataFrame, candidates: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Highest ``score`` of the candidates that overlap each window (both ends count), or null.

    No pair of rows is ever built. A candidate overlaps a window when it covers the window's start or
    starts inside the window. Both sides are tiled by power-of-two blocks and met on the block, after the
    scores of a block have been combined, so work grows with n log(length) whatever the overlap is.
    A row becomes one per level here, which Spark's size estimates leave out, so neither join may broadcast.
    ``windows`` is read several times: hand in a stored table.
    """
    block = [*keys, "level", "block"]
    spans = windows.select(*keys, "start_ms", "end_ms").distinct()
    cand = candidates.groupBy(*keys, "start_ms", "end_ms").agg(F.max(score).alias("_score"))
    covered = _tiles(cand, F.col("start_ms"), F.col("end_ms")).groupBy(*block).agg(F.max("_score").alias("_score"))
    at_start = _stabs(spans, "start_ms", _top_level(candidates)).hint("merge").join(covered, block)

    starts = _stabs(cand, "start_ms", _top_level(windows)).groupBy(*block).agg(F.max("_score").alias("_score"))
    inner = _tiles(spans.filter(F.col("end_ms") > F.col("start_ms")), F.col("start_ms") + 1, F.col("end_ms"))
    inside = inner.hint("merge").join(starts, block)

    cols = [*keys, "start_ms", "end_ms", "_score"]
    best = at_start.select(*cols).unionByName(inside.select(*cols))
    best = best.groupBy(*keys, "start_ms", "end_ms").agg(F.max("_score").alias(score))
    return windows.join(best, [*keys, "start_ms", "end_ms"], "left")


# ---------------------------------------------------------------- points and neighbours


def asof_neighbours(anchors: DataFrame, rows: DataFrame, keys: Sequence[str], t: str, row_id: str) -> DataFrame:
    """Per anchor time: the row strictly before, the row strictly after and the closest row.

    Of rows at one time the lowest id speaks; of two equally close rows the earlier one wins.
    """
    at = rows.groupBy(*keys, t).agg(F.min(row_id).alias("_row"))
    asked = anchors.select(*keys, t).distinct().withColumn("_ask", F.lit(True))
    times = at.join(asked, [*keys, t], "full").withColumn("_slab", _slab(t))
    mark = F.when(F.col("_row").isNotNull(), F.struct(F.col(t), F.col("_row")))
    sides = [Running("_before", mark), Running("_after", mark, F.min, reverse=True)]
    times = running(times, keys, "_slab", t, *sides)
    to_before = F.col(t) - F.col("_before")[t]
    to_after = F.col("_after")[t] - F.col(t)
    closest = (
        F.when(F.col("_row").isNotNull(), F.col("_row"))
        .when(to_after.isNull() | (to_before <= to_after), F.col("_before._row"))
        .otherwise(F.col("_after._row"))
    )
    gap = F.when(F.col("_row").isNotNull(), F.lit(0)).otherwise(F.least(to_before, to_after))
    return times.filter("_ask").select(
        *keys,
        t,
        F.col("_before._row").alias("before_id"),
        F.col("_after._row").alias("after_id"),
        closest.alias("closest_id"),
        gap.alias("closest_gap_ms"),
    )


def near_anchors(rows: DataFrame, anchors: DataFrame, keys: Sequence[str], t: str, window_ms: int) -> DataFrame:
    """Rows within ``window_ms`` of an anchor of their key; a key where none is that close keeps all rows."""
    marks = anchors.select(*keys, t).distinct().withColumn("_a", F.lit(True))
    times = rows.select(*keys, t).distinct().join(marks, [*keys, t], "full").withColumn("_slab", _slab(t))
    anchor_t = F.when(F.col("_a"), F.col(t))
    sides = [Running("_lo", anchor_t, inclusive=True), Running("_hi", anchor_t, F.min, inclusive=True, reverse=True)]
    times = running(times, keys, "_slab", t, *sides)
    times = times.withColumn("distance_ms", F.least(F.col(t) - F.col("_lo"), F.col("_hi") - F.col(t)))
    measured = rows.join(times.select(*keys, t, "distance_ms"), [*keys, t], "left")
    near = measured.withColumn("_near", F.coalesce(F.col("distance_ms") <= window_ms, F.lit(False)))
    alive = near.groupBy(*keys).agg(F.bool_or("_near").alias("_any"))
    kept = near.join(alive, list(keys)).filter(F.col("_near") | ~F.col("_any"))
    return kept.drop("_near", "_any")


def neighbour_sums(rows: DataFrame, keys: Sequence[str], t: str, value: str, reach_ms: int) -> DataFrame:
    """Per row: sum and count of ``value`` over the *other* rows of its key within ``reach_ms``."""
    at = rows.groupBy(*keys, t).agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    lo, hi = F.floor((F.col(t) - reach_ms) / F.lit(SLAB_MS)), F.floor((F.col(t) + reach_ms) / F.lit(SLAB_MS))
    spread = at.withColumn("_slab", F.explode(F.sequence(lo, hi)))
    near = Window.partitionBy(*keys, "_slab").orderBy(t).rangeBetween(-reach_ms, reach_ms)
    totals = spread.withColumns({"_sv": F.sum("_v").over(near), "_sn": F.sum("_n").over(near)})
    totals = totals.filter(F.col("_slab") == _slab(t)).select(*keys, t, "_sv", "_sn")
    joined = rows.join(totals, [*keys, t])
    return joined.withColumns(
        {"others_sum": F.col("_sv") - F.col(value), "others_n": F.col("_sn") - 1}
    ).drop("_sv", "_sn")


def neighbour_sums_within(rows: DataFrame, keys: Sequence[str], t: str, value: str, reach: str) -> DataFrame:
    """As ``neighbour_sums`` with the reach in ms taken from a column, through running totals at t ± reach."""
    at = rows.groupBy(*keys, t).agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    asked = rows.select(*keys, t, reach).distinct()
    ends = asked.select(*keys, F.explode(F.array(F.col(t) + F.col(reach), F.col(t) - F.col(reach) - 1)).alias(t))
    marks = ends.distinct().withColumn("_q", F.lit(True))
    times = at.join(marks, [*keys, t], "full").withColumn("_slab", _slab(t))
    totals_ = [Running(f"_c{n}", F.coalesce(F.col(n), F.lit(0)), F.sum, inclusive=True) for n in ("_v", "_n")]
    times = running(times, keys, "_slab", t, *totals_)
    totals = times.filter("_q").select(*keys, t, "_c_v", "_c_n")
    joined = rows.withColumns({"_hi": F.col(t) + F.col(reach), "_lo": F.col(t) - F.col(reach) - 1})
    for side in ("_hi", "_lo"):
        named = totals.select(*keys, F.col(t).alias(side), F.col("_c_v").alias(f"_v{side}"), F.col("_c_n").alias(f"_n{side}"))
        joined = joined.join(named, [*keys, side])
    return joined.withColumns(
        {
            "others_sum": F.col("_v_hi") - F.col("_v_lo") - F.col(value),
            "others_n": F.col("_n_hi") - F.col("_n_lo") - 1,
        }
    ).drop("_hi", "_lo", "_v_hi", "_v_lo", "_n_hi", "_n_lo")


def exact_medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median of whole-number ``value`` per key, from counts per value instead of a sorted group."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_slab", F.floor(F.col(value) / F.lit(100_000)))
    ranked = running(counts, keys, "_slab", value, Running("_below", F.col("_c"), F.sum))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    placed = ranked.join(totals, list(keys))
    lo = F.floor((F.col("_total") - 1) / F.lit(2))
    hi = F.floor(F.col("_total") / F.lit(2))
    holds = lambda p: (F.col("_below") <= p) & (p < F.col("_below") + F.col("_c"))
    return placed.groupBy(*keys).agg(
        ((F.max(F.when(holds(lo), F.col(value))) + F.max(F.when(holds(hi), F.col(value)))) / F.lit(2.0)).alias("median")
    )


# ---------------------------------------------------------------- windows


def fixed_windows(durations: DataFrame, width_ms: int, duration: str = "duration_ms") -> DataFrame:
    """Tile [0, duration) by ``width_ms`` (one second at least); zero duration gives one full tile."""
    w = max(1000, width_ms)
    last = F.greatest(F.lit(0), F.ceil(F.col(duration) / F.lit(w)) - 1)
    tiles = durations.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("idx") * w
    end = F.when(F.col(duration) > 0, F.least(F.col(duration), start + w)).otherwise(F.lit(w))
    return tiles.withColumns({"start_ms": start, "end_ms": F.greatest(start, end)})


def windows_for_points(
    points: DataFrame, durations: DataFrame, keys: Sequence[str], width_ms: int, radius: int, cap: int
) -> DataFrame:
    """Windows hit by points (a shared edge belongs to the earlier window) with ``radius`` neighbours.

    Distinct, earliest first, at most ``cap`` per key. Points after the end count for the last window.
    """
    last = F.greatest(F.lit(0), F.ceil(F.col("duration_ms") / F.lit(width_ms)) - 1)
    hit = F.ceil(F.col("t_ms") / F.lit(width_ms)) - 1
    hits = points.groupBy(*keys, F.greatest(F.lit(0), hit).alias("_i")).agg(F.count(F.lit(1)))
    placed = hits.join(durations, list(keys)).withColumn("_i", F.least(F.col("_i"), last))
    span = F.sequence(F.greatest(F.lit(0), F.col("_i") - radius), F.least(last, F.col("_i") + radius))
    picked = placed.withColumn("_last", last).select(*keys, F.explode(span).alias("idx")).distinct()
    return top_n(picked, keys, [F.col("idx")], cap, "pos").drop("pos") if cap > 0 else picked


def hop_scan(
    points: DataFrame, durations: DataFrame, keys: Sequence[str], score: str, threshold: float,
    width_ms: int = 2000, hop_ms: int = 1000,
) -> DataFrame:
    """Hopping windows whose best score reaches the threshold, merged. A window cut by the end is not scanned."""
    first = F.greatest(F.lit(0), F.floor((F.col("t_ms") - width_ms) / F.lit(hop_ms)) + 1)
    last = F.floor(F.col("t_ms") / F.lit(hop_ms))
    scored = points.withColumn("_o", F.explode(F.sequence(first, last)))
    scored = scored.groupBy(*keys, (F.col("_o") * hop_ms).alias("start_ms")).agg(F.max(score).alias(score))
    scored = scored.filter(F.col(score) >= threshold).withColumn("end_ms", F.col("start_ms") + width_ms)
    whole = scored.join(durations, list(keys)).filter(F.col("end_ms") <= F.col("duration_ms"))
    return merge_intervals(whole, keys, 0, {score: (score, "max")})


def segment_ngrams(segments: DataFrame, key: str = "transcript_id", longest: int = 4) -> DataFrame:
    """Runs of one to ``longest`` consecutive non-blank segments: text, first start, last end."""
    block = 1000
    texts = segments.filter(F.trim("text") != "").withColumn("text", F.trim("text"))
    placed = rank_rows(texts, [key], "seg_idx", "seg_idx", 100_000, out="_pos")
    home = F.floor((F.col("_pos") - 1) / F.lit(block))
    # The first rows of a block are lent to the block before, so runs may cross the border.
    lent = F.when(((F.col("_pos") - 1) % block < longest - 1) & (home > 0), F.array(home, home - 1))
    spread = placed.withColumn("_blk", F.explode(F.coalesce(lent, F.array(home))))
    w = Window.partitionBy(key, "_blk").orderBy("_pos")
    steps = {"t": "text", "s": "start_ms", "e": "end_ms"}
    ahead = {f"_{n}{k}": F.lead(c, k).over(w) for k in range(1, longest) for n, c in steps.items()}
    wide = spread.withColumns(ahead).filter(home == F.col("_blk"))

    def run(k: int) -> Column:
        texts_ = [F.col("text"), *[F.col(f"_t{i}") for i in range(1, k)]]
        starts = [F.col("start_ms"), *[F.col(f"_s{i}") for i in range(1, k)]]
        ends = [F.greatest("end_ms", "start_ms"), *[F.greatest(f"_e{i}", f"_s{i}") for i in range(1, k)]]
        whole = F.lit(True) if k == 1 else F.col(f"_t{k - 1}").isNotNull()
        made = F.struct(
            F.lit(k).alias("n_segments"),
            F.concat_ws(" ", *texts_).alias("text"),
            (F.least(*starts) if k > 1 else starts[0]).alias("start_ms"),
            (F.greatest(*ends) if k > 1 else ends[0]).alias("end_ms"),
        )
        return F.when(whole, made)

    runs = wide.select(key, "_pos", F.explode(F.array_compact(F.array(*[run(k) for k in range(1, longest + 1)]))).alias("r"))
    return runs.select(key, F.col("_pos").alias("first_pos"), "r.*")


def best_plateau(scored: DataFrame, keys: Sequence[str], score: str, unit: float = 1_000_000.0) -> DataFrame:
    """Centre row of the best score plateau per key.

    Rows within max(0.02, 3 %) of the best score form groups split at gaps over 1.25 s. Best group: highest
    mean, then size, then peak, then earliest. Its row nearest the median time is the centre.
    """
    peak = scored.groupBy(*keys).agg(F.max(score).alias("_peak"))
    margin = F.greatest(F.lit(0.02 * unit), F.col("_peak") * 0.03)
    high = scored.join(peak, list(keys)).filter(F.col("_peak") - F.col(score) <= margin).drop("_peak")
    points = high.withColumns({"start_ms": F.col("t_ms"), "end_ms": F.col("t_ms")})
    groups = merge_intervals(points, keys, 1250, {"_sum": (score, "sum"), "_top": (score, "max")})
    order = [-(F.col("_sum") / F.col("n")), -F.col("n"), -F.col("_top"), F.col("start_ms")]
    best = keep_first(groups, keys, order).select(
        *keys, F.col("start_ms").alias("_lo"), F.col("end_ms").alias("_hi"), F.col("n").alias("group_size")
    )
    members = high.join(best, list(keys)).filter(F.col("t_ms").between(F.col("_lo"), F.col("_hi")))
    middle = exact_medians(members, keys, "t_ms")
    near = members.join(middle, list(keys))
    order = [F.abs(F.col("t_ms") - F.col("median")), -F.col(score), F.col("t_ms"), F.col("seq")]
    return keep_first(near, keys, order).drop("_lo", "_hi")


def seconds(df):
    return df.withColumns({"start_s": to_s(F.col("start_ms")), "end_s": to_s(F.col("end_ms"))}).drop("start_ms", "end_ms")


def clips_from_intervals(intervals, fields):
    return seconds(merge_intervals(intervals, ["video_id"]).drop("n")).withColumns(fields)


def interval_distinct(pairs):
    """Intervals of one row in given order, ends sorted, repeats dropped, none merged."""
    lo = lambda p: F.least(F.coalesce(p["start_ms"], p["end_ms"]), F.coalesce(p["end_ms"], p["start_ms"]))
    hi = lambda p: F.greatest(F.coalesce(p["start_ms"], p["end_ms"]), F.coalesce(p["end_ms"], p["start_ms"]))
    return F.array_distinct(F.transform(pairs, lambda p: F.struct(lo(p).alias("start_ms"), hi(p).alias("end_ms"))))


def label_memory(rows):
    """Per label its time ranges (one row each), how often it is mentioned and by which modalities."""
    ranges = merge_intervals(rows, ["label"])
    facts = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("mentions"), F.array_join(F.sort_array(F.collect_set("modality")), ",").alias("modalities")
    )
    return ranges.join(facts, "label")


def timing_rollup(rows, value: str):
    """Count, mean, exact median, least and greatest recorded time per tool."""
    stats = rows.groupBy("tool").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(value) / F.count(F.lit(1)), 4).alias(f"mean_{value}"),
        F.min(value).alias(f"min_{value}"),
        F.max(value).alias(f"max_{value}"),
    )
    return stats.join(exact_medians(rows, ["tool"], value).withColumnRenamed("median", f"median_{value}"), "tool")
