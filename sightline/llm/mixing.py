"""Mixing sources along a time-varying curriculum.

A source's schedule is a piecewise linear weight over training time 0..1. Its integral is the source's weight in the
mix, and the inverse of its running integral places every taken document: the word in the middle of the document is
due when the source's running demand reaches it. Sources are read in a fixed pseudo-random order, again from the start
when their demand exceeds their size, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import documents, id_key, one_of_each, words_in
from sightline.session import materialize

#: Sources in order of code points take these weights in turn, each along a falling, an even and a rising schedule.
WEIGHTS = (3.0, 1.0, 2.0)
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
#: Hexadecimal digits of the order key that split a source's running sum into parts: 4096 parts.
PART_DIGITS = 3


def _schedule(weights: tuple[float, ...], shapes: tuple) -> list[list[tuple[float, float, float]]]:
    """Knots (time, weight, integral up to here) of each schedule, scaled so that the whole integral is the weight."""
    out = []
    for weight, knots in zip(weights, shapes, strict=True):
        done = [0.0]
        for (a, x), (b, y) in zip(knots, knots[1:], strict=False):
            done.append(done[-1] + (b - a) * (x + y) / 2)
        out.append([(t, w * weight / done[-1], c * weight / done[-1]) for (t, w), c in zip(knots, done, strict=True)])
    return out


def _knots(weights: tuple[float, ...], shapes: tuple) -> Column:
    def knot(t: float, w: float, c: float) -> Column:
        return F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(c).alias("c"))

    return F.array(*[F.array(*[knot(*k) for k in knots]) for knots in _schedule(weights, shapes)])


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, shapes: tuple = SHAPES) -> DataFrame:
    """From (source, source_size), one row per source: its knots, weight and target.

    The total is shared by weight, a target stops at `cap` times its size, and the excess is shared again among the
    others. In order of size per weight the capped sources come first, so one pass finds the level where that ends.
    This table has one row per source; its two windows read no documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    rows = sizes.withColumn("_turn", ((rank - 1) % len(weights)).cast("int"))
    rows = rows.withColumn("knots", _knots(weights, shapes)[F.col("_turn")]).withColumn("weight", F.array(*map(F.lit, weights))[F.col("_turn")])
    rows = rows.withColumn("_cap", F.col("source_size") * cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("_level", F.when(level <= F.col("_ratio"), level))
    rows = rows.withColumn("_level", F.first("_level", True).over(Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    fair = F.col("_level") * F.col("weight")
    target = F.when(F.col("_level").isNull() | (fair > F.col("_cap")), F.col("_cap")).otherwise(fair)
    return rows.select("source", "source_size", "weight", "knots", target.alias("target"))


def _time_of(demand: Column, knots: Column) -> Column:
    """The time at which the running integral of the schedule reaches `demand`: the root in the last knot's piece."""
    at = F.element_at(F.filter(knots, lambda k: k["c"] <= demand), -1)
    following = F.filter(knots, lambda k: k["c"] > demand)
    nxt = F.get(following, F.lit(0))
    rest = demand - at["c"]
    slope = (nxt["w"] - at["w"]) / (nxt["t"] - at["t"])
    root = 2 * rest / (at["w"] + F.sqrt(at["w"] * at["w"] + 2 * slope * rest))
    return F.when(F.size(following) == 0, F.element_at(knots, -1)["t"]).otherwise(at["t"] + F.coalesce(root, F.lit(0.0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, shapes: tuple = SHAPES) -> DataFrame:
    """One row per taken pass of a document (one with nulls for a document that is not taken).

    Columns: doc_id, text_hash, row_key (of the document, unique), size, source, source_size, target, pass (from 0),
    position (0..1). A null text has size 0, a null source is a source of its own, and every repeated row is a document.
    A document is taken in a pass when its middle word lies before the source's target, so the taken words of a source
    miss the target by half a document at most. Running sums go in two levels: parts of a source, then rows of a part.
    """
    rows = documents(docs, id_col, text_col, source=source_col)
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), order.alias("_order"))
    rows = materialize(rows.withColumn("_part", F.substring("_order", 1, PART_DIGITS)), "mix-sizes")
    parts = rows.groupBy("source", "_part").agg(F.sum("size").alias("_part_size"))
    parts = materialize(parts, "mix-parts")
    targets = source_targets(parts.groupBy("source").agg(F.sum("_part_size").alias("source_size")), share, cap, weights, shapes)
    targets = materialize(targets, "mix-targets")
    ahead = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("_source"), F.col("_part").alias("_of"), F.coalesce(F.sum("_part_size").over(ahead), F.lit(0)).alias("_ahead"))
    parts = parts.join(targets.withColumnRenamed("source", "_t"), F.col("_source").eqNullSafe(F.col("_t"))).drop("_t")
    within = Window.partitionBy("source", "_part").orderBy("_order", "doc_id", "text_hash", "size")
    rows = rows.withColumn("_nth", F.row_number().over(within)).withColumn("_within", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_of")))
    middle = F.col("_ahead") + F.coalesce("_within", F.lit(0)) + F.col("size") / 2
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - whole * F.col("source_size")
    passes = F.when(F.col("source_size") > 0, whole + ((whole < cap) & (F.col("size") > 0) & (middle <= rest)).cast("long")).otherwise(0)
    rows = rows.withColumn("_middle", middle).withColumn("_passes", passes.cast("int"))
    rows = rows.withColumn("pass", F.explode_outer(F.when(F.col("_passes") > 0, F.sequence(F.lit(0), F.col("_passes") - 1))))
    demand = F.least((F.col("pass") * F.col("source_size") + F.col("_middle")) / F.col("target"), F.lit(1.0)) * F.col("weight")
    position = F.when(F.col("pass").isNotNull(), _time_of(demand, F.col("knots")))
    key = F.concat_ws("|", F.coalesce(F.col("source"), F.lit("\x00")), "_part", F.col("_nth").cast("string"))
    return rows.select("doc_id", "text_hash", key.alias("row_key"), "size", "source", "source_size", "target", "pass", position.alias("position"))


def in_training_order(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-sort taken passes by position; equal positions are ordered by id, so a hot position cannot fill a task."""
    keys = ["position", "doc_id", "pass"]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as the mix takes them and in training order.

    Rows that repeat an id and its text are one kind of document here: each of their passes is one of them.
    """
    taken = mix(docs, id_col, text_col, **options).filter("position IS NOT NULL")
    key = ["_id_key", "_text_hash"]
    taken = taken.groupBy(id_key(F.col("doc_id")).alias("_id_key"), F.col("text_hash").alias("_text_hash")).agg(F.collect_list(F.struct("position", "pass")).alias("_passes"))
    rows = one_of_each(docs.withColumn("_id_key", id_key(F.col(id_col))).withColumn("_text_hash", F.xxhash64(text_col)), key)
    rows = rows.join(taken, key).withColumn("_pass", F.explode("_passes")).select(*docs.columns, F.col("_pass.position").alias("_position"), F.col("_pass.pass").alias("_nth_pass"))
    # The range sort samples its input, so the join before it is written once rather than run twice.
    rows = materialize(rows, "mixed")
    keys = ["_position", id_col, "_nth_pass"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_position", "_nth_pass")
