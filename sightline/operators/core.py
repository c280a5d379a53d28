"""Skew-safe building blocks shared by every operator.

Rules kept here so that one key may hold a third of all rows:

* one row per key  -> ``min_by``/``max_by`` aggregates (combined on the map side), never a full-group sort;
* first n per key  -> ``row_number() <= n`` right next to the filter, which Spark turns into a
  window group limit that cuts every map task to n rows per key before the shuffle;
* running values   -> two levels: a window inside (key, slab), plus one summary row per slab.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import materialize

Keys = Sequence[str]


def _order_struct(order: Sequence[str | Column]) -> Column:
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    return cols[0] if len(cols) == 1 else F.struct(*cols)


def _pick(df: DataFrame, keys: Keys, order: Sequence[str | Column], pick: Callable) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), _order_struct(order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: Keys, order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one that comes first in ``order``."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Keys, order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one that comes last in ``order``."""
    return _pick(df, keys, order, F.max_by)


class Split(tuple):
    """(kept, rejected), and ``flagged``: all rows in one pass, with ``valid``."""

    flagged: DataFrame


def split_by(df: DataFrame, good: Column) -> Split:
    valid = F.coalesce(good, F.lit(False))
    both = Split((df.filter(valid), df.filter(~valid)))
    both.flagged = df.withColumn("valid", valid)
    return both


def top_n(df: DataFrame, keys: Keys, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key in ``order``, with their 1-based rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


@dataclass(frozen=True)
class Running:
    """One running value: ``fn`` (max, min or sum) of ``value`` over the rows before, or after if reversed."""

    out: str
    value: Column
    fn: Callable[[Column], Column] = F.max
    inclusive: bool = False
    reverse: bool = False


def running(df: DataFrame, keys: Keys, slab: str, order: str, *wanted: Running) -> DataFrame:
    """Running values per key in ``order`` without putting a whole key into one task.

    ``slab`` must rise with ``order`` and hold a bounded number of rows; the second level sees one row
    per slab. All wanted values share one pass over the rows and one join with the slab summaries.
    """
    valued = df.withColumns({f"_v{i}": r.value for i, r in enumerate(wanted)})
    sums = valued.groupBy(*keys, slab).agg(*[r.fn(F.col(f"_v{i}")).alias(f"_s{i}") for i, r in enumerate(wanted)])
    local, upper = {}, {}
    for i, r in enumerate(wanted):
        way = F.desc if r.reverse else F.asc
        inside = Window.partitionBy(*keys, slab).orderBy(way(order))
        above = Window.partitionBy(*keys).orderBy(way(slab)).rowsBetween(Window.unboundedPreceding, -1)
        local[f"_h{i}"] = r.fn(F.col(f"_v{i}")).over(inside.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1))
        upper[f"_c{i}"] = r.fn(F.col(f"_s{i}")).over(above)
    carried = sums.withColumns(upper).drop(*[f"_s{i}" for i in range(len(wanted))])
    joined = valued.withColumns(local).join(carried, [*keys, slab], "left")
    both = {}
    for i, r in enumerate(wanted):
        here, carry = F.col(f"_h{i}"), F.col(f"_c{i}")
        if r.fn is F.sum:
            both[r.out] = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        else:
            both[r.out] = (F.greatest if r.fn is F.max else F.least)(here, carry)
    return joined.select(*df.columns, *[c.alias(n) for n, c in both.items()])


def rank_rows(
    df: DataFrame,
    keys: Keys,
    order: str,
    tie: str,
    slab_width: int,
    tie_block: int = 1_000_000,
    out: str = "rank",
    last: Sequence[str] = (),
) -> DataFrame:
    """1-based position of every row per key by (``order``, ``tie``), both whole numbers, then by ``last``.

    Three levels keep each window small: slabs of ``order``, equal ``order`` values, blocks of ``tie``.
    """
    blocked = df.withColumn("_blk", F.floor(F.col(tie) / F.lit(tie_block)))
    counts = blocked.groupBy(*keys, order, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    per_value = counts.groupBy(*keys, order).agg(F.sum("_n").alias("_n"))
    per_value = per_value.withColumn("_slab", F.floor(F.col(order) / F.lit(slab_width)))
    per_value = running(per_value, keys, "_slab", order, Running("_base", F.col("_n"), F.sum)).drop("_slab", "_n")
    before = Window.partitionBy(*keys, order).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(per_value, [*keys, order])
        .select(*keys, order, "_blk", (F.col("_off") + F.col("_base")).alias("_off"))
    )
    local = Window.partitionBy(*keys, order, "_blk").orderBy(tie, *last)
    numbered = blocked.withColumn("_rn", F.row_number().over(local))
    return (
        numbered.join(offsets, [*keys, order, "_blk"])
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("long"))
        .select(*df.columns, out)
    )


def global_rank(df: DataFrame, keys: Keys, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based position of every row per key in any order, however many rows a key or an order value has.

    Rows are dealt by ranges of (key, order), so a large key goes over many tasks. A row's position is its place in its
    range partition less the key's first place there, plus the key's rows in the partitions before: one row per key and
    partition it reaches into. The dealt rows are written, so their places never change.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(dealt, "dealt").withColumn("_range", F.shiftright("_at", 33))
    parts = rows.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    on = F.col("_range") == F.col("_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(offsets, on).select(*df.columns, (F.col("_at") + F.col("_offset")).alias(out))


def ordered_list(value: Column, *order: Column) -> Column:
    """Aggregate: values of a bounded group as an array in ``order``."""
    packed = F.sort_array(F.collect_list(F.struct(*order, value.alias("_value"))))
    return F.transform(packed, lambda s: s["_value"])


def ordered_text(value: Column, sep: str, *order: Column) -> Column:
    return F.array_join(ordered_list(value, *order), sep)
