"""Connected components over DataFrames by hooking and contraction.

In each round every root with a smaller neighbour hooks to the smallest one, chains of hooks are followed to their ends,
and the edges are rewritten between the roots that are left; equal and inner edges vanish, so each round works on what
the one before has not settled. A node is hooked once in all rounds, so its root is one look-up in the union of them.
Joins by root are salted: many edges may share one, but the hooks on the other side have a row per root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import all_salts, salted
from sightline.session import materialize


def _moved(rows: DataFrame, column: str, hooks: DataFrame, salts: int) -> DataFrame:
    """`rows` with `column` replaced by what it is hooked to, where it is."""
    target = all_salts(hooks, salts).select(F.col("root").alias("_root"), F.col("to").alias("_to"), F.col("_salt").alias("_salt2"))
    rows = salted(rows, F.xxhash64(*rows.columns), salts)
    rows = rows.join(target, (F.col(column) == F.col("_root")) & (F.col("_salt") == F.col("_salt2")), "left")
    return rows.withColumn(column, F.coalesce("_to", column)).drop("_root", "_to", "_salt", "_salt2")


def connected_components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """(id, label): every node of `edges` (a, b) with the smallest id it can reach. Nodes without an edge to another are left out."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    nodes = live = materialize(pairs.distinct(), "edges")
    rounds: list[DataFrame] = []
    while live.limit(1).count():
        hooks = materialize(live.groupBy(F.col("high").alias("root")).agg(F.min("low").alias("to")), "hooks")
        while True:
            further = materialize(_moved(hooks.withColumn("before", F.col("to")), "to", hooks, salts), "hooks")
            moved = further.filter(F.col("to") != F.col("before")).limit(1).count()
            hooks = further.select("root", "to")
            if not moved:
                break
        # Ends of this round may be hooked in this round only, so earlier rounds follow by the same look-up.
        rounds = [materialize(_moved(h, "to", hooks, salts), "roots") for h in rounds] + [hooks]
        ends = _moved(_moved(live, "high", hooks, salts), "low", hooks, salts).filter(F.col("high") != F.col("low"))
        live = materialize(ends.select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct(), "edges")
    ids = nodes.select(F.col("high").alias("id")).union(nodes.select("low")).distinct()
    if not rounds:
        return ids.withColumn("label", F.col("id"))
    hooked = rounds[0]
    for more in rounds[1:]:
        hooked = hooked.union(more)
    return ids.join(hooked, ids["id"] == hooked["root"], "left").select("id", F.coalesce("to", "id").alias("label"))
