"""Set operations on tables and list columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sightline.functions import text
from sightline.operators.core import keep_first


def union_observations(parts):
    """Observation tables of all tools under one schema; what a tool does not give is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def concat_lists(lists):
    """Lists of several sources in order, repeats kept; a missing list counts as empty."""
    return F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])


def distinct_list(items, ordered: bool = False):
    """Distinct items in given order, or sorted (ids and texts)."""
    unique = F.array_distinct(items)
    return F.array_sort(unique) if ordered else unique


def id_sets(left, right, key: str):
    """Union of two id tables with what each side holds."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, key, "full")
    return both.fillna(False, ["in_left", "in_right"])


def context_texts(lists, key: str):
    """Texts of several media lists in their fixed order, once each, with the place (list, pos, sub) where they first appear."""
    tagged = [
        df.withColumn("place", F.struct(F.lit(i).alias("list"), F.col("pos").cast("long").alias("pos"), (F.col("sub") if "sub" in df.columns else F.lit(0)).cast("long").alias("sub"))).select(key, "text", "place")
        for i, df in enumerate(lists)
    ]
    texts = union_observations(tagged).withColumn("text", text.strip(F.col("text"))).filter("text <> ''")
    return keep_first(texts.select(key, "text", "place"), [key, "text"], ["place"])
