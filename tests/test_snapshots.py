"""The snapshot ledger against a dictionary; writers that stop halfway; readers that stay with their snapshot."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sightline.session import work_path
from sightline.sources.snapshots import Ledger

SCHEMA = "id string, v long, s string, p int"


def ledger(spark, **options):
    return Ledger(spark, work_path(spark, "snapshots"), "id", "v", "p", **options)


def rows_of(df):
    return sorted((r["id"], r["v"], r["s"], r["p"]) for r in df.collect())


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_equals_a_dictionary(spark):
    rng, table, held = random.Random(8), ledger(spark, buckets=4), {}
    for commit in range(5):
        data = [(f"k{rng.randint(0, 60)}", rng.randint(0, 100), f"{commit}/{i}", rng.choice([0, 1, 2, 3, None])) for i in range(40)]
        data = list({(r[0], r[1]): r for r in data}.values())  # one row for an id and version
        data = [r for r in data if (r[0], r[1]) not in {(k, x[1]) for k, x in held.items()}]
        assert table.upsert(rows(spark, data)) == commit + 1
        for r in data:
            if r[0] not in held or r[1] > held[r[0]][1]:
                held[r[0]] = r
        assert sorted(table.read().collect(), key=lambda r: r["id"]) == sorted(held.values(), key=lambda r: r[0])
    assert table.snapshots() == [1, 2, 3, 4, 5]


def test_an_id_that_moves_leaves_its_old_partition(spark):
    table = ledger(spark)
    table.upsert(rows(spark, [("a", 1, "x", 0), ("b", 1, "y", 0), ("c", 1, "z", 1)]))
    before = table._manifest(None)["rows"]
    table.upsert(rows(spark, [("a", 2, "moved", 1)]))
    assert rows_of(table.read()) == [("a", 2, "moved", 1), ("b", 1, "y", 0), ("c", 1, "z", 1)]
    table.upsert(rows(spark, [("b", 2, "moved", 2), ("a", 1, "late", 0)]))
    assert rows_of(table.read()) == [("a", 2, "moved", 1), ("b", 2, "moved", 2), ("c", 1, "z", 1)]
    after = table._manifest(None)["rows"]
    assert set(before) == {"=0", "=1"} and set(after) == {"=1", "=2"}


def test_untouched_partitions_are_not_rewritten(spark):
    table = ledger(spark)
    table.upsert(rows(spark, [(f"k{i}", 1, "x", i % 5) for i in range(50)]))
    before = table._manifest(None)["rows"]
    table.upsert(rows(spark, [("k3", 2, "y", 3), ("new", 1, "y", 3)]))
    after = table._manifest(None)["rows"]
    assert {v for v in after if after[v] != before.get(v)} == {"=3"}


def test_a_writer_that_stops_changes_nothing(spark, monkeypatch):
    table = ledger(spark)
    table.upsert(rows(spark, [("a", 1, "x", 0), ("b", 1, "y", 1)]))
    seen = rows_of(table.read())

    def stopped(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_commit", stopped)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(rows(spark, [("a", 2, "new", 1), ("c", 1, "new", 0)]))
    monkeypatch.undo()
    assert rows_of(table.read()) == seen and table.snapshots() == [1]
    table.upsert(rows(spark, [("a", 2, "new", 1)]))
    assert rows_of(table.read()) == [("a", 2, "new", 1), ("b", 1, "y", 1)]


def test_a_reader_keeps_its_snapshot(spark):
    table = ledger(spark)
    table.upsert(rows(spark, [("a", 1, "x", 0)]))
    opened = table.read()
    table.upsert(rows(spark, [("a", 2, "y", 1)]))
    assert rows_of(opened) == rows_of(table.read(1)) == [("a", 1, "x", 0)] and rows_of(table.read()) == [("a", 2, "y", 1)]


def test_two_writers_of_one_snapshot(spark):
    table = ledger(spark)
    table.upsert(rows(spark, [("a", 1, "x", 0)]))
    other = Ledger(spark, table.root, "id", "v", "p")
    stale = other._manifest(None)
    table.upsert(rows(spark, [("a", 2, "y", 0)]))
    other._manifest = lambda snapshot: stale
    with pytest.raises(Exception, match="(?i)exists"):
        other.upsert(rows(spark, [("a", 3, "z", 0)]))
    assert rows_of(table.read()) == [("a", 2, "y", 0)]


def test_new_columns_and_nothing_yet(spark):
    table = ledger(spark)
    with pytest.raises(ValueError, match="no snapshot"):
        table.read()
    table.upsert(rows(spark, []))
    assert table.read().count() == 0
    table.upsert(rows(spark, [("a", 1, "x", 0)]))
    table.upsert(rows(spark, [("b", 1, "x", 0)]).withColumn("more", F.lit(1)))
    assert {(r["id"], r["more"]) for r in table.read().collect()} == {("a", None), ("b", 1)}
