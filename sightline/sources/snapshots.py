"""A ledger table of snapshots: readers keep the one they opened, a commit adds one small manifest.

Rows lie in folders by partition value, and an index (key -> partition value) in folders by hash of the key. A manifest
names the folder of every partition value and of every index bucket. An upsert writes new folders for what it touches,
found through the index, and then the next manifest; until that is complete nothing has changed, whatever was written.
One writer at a time is assumed: a second one that has read the same snapshot fails at its commit.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.operators.core import keep_last
from sightline.operators.ledger import upsert
from sightline.session import materialize

#: Buckets of the index of keys.
BUCKETS = 16
_MANIFEST = "kind string, value string, folder string"


class Ledger:
    """Rows by id at ``root``; of rows with one id the highest ``version`` stays, whichever ``partition`` value it has."""

    def __init__(self, spark: SparkSession, root: str, key: str, version: str, partition: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.version, self.partition, self.buckets = spark, root.rstrip("/"), key, version, partition, buckets

    def snapshots(self) -> list[int]:
        """Numbers of the complete snapshots; a manifest without its success marker is none."""
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(f"{self.root}/snapshots/*/_SUCCESS")
        statuses = found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
        return sorted(int(s.getPath().getParent().getName()) for s in statuses or [])

    def _manifest(self, snapshot: int | None) -> dict[str, dict]:
        known = self.snapshots()
        snapshot = known[-1] if snapshot is None and known else snapshot
        out: dict[str, dict] = {"schema": {}, "rows": {}, "index": {}}
        if snapshot is not None:
            for row in self.spark.read.schema(_MANIFEST).json(f"{self.root}/snapshots/{snapshot:010d}").collect():
                out[row["kind"]][row["value"]] = row["folder"]
        return out | {"number": snapshot or 0}

    def _read(self, folders: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, snapshot: int | None = None) -> DataFrame:
        """The rows of a snapshot, the latest by default; later commits do not change it."""
        manifest = self._manifest(snapshot)
        if not manifest["schema"]:
            raise ValueError(f"no snapshot {'at all' if snapshot is None else snapshot} at {self.root}")
        return self._read(sorted(manifest["rows"].values()), StructType.fromJson(json.loads(manifest["schema"]["rows"])))

    def _write(self, rows: DataFrame, by: str, kind: str) -> dict[str, str]:
        """Rows in a folder for each value of ``by`` (a text); the folders."""
        root = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        # Folders are named by a digest, so that any text may be a value.
        rows.withColumn("_folder", F.md5(by)).write.partitionBy("_folder").parquet(root)
        values = self.spark.read.schema(f"{by} string").parquet(root).distinct().collect()
        return {r[by]: f"{root}/_folder={hashlib.md5(r[by].encode()).hexdigest()}" for r in values}

    def upsert(self, incoming: DataFrame) -> int:
        """Insert or replace rows by id; an id that changes its partition value leaves the old one. The new snapshot's number."""
        manifest = self._manifest(None)
        key, value = self.key, F.coalesce(F.concat(F.lit("="), F.col(self.partition).cast("string")), F.lit("null")).alias("_value")
        schema = StructType.fromJson(json.loads(manifest["schema"]["rows"])) if manifest["schema"] else incoming.schema
        new = materialize(keep_last(incoming, [key], [self.version]), "incoming")
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("string").alias("_bucket")
        index_schema = StructType().add(key, schema[key].dataType).add("_value", "string")
        asked = sorted(r["_bucket"] for r in new.select(bucket).distinct().collect())
        index = self._read([manifest["index"][b] for b in asked if b in manifest["index"]], index_schema)
        # Values rows come to, and values their ids have been under: as many as there are partitions at most.
        moved = index.join(new.select(key), key, "left_semi")
        touched = {r["_value"] for r in new.select(value).union(moved.select("_value")).distinct().collect()}
        current = self._read([at for v, at in manifest["rows"].items() if v in touched], schema)
        merged = upsert(current, new, key, self.version)
        schema = merged.schema
        rows = {v: at for v, at in manifest["rows"].items() if v not in touched} | self._write(merged.withColumn("_value", value), "_value", "rows")
        # The index of asked buckets: what is not asked for stays, asked ids are where they are now.
        placed = self._read([at for v, at in rows.items() if v in touched], schema).select(key, value).join(new.select(key), key, "left_semi")
        kept = index.join(new.select(key), key, "left_anti").select(key, "_value")
        entries = self._write(kept.union(placed).withColumn("_bucket", bucket), "_bucket", "index")
        lines = [("schema", "rows", json.dumps(schema.jsonValue()))] + [("rows", v, at) for v, at in rows.items()]
        lines += [("index", b, at) for b, at in ({b: at for b, at in manifest["index"].items() if b not in asked} | entries).items()]
        number = manifest["number"] + 1
        self._commit(self.spark.createDataFrame(lines, _MANIFEST), number)
        return number

    def _commit(self, lines: DataFrame, number: int) -> None:
        lines.coalesce(1).write.mode("errorifexists").json(f"{self.root}/snapshots/{number:010d}")
