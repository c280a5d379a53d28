"""Run folder trees and other file trees as tables.

A tree ``<root>/<video>/<run>/round_NN/[tools/<tool>/]<file>`` is listed level by level: a data source lists the run folders,
a few to a partition, and each further level is a column of the folder's entries, exploded. So Catalyst puts a filter
on run, round, tool or name in front of the listing below it, and where the content is not asked for no file is opened.
``file_tree`` writes rows (path, content) as files. Paths go through Arrow's file systems, so any store these know can
hold a tree.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType

from sightline.session import materialize

#: Run folders of one partition at least, and partitions for every core: each costs a start of all levels' workers.
FOLDERS, WAVES = 16, 8
#: Paths that a worker lists, and bytes of content that it reads, before it hands them on.
PATHS, SLICE = 500, 1 << 23


def filesystem(path: str):
    """Arrow's file system of a path or URI, and the path inside it."""
    from pyarrow import fs

    if re.match(r"file:/", path):
        path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def entries(path: str) -> list:
    """(name, path, length) of what a folder holds, by name, length null for a folder; nothing where it is missing.

    Paths keep the form they are asked in, so a URI's entries are URIs.
    """
    from pyarrow import fs

    store, inside = filesystem(path)
    found = store.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    return sorted((e.base_name, f"{path.rstrip('/')}/{e.base_name}", e.size if e.is_file else None) for e in found)


def _folders(path: str) -> list:
    return [(name, at) for name, at, length in entries(path) if length is None]


@dataclass
class RunPartition(InputPartition):
    runs: tuple

    def __post_init__(self) -> None:
        super().__init__(self.runs)


class RunReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.folders, self.tasks = options["path"].rstrip("/"), int(options.get("folders", 0)), int(options.get("tasks", 1))

    def partitions(self) -> list[RunPartition]:
        runs = [(f"{video}/{run}", at) for video, folder in _folders(self.root) for run, at in _folders(folder)]
        few = self.folders or max(FOLDERS, -(-len(runs) // self.tasks))
        return [RunPartition(tuple(runs[i : i + few])) for i in range(0, len(runs), few)] or [RunPartition(())]

    def read(self, partition: RunPartition) -> Iterator[tuple]:
        return iter(partition.runs)


class RunFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_folders"

    def schema(self) -> str:
        return "run string, at string"

    def reader(self, schema) -> DataSourceReader:
        return RunReader(dict(self.options))


class TreeWriter(DataSourceWriter):
    """Writes every row under its path below the root; a file appears whole or not at all, so a repeated task changes nothing."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = filesystem(self.root)
        made = set()
        for row in iterator:
            at = f"{root}/{row['path'].lstrip('/')}"
            folder = posixpath.dirname(at)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                if len(made) >= PATHS:
                    made.clear()
                made.add(folder)
            content = row["content"]
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            store.move(draft, at)
        return WriterCommitMessage()


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(dict(self.options))


def write_tree(files: DataFrame, root: str) -> None:
    """Rows (path below the root, content as text or bytes) as files; of rows with one path the last written stays whole."""
    files.sparkSession.dataSource.register(FileTree)
    files.select("path", "content").write.format("file_tree").mode("append").save(root)


_ROUNDS = "array<struct<round:int,folder:string>>"
_TOOLS = "array<struct<tool:string,folder:string>>"
_FILES = "array<struct<name:string,path:string,length:bigint>>"


def _listed(schema: str, listing):
    """Column function: what `listing` gives for each path, as an array of structs."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        fields = [part.split(":") for part in schema[len("array<struct<") : -2].split(",")]
        kind = pa.list_(pa.struct([(name, kinds[k]) for name, k in fields]))
        names = [name for name, _ in fields]
        for paths in batches:
            for at in range(0, len(paths), PATHS):
                yield pa.array([[dict(zip(names, found, strict=True)) for found in listing(path)] for path in paths[at : at + PATHS].to_pylist()], kind)

    return F.arrow_udf(run, schema)


def _rounds(folder: str) -> list:
    found = ((re.fullmatch(r"round_(\d+)", name), at) for name, at in _folders(folder))
    return [(int(number[1]), at) for number, at in found if number]


def _tools(folder: str) -> list:
    """The round's own folder (tool null), then its tools' folders."""
    return [(None, folder), *_folders(f"{folder}/tools")]


def _files(folder: str) -> list:
    return [e for e in entries(folder) if e[2] is not None]


@F.arrow_udf(StringType())
def _content(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def read(path: str) -> str:
        store, inside = filesystem(path)
        with store.open_input_stream(inside) as file:
            return file.read().decode()

    for paths in batches:
        held, size = [], 0
        for path in paths.to_pylist():
            held.append(None if path is None else read(path))
            size += len(held[-1] or "")
            if size >= SLICE:
                yield pa.array(held, pa.string())
                held, size = [], 0
        if held:
            yield pa.array(held, pa.string())


def run_folders(spark: SparkSession, root: str, folders: int | None = None) -> DataFrame:
    """Files of all rounds and tools of run folders: run (``video/run``), round, tool (null beside the tools), name, path, length, relpath, content.

    A partition holds `folders` run folders; without a number as many as give every core a few partitions.
    """
    spark.dataSource.register(RunFolders)
    tasks = WAVES * spark.sparkContext.defaultParallelism
    rows = spark.read.format("run_folders").option("folders", str(folders or 0)).option("tasks", str(tasks)).load(root)
    rows = rows.select("*", F.explode(_listed(_ROUNDS, _rounds)("at")).alias("_r")).select("run", "at", "_r.round", "_r.folder")
    rows = rows.select("*", F.explode(_listed(_TOOLS, _tools)("folder")).alias("_t")).select("run", "at", "round", "_t.tool", F.col("_t.folder").alias("folder"))
    rows = rows.select("*", F.explode(_listed(_FILES, _files)("folder")).alias("_f")).select("run", "at", "round", "tool", "_f.name", "_f.path", "_f.length")
    relpath = F.substring("path", F.length("at") + 2, F.length("path")).alias("relpath")
    return rows.select("run", "round", "tool", "name", "path", "length", relpath, _content("path").alias("content"))


def _found(batches: Iterator) -> Iterator:
    """What folders (path) hold: (path, length), length null for a folder. Names that Spark's readers pass over are left out."""
    for batch in batches:
        for folder in batch["path"].to_pylist():
            found = [e for e in entries(folder) if not (e[0].startswith(".") or e[0].startswith("_") and "=" not in e[0])]
            for at in range(0, len(found), PATHS):
                some = found[at : at + PATHS]
                yield pa.RecordBatch.from_arrays([pa.array([e[1] for e in some], pa.string()), pa.array([e[2] for e in some], pa.int64())], ["path", "length"])


def tree_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder or glob as (path, length), empty ones too.

    Levels are listed one after the other by the executors and written, so the driver holds only what a glob itself
    matches, and a worker one folder's entries. A path that leads nowhere is an error.
    """
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    matched = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(store)
    if matched is None or not len(matched):
        raise FileNotFoundError(path)
    kind = "path string, length long"
    given = spark.createDataFrame([(m.getPath().toString(), m.getLen() if m.isFile() else None) for m in matched], kind)
    levels, tasks = [given], WAVES * spark.sparkContext.defaultParallelism
    while n := (folders := levels[-1].filter("length IS NULL")).count():
        levels.append(materialize(folders.repartition(min(n, tasks), "path").mapInArrow(_found, kind), "listing"))
    files = levels[0]
    for more in levels[1:]:
        files = files.union(more)
    return files.filter("length IS NOT NULL")


def edge_fingerprints(listed: DataFrame, edge: int = 1 << 20) -> DataFrame:
    """(path, length, fingerprint): SHA-256 of the length, the first and the last `edge` bytes of every listed file.

    Only the two ends are read, so a file may be of any size; shorter files than two edges are read once. The rule is
    that of ``fingerprint`` for a value held in a row.
    """

    def run(batches: Iterator) -> Iterator:
        import hashlib

        for batch in batches:
            found = []
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                store, inside = filesystem(path)
                digest = hashlib.sha256(str(length).encode())
                with store.open_input_file(inside) as file:
                    digest.update(file.read_at(min(edge, length), 0))
                    start = max(edge, length - edge)
                    if start < length:
                        digest.update(file.read_at(length - start, start))
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], pa.array(found, pa.string())], ["path", "length", "fingerprint"])

    # Files are dealt anew, as a folder's files stand in one partition of the listing.
    tasks = WAVES * listed.sparkSession.sparkContext.defaultParallelism
    return listed.select("path", "length").repartition(tasks, "path").mapInArrow(run, "path string, length long, fingerprint string")
