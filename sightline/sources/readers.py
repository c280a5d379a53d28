"""Readers: JSON Lines, JSON documents, task lists, run folders, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import text
from sightline.functions.ids import sample_key
from sightline.functions.text import blank_to_null, letter_options, strip
from sightline.operators.core import ordered_list
from sightline.sources import folders


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path or glob names at least one file."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines. Blank lines are skipped, a missing path is an empty table, a broken line is an error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per file, an object or an array of objects; ``.jsonl`` files are read by line."""
    if path.rstrip("*/").endswith(".jsonl"):
        return scan_jsonl(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Files under a glob as (path, content), one row per file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder or glob as (path, length), empty ones too; no content is read, and the driver lists no folder."""
    return folders.tree_files(spark, path)


# ---------------------------------------------------------------- task lists

CHOICE_TASK = (
    "video_id string, question string, key string, answer string, answer_id string, reasoning string, "
    "answer_choice_0 string, answer_choice_1 string, answer_choice_2 string, answer_choice_3 string, answer_choice_4 string"
)
PLAIN_TASK = "videoID string, question string, question_id string, options array<string>, answer string, steps string"
ALIAS_TASK = (
    "video_path string, video string, video_file string, video_name string, question string, question_id string, "
    "options array<string>, answer string, initial_trace_steps string"
)
INPUT_TASK = (
    "benchmark string, sample_key string, video_path string, video_id string, question string, question_id string, "
    "options array<string>, gold_answer string, answer string, initial_trace_steps string, steps string, reasoning string"
)


def _video_file(videos: str, name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat(F.lit(videos.rstrip("/") + "/"), name))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def _task(df: DataFrame, **cols: Column) -> DataFrame:
    """Common task columns; rows without a video or a question are no tasks."""
    named = df.select(*[c.alias(n) for n, c in cols.items()])
    named = named.filter((strip(F.coalesce("video_path", F.lit(""))) != "") & (strip(F.coalesce("question", F.lit(""))) != ""))
    key = F.coalesce(blank_to_null(F.col("given_key")) if "given_key" in cols else F.lit(None), sample_key(F.col("video_path"), F.col("question"), F.col("question_id")))
    return named.withColumn("sample_key", key).drop("given_key")


def tasks_by_choice(items: DataFrame, benchmark: str, videos: str) -> DataFrame:
    """Items with answer_choice_0..4. The key falls back to ``video:question hash``; gold is text, else index."""
    choices = F.array(*[F.coalesce(f"answer_choice_{i}", F.lit("")) for i in range(5)])
    options = letter_options(choices, F.coalesce(F.col("answer_id").try_cast("int"), F.lit(-1)))
    video = blank_to_null(F.col("video_id"))
    # A list position is no stable key on a cluster, so the fallback key comes from the question.
    key = F.coalesce(blank_to_null(F.col("key")), F.concat_ws(":", video, F.substring(F.sha2("question", 256), 1, 12)))
    return _task(
        items.withColumn("_o", options),
        benchmark=F.lit(benchmark),
        video_id=video,
        video_path=F.concat(F.lit(videos.rstrip("/") + "/"), video, F.lit(".mp4")),
        question=strip(F.col("question")),
        question_id=key,
        options=F.col("_o.options"),
        gold_answer=F.coalesce(blank_to_null(F.col("answer")), F.col("_o.gold")),
        initial_trace_steps=text.parse_list_field(F.col("reasoning")),
    )


def tasks_plain(items: DataFrame, benchmark: str, videos: str) -> DataFrame:
    video = blank_to_null(F.col("videoID"))
    return _task(
        items,
        benchmark=F.lit(benchmark),
        video_id=video,
        video_path=F.concat(F.lit(videos.rstrip("/") + "/"), video, F.lit(".mp4")),
        question=strip(F.col("question")),
        question_id=F.col("question_id"),
        options=F.coalesce("options", F.array().cast("array<string>")),
        gold_answer=blank_to_null(F.col("answer")),
        initial_trace_steps=text.parse_list_field(F.col("steps")),
    )


def tasks_by_alias(items: DataFrame, benchmark: str, videos: str) -> DataFrame:
    """Video path under the first filled one of four names."""
    named = F.coalesce(*[blank_to_null(F.col(c)) for c in ("video_path", "video", "video_file", "video_name")])
    path = _video_file(videos, named)
    return _task(
        items,
        benchmark=F.lit(benchmark),
        video_id=_stem(path),
        video_path=path,
        question=strip(F.col("question")),
        question_id=F.col("question_id"),
        options=F.coalesce("options", F.array().cast("array<string>")),
        gold_answer=blank_to_null(F.col("answer")),
        initial_trace_steps=text.parse_list_field(F.col("initial_trace_steps")),
    )


def tasks_adhoc(items: DataFrame) -> DataFrame:
    """Ad hoc task objects with defaults for whatever is not given."""
    path = strip(F.col("video_path"))
    steps = F.coalesce(*[blank_to_null(F.col(c)) for c in ("initial_trace_steps", "steps", "reasoning")])
    return _task(
        items,
        benchmark=F.coalesce(blank_to_null(F.col("benchmark")), F.lit("adhoc")),
        video_id=F.coalesce(blank_to_null(F.col("video_id")), _stem(path)),
        video_path=path,
        question=strip(F.col("question")),
        question_id=blank_to_null(F.col("question_id")),
        options=F.coalesce("options", F.array().cast("array<string>")),
        gold_answer=F.coalesce("gold_answer", "answer"),
        initial_trace_steps=text.parse_list_field(steps),
        given_key=F.col("sample_key"),
    )


# ---------------------------------------------------------------- run folders

PLAN = "strategy string, refinement_instructions string, steps array<struct<step_id:string,tool_name:string,purpose:string>>"
TRACE = "final_answer string, evidence_entries array<struct<evidence_id:string>>, inference_steps array<struct<step_id:string,text:string>>"
AUDIT = "verdict string, confidence double, feedback string, missing_information array<string>, findings array<struct<severity:string,category:string,message:string>>"


def _placed(files: DataFrame) -> DataFrame:
    """Files with run, round, tool and name: as a listing gives them, so that filters reach it, or else taken from the path."""
    if {"run", "round", "tool", "name"} <= set(files.columns):
        return files.withColumn("path", F.col("relpath")) if "relpath" in files.columns else files
    path = F.col("path")
    return files.withColumns(
        {
            "run": F.regexp_extract(path, r"([^/]+/[^/]+)/round_\d+/", 1),
            "round": F.regexp_extract(path, r"/round_(\d+)/", 1).try_cast("int"),
            "tool": F.nullif(F.regexp_extract(path, r"/tools/([^/]+)/[^/]+$", 1), F.lit("")),
            "name": F.when(path.rlike(r"/(round_\d+|tools/[^/]+)/[^/]+$"), F.regexp_extract(path, r"([^/]+)$", 1)),
        }
    )


def run_rounds(files: DataFrame) -> DataFrame:
    """One row per run and round from the round's plan, trace and audit documents (any may be missing).

    ``files`` is a listing of run folders with content, or any (path, content). Filters on run and round go down to the
    listing. The files of a round are a handful, so each round is one small group.
    """
    names = {"planner_plan.json": "plan", "synthesizer_trace_package.json": "trace", "auditor_report.json": "audit"}
    known = _placed(files).filter(F.col("tool").isNull() & F.col("name").isin(list(names)))
    picks = [F.max(F.when(F.col("name") == n, F.struct("content", "path"))).alias(a) for n, a in names.items()]
    rounds = known.groupBy("run", "round").agg(*picks)
    read = {"_p": F.from_json("plan.content", PLAN), "_t": F.from_json("trace.content", TRACE), "_a": F.from_json("audit.content", AUDIT)}
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rounds.withColumns(read).select(
        "run",
        "round",
        *[F.coalesce(f"{a}.path", F.lit("")).alias(f"{a}_path") for a in names.values()],
        F.trim(F.coalesce("_p.strategy", F.lit(""))).alias("strategy"),
        size("_p.steps").alias("step_count"),
        F.array_join(F.transform("_p.steps", lambda s: strip(s["tool_name"])), ",").alias("tools"),
        F.trim(F.coalesce("_t.final_answer", F.lit(""))).alias("final_answer"),
        size("_t.evidence_entries").alias("evidence_count"),
        size("_t.inference_steps").alias("inference_count"),
        F.trim(F.coalesce("_a.verdict", F.lit(""))).alias("verdict"),
        F.col("_a.confidence").alias("confidence"),
        size("_a.findings").alias("finding_count"),
        F.filter(F.transform("_a.missing_information", strip), lambda m: m != "").alias("missing_information"),
    )


def tool_steps(files: DataFrame) -> DataFrame:
    """One row per executed tool from its request, result, timing, runtime, artifact and observation files.

    Folders whose name starts with ``_`` are skipped. The tool's name comes from the result, else the request,
    else the folder.
    """
    known = _placed(files).filter(F.col("tool").isNotNull()).withColumns({"tool_dir": F.col("tool"), "_name": F.regexp_extract("name", r"^(.*)\.json$", 1)})
    known = known.filter(~F.startswith("tool_dir", F.lit("_")))
    parts = ["request", "result", "timing", "runtime", "artifact_refs", "observations"]
    steps = known.groupBy("run", "round", "tool_dir").agg(*[F.max(F.when(F.col("_name") == p, F.col("content"))).alias(p) for p in parts])
    tool = F.coalesce(*[blank_to_null(F.get_json_object(p, "$.tool_name")) for p in ("result", "request")], F.col("tool_dir"))
    count = lambda p: F.coalesce(F.json_array_length(p), F.lit(0))
    return steps.select(
        "run",
        "round",
        "tool_dir",
        tool.alias("tool_name"),
        "request",
        "result",
        F.get_json_object("result", "$.ok").alias("ok"),
        F.get_json_object("timing", "$.duration_s").try_cast("double").alias("duration_s"),
        "runtime",
        count("artifact_refs").alias("artifact_count"),
        count("observations").alias("observation_count"),
    )


def run_overview(rounds: DataFrame, steps: DataFrame) -> DataFrame:
    """One nested overview row per run, rounds and tool steps in order (a run holds a handful of both)."""
    by_round = rounds.groupBy("run").agg(
        ordered_list(F.struct("round", "strategy", "tools", "verdict"), F.col("round")).alias("rounds"),
        F.max_by("verdict", "round").alias("latest_verdict"),
        F.max_by("final_answer", "round").alias("final_answer"),
    )
    by_step = steps.groupBy("run").agg(
        ordered_list(F.struct("round", "tool_dir", "tool_name", "duration_s"), F.col("round"), F.col("tool_dir")).alias("tool_steps"),
        F.sum("observation_count").alias("observation_count"),
    )
    return by_round.join(by_step, "run", "full")


# ---------------------------------------------------------------- file listings


def artifact_manifest(files: DataFrame, kind: str, copy_limit: int = 50 * 1024 * 1024) -> DataFrame:
    """Artifact row per listed file; files of `copy_limit` bytes or fewer that are no video are marked for copying."""
    media = text.media_type_of(F.col("path"))
    return files.select(
        _stem(F.col("path")).alias("artifact_id"),
        F.lit(kind).alias("kind"),
        F.concat(F.lit(f"artifacts/{kind}/"), F.regexp_extract("path", r"([^/]*)$", 1)).alias("relpath"),
        media.alias("media_type"),
        "length",
        ((F.col("length") <= copy_limit) & (F.coalesce(media, F.lit("")) != "video")).alias("copy_file"),
    )


def dense_frames(files: DataFrame) -> DataFrame:
    """Frame files ``frame_<seconds>.png`` with their time; other files are left out."""
    seconds = F.regexp_extract("path", r"/frame_(\d+(?:\.\d+)?)\.png$", 1).try_cast("double")
    named = files.select("path", seconds.alias("timestamp_s")).filter("timestamp_s IS NOT NULL")
    return named.withColumn("video_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).orderBy("video_id", "timestamp_s")


def fingerprint(content: Column, edge: int = 1024 * 1024) -> Column:
    """SHA-256 of length, first and last megabyte of a binary value."""
    size = F.octet_length(content)
    tail = F.when(size > 2 * edge, F.substring(content, -edge, edge)).otherwise(F.substring(content, edge + 1, edge))
    return F.sha2(F.concat(size.cast("string").cast("binary"), F.substring(content, 1, edge), tail), 256)


def file_fingerprints(spark: SparkSession, path: str, edge: int = 1024 * 1024) -> DataFrame:
    """(path, length, fingerprint) of every file under a path, of any size: only its two ends are read."""
    return folders.edge_fingerprints(listing(spark, path), edge)


# ---------------------------------------------------------------- ledger tables

# Columns later versions added to the evidence table, with their defaults.
EVOLVED = {
    "status": "candidate",
    "time_start_s": None,
    "time_end_s": None,
    "frame_ts_s": None,
    "time_intervals_json": "[]",
    "inference_hint": None,
}


def evolved_ledger(spark: SparkSession, *paths: str) -> DataFrame:
    """Evidence tables of any age under today's columns, missing ones filled with their defaults."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    kinds = {"time_start_s": "double", "time_end_s": "double", "frame_ts_s": "double"}
    for name, default in EVOLVED.items():
        kind = kinds.get(name, "string")
        given = F.col(name) if name in df.columns else F.lit(None).cast(kind)
        df = df.withColumn(name, F.coalesce(given, F.lit(default).cast(kind)))
    return df


def parse_ledger(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """JSON text columns of a ledger table as typed columns; blank text counts as missing."""
    return df.withColumns({n: F.from_json(blank_to_null(F.col(n)), kind) for n, kind in columns.items()})


# Settings fields that must not leave the machine.
SECRET_FIELDS = ["workspace_root", "cache_root", "hf_cache", "api_key"]


def redact_secrets(settings: Column) -> Column:
    """Map of settings with paths and keys replaced; a null stays null."""
    return F.transform_values(settings, lambda k, v: F.when(k.isin(SECRET_FIELDS) & v.isNotNull(), F.lit("<redacted>")).otherwise(v))
