"""Readers and writers as table jobs: each writes files made from the given tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import tables as B
from sightline.catalog.columns import page_files
from sightline.catalog.jobs import LINE_SQL, traces
from sightline.catalog.registry import query
from sightline.operators import export as X
from sightline.operators import ledger as L
from sightline.operators.core import ordered_list
from sightline.session import materialize, work_path
from sightline.sources import folders
from sightline.sources import readers as R
from sightline.sources import writers as W
from sightline.sources.snapshots import Ledger


@query("scan_jsonl", "SELECT event_id, event_type, value FROM events")
def _(spark, sf):
    path = work_path(spark, "log")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    # A blank line after every tenth record.
    lines = F.when(F.col("event_id") % 10 == 0, F.array(line, F.lit("  "))).otherwise(F.array(line))
    B.table(spark, sf, "events").select(F.explode(lines)).write.text(path)
    return R.scan_jsonl(spark, path, "event_id long, event_type string, value double")


def write_arrays(df, record, path, block: int = 100):
    """Records as JSON array documents of ``block`` records, one document per file."""
    rows = df.withColumns({"_b": F.floor(F.col("_id") / block), "_r": record})
    arrays = rows.groupBy("_b").agg(F.to_json(ordered_list(F.col("_r"), F.col("_id"))).alias("value"))
    arrays.write.partitionBy("_b").text(path)


@query("scan_json", "SELECT item_id, text FROM benchmark")
def _(spark, sf):
    path = work_path(spark, "docs")
    items = B.table(spark, sf, "benchmark").withColumn("_id", F.col("item_id"))
    write_arrays(items, F.struct("item_id", "text"), path, 7)
    return R.scan_json(spark, f"{path}/*/*", "item_id long, text string")


@query(
    "scan_tasks_choice",
    """SELECT 'v' || p_partkey AS video_id, '/data/videos/v' || p_partkey || '.mp4' AS video_path, p_name AS question, 'A. ' || p_brand || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '|B. ' || p_type END || '|D. ' || p_size AS options,
      CASE WHEN p_partkey % 3 = 0 THEN 'D. ' || p_size WHEN p_partkey % 4 = 0 THEN 'D. ' || p_size ELSE 'B. ' || p_type END AS gold_answer, 'v' || p_partkey || '__qidk' || p_partkey AS sample_key FROM part WHERE p_partkey % 9 <> 0""",
)
def _(spark, sf):
    p = F.col("p_partkey")
    part = B.table(spark, sf, "part").withColumn("_id", p)
    size = F.col("p_size").cast("string")
    record = F.struct(
        F.when(p % 9 != 0, F.concat(F.lit("v"), p)).alias("video_id"), F.col("p_name").alias("question"), F.concat(F.lit("k"), p).alias("key"),
        F.when(p % 3 == 0, F.concat(F.lit("D. "), size)).otherwise("").alias("answer"), F.lit("1").alias("answer_id"),
        F.col("p_brand").alias("answer_choice_0"), F.when(p % 4 == 0, " ").otherwise(F.col("p_type")).alias("answer_choice_1"), size.alias("answer_choice_3"),
    )
    path = work_path(spark, "choice")
    write_arrays(part, record, path)
    tasks = R.tasks_by_choice(R.scan_json(spark, f"{path}/*/*", R.CHOICE_TASK), "choice", "/data/videos")
    return tasks.select("video_id", "video_path", "question", F.array_join("options", "|").alias("options"), "gold_answer", "sample_key")


@query(
    "scan_tasks_plain",
    """SELECT 'v' || item_id AS video_id, item_id::VARCHAR AS question_id, 'yes|no' AS options, CASE WHEN item_id % 2 = 0 THEN 'yes' END AS gold_answer, 'one|two' AS steps, 'v' || item_id || '__qid' || item_id AS sample_key FROM benchmark WHERE item_id % 6 <> 0""",
)
def _(spark, sf):
    i = F.col("item_id")
    items = B.table(spark, sf, "benchmark").withColumn("_id", i)
    record = F.struct(
        F.when(i % 6 != 0, F.concat(F.lit("v"), i)).otherwise(" ").alias("videoID"), F.col("text").alias("question"), i.alias("question_id"),
        F.array(F.lit("yes"), F.lit("no")).alias("options"), F.when(i % 2 == 0, " yes ").otherwise("").alias("answer"), F.array(F.lit("one"), F.lit(" two ")).alias("steps"),
    )
    path = work_path(spark, "plain")
    write_arrays(items, record, path)
    tasks = R.tasks_plain(R.scan_json(spark, f"{path}/*/*", R.PLAIN_TASK), "plain", "/data/videos")
    return tasks.select(
        "video_id", "question_id", F.array_join("options", "|").alias("options"), "gold_answer", F.array_join("initial_trace_steps", "|").alias("steps"), "sample_key"
    )


@query(
    "scan_tasks_multi_alias",
    """SELECT CASE item_id % 4 WHEN 0 THEN '/abs/v' ELSE '/data/videos/v' END || item_id || '.mp4' AS video_path, 'v' || item_id AS video_id, 'v' || item_id || '__' || left(sha256(text), 12) AS sample_key FROM benchmark WHERE item_id % 7 <> 0""",
)
def _(spark, sf):
    i = F.col("item_id")
    name = F.concat(F.lit("v"), i, F.lit(".mp4"))
    items = B.table(spark, sf, "benchmark").select(
        F.when(i % 4 == 0, F.concat(F.lit("/abs/"), name)).otherwise("").alias("video_path"),
        F.when(i % 4 == 1, name).alias("video"), F.when(i % 4 == 2, name).alias("video_file"), F.when(i % 4 == 3, name).alias("video_name"),
        F.when(i % 7 != 0, F.col("text")).alias("question"),
    )
    path = work_path(spark, "alias") + ".jsonl"
    W.append_jsonl(items, path)
    tasks = R.tasks_by_alias(R.scan_json(spark, path, R.ALIAS_TASK), "alias", "/data/videos")
    return tasks.select("video_path", "video_id", "sample_key")


@query(
    "scan_input_tasks",
    """SELECT CASE WHEN item_id % 3 = 0 THEN 'quiz' ELSE 'adhoc' END AS benchmark, 'v' || item_id AS video_id, CASE WHEN item_id % 5 = 0 THEN 'own' || item_id ELSE 'v' || item_id || '__' || left(sha256(trim(text)), 12) END AS sample_key, 'g' || item_id AS gold_answer FROM benchmark""",
)
def _(spark, sf):
    i = F.col("item_id")
    items = B.table(spark, sf, "benchmark").withColumn("_id", i)
    record = F.struct(
        F.when(i % 3 == 0, "quiz").otherwise(" ").alias("benchmark"), F.concat(F.lit("/v/v"), i, F.lit(".mp4")).alias("video_path"), F.col("text").alias("question"),
        F.when(i % 5 == 0, F.concat(F.lit("own"), i)).alias("sample_key"), F.concat(F.lit("g"), i).alias("answer"),
    )
    path = work_path(spark, "input")
    write_arrays(items, record, path)
    return R.tasks_adhoc(R.scan_json(spark, f"{path}/*/*", R.INPUT_TASK)).select("benchmark", "video_id", "sample_key", "gold_answer")


# ---------------------------------------------------------------- run folders: an order is a run, its lines are tools


def run_tree(spark, sf):
    """A tree of run folders written from the conversations: one run each, two turns a round; its root."""
    turns = B.table(spark, sf, "conversations").withColumn("round", F.floor(F.col("turn") / 2) + 1)
    c, n = F.col("conv_id"), F.col("turn")
    root = F.concat(F.lit("chat/run_"), c, F.format_string("/round_%02d/", F.col("round")))
    step = F.struct(n.cast("string").alias("step_id"), F.concat(F.lit(" "), "role").alias("tool_name"), F.col("text").alias("purpose"))
    each = turns.groupBy("conv_id", "round").agg(
        F.min_by("text", "turn").alias("ask"), F.max_by("text", "turn").alias("reply"), F.count(F.lit(1)).alias("n"), ordered_list(step, n).alias("steps")
    )
    plan = F.struct(F.col("ask").alias("strategy"), "steps")
    trace = F.struct(F.col("reply").alias("final_answer"), F.array_repeat(F.struct(F.lit("e").alias("evidence_id")), F.col("n").cast("int")).alias("evidence_entries"))
    audit = F.struct(F.when(c % 2 == 0, " PASS").otherwise("FAIL").alias("verdict"), (F.col("n") / 4.0).alias("confidence"), F.array(F.lit(" "), F.lit("when")).alias("missing_information"))
    documents = [("planner_plan.json", plan, c % 5 != 0), ("synthesizer_trace_package.json", trace, c % 3 != 0), ("auditor_report.json", audit, c % 4 != 0), ("planner_request.json", plan, c % 2 == 0)]
    docs = F.array_compact(F.array(*[F.when(given, F.struct(F.concat(root, F.lit(name)).alias("path"), F.to_json(d).alias("content"))) for name, d, given in documents]))
    tool = F.concat(root, F.lit("tools/"), F.when(F.col("role") == "system", "_").otherwise(""), F.format_string("%02d_", n), "role", F.lit("/"))
    result = F.struct(F.when(n % 2 == 0, F.col("role")).alias("tool_name"), F.lit(True).alias("ok"), F.col("text").alias("answer"))
    parts = {"result.json": result, "timing.json": F.struct((F.length("text") / 8.0).alias("duration_s")), "observations.json": F.array_repeat(F.struct(n.alias("id")), (n + 1).cast("int"))}
    tools = F.array(*[F.struct(F.concat(tool, F.lit(name)).alias("path"), F.to_json(d).alias("content")) for name, d in parts.items()])
    files = each.select(F.explode(docs).alias("d")).union(turns.select(F.explode(tools).alias("d"))).select("d.*")
    path = work_path(spark, "runs")
    folders.write_tree(files, path)
    return path


ROUND_SQL = """rn AS (SELECT conv_id, turn // 2 + 1 AS round, arg_min(text, turn) AS ask, arg_max(text, turn) AS reply, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id, turn // 2 + 1),
rr AS (SELECT 'chat/run_' || conv_id AS run, round::INTEGER AS round, CASE WHEN conv_id % 5 = 0 THEN '' ELSE trim(ask) END AS strategy, CASE WHEN conv_id % 5 <> 0 THEN roles END AS tools, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE n END::INTEGER AS step_count,
   CASE WHEN conv_id % 3 = 0 THEN '' ELSE trim(reply) END AS final_answer, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE n END::INTEGER AS evidence_count, CASE WHEN conv_id % 4 = 0 THEN '' WHEN conv_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict,
   CASE WHEN conv_id % 4 <> 0 THEN n / 4.0::DOUBLE END AS confidence, CASE WHEN conv_id % 4 <> 0 THEN 'when' END AS missing, CASE WHEN conv_id % 4 = 0 THEN '' ELSE printf('round_%02d/auditor_report.json', round) END AS audit_path FROM rn
   WHERE conv_id % 5 <> 0 OR conv_id % 3 <> 0 OR conv_id % 4 <> 0),
ts AS (SELECT 'chat/run_' || conv_id AS run, (turn // 2 + 1)::INTEGER AS round, printf('%02d_', turn) || role AS tool_dir, CASE WHEN turn % 2 = 0 THEN role ELSE printf('%02d_', turn) || role END AS tool_name,
   length(text) / 8.0::DOUBLE AS duration_s, (turn + 1)::INTEGER AS observation_count FROM conversations WHERE role <> 'system')"""


@query("scan_run_rounds", f"WITH {ROUND_SQL} SELECT * FROM rr")
def _(spark, sf):
    out = R.run_rounds(folders.run_folders(spark, run_tree(spark, sf)))
    return out.select(
        "run", "round", "strategy", "tools", "step_count", "final_answer", "evidence_count", "verdict", "confidence", F.array_join("missing_information", ",").alias("missing"), "audit_path"
    )


@query("scan_tool_steps", f"WITH {ROUND_SQL} SELECT * FROM ts")
def _(spark, sf):
    return R.tool_steps(folders.run_folders(spark, run_tree(spark, sf))).select("run", "round", "tool_dir", "tool_name", "duration_s", "observation_count")


@query(
    "sink_run_overview",
    f"""WITH {ROUND_SQL}, t AS (SELECT run, string_agg(tool_name, ',' ORDER BY round, tool_dir) AS tools, sum(observation_count)::BIGINT AS observation_count, sum(duration_s) AS seconds FROM ts GROUP BY run),
    r AS (SELECT run, arg_max(verdict, round) AS verdict, arg_min(strategy, round) AS strategy, count(*) AS rounds FROM rr GROUP BY run)
    SELECT coalesce(r.run, t.run) AS run, tools, observation_count, seconds, verdict, strategy, rounds FROM r FULL JOIN t ON r.run = t.run""",
)
def _(spark, sf):
    files = folders.run_folders(spark, run_tree(spark, sf))
    overview = R.run_overview(R.run_rounds(files), R.tool_steps(files))
    path = work_path(spark, "overview")
    W.write_documents(overview, path)
    back = spark.read.schema(overview.schema).json(path)
    seconds = F.aggregate("tool_steps", F.lit(0.0), lambda a, s: a + s["duration_s"])
    return back.select(
        "run", F.array_join(F.transform("tool_steps", lambda s: s["tool_name"]), ",").alias("tools"), "observation_count", seconds.alias("seconds"), F.col("latest_verdict").alias("verdict"),
        F.col("rounds")[0]["strategy"].alias("strategy"), F.when(F.size("rounds") > 0, F.size("rounds").cast("long")).alias("rounds"),
    )


# ---------------------------------------------------------------- ledger files


@query(
    "scan_evidence",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL} SELECT evidence_id, CASE WHEN status = 'provisional' THEN 'candidate' ELSE status END AS status, status = 'provisional' AS legacy, start_ms / 1000.0::DOUBLE AS first_start_s, 2 AS n_refs FROM ev""",
)
def _(spark, sf):
    ev = B.evidence(spark, sf)
    log = ev.select(
        "evidence_id", "seq", "tool_name", "status",
        F.to_json(F.array(F.struct((F.col("start_ms") / 1000.0).alias("start_s"), (F.col("end_ms") / 1000.0).alias("end_s")))).alias("time_intervals"),
        F.to_json(F.array(F.struct(F.lit("a").alias("artifact_id")), F.struct(F.lit("b").alias("artifact_id")))).alias("artifact_refs"),
    )
    path = work_path(spark, "evidence")
    W.append_jsonl(log.withColumn("status", F.lit("stale")).withColumn("seq", F.col("seq") - 1), path)
    W.append_jsonl(log, path)
    kinds = {"time_intervals": "array<struct<start_s double, end_s double>>", "artifact_refs": "array<struct<artifact_id string>>"}
    read = R.scan_jsonl(spark, path, "evidence_id string, seq long, tool_name string, status string, time_intervals string, artifact_refs string")
    entries = L.dedupe_last(R.parse_ledger(read, kinds), "evidence_id")
    return entries.select(
        "evidence_id", L.clean_status(F.col("status")).alias("status"), (F.col("status") == "provisional").alias("legacy"),
        F.col("time_intervals")[0]["start_s"].alias("first_start_s"), F.size("artifact_refs").alias("n_refs"),
    )


@query(
    "scan_observations",
    f"""WITH {B.OBS_SQL} SELECT observation_id, subject, CASE WHEN seq % 2 = 0 THEN numeric_value END AS x1, (metadata::JSON ->> '$.k')::BIGINT AS k, CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS n_refs FROM obs""",
)
def _(spark, sf):
    obs = B.observations(spark, sf)
    box = F.when(F.col("seq") % 2 == 0, F.to_json(F.array_repeat("numeric_value", 4))).otherwise("")
    refs = F.when(F.col("seq") % 3 == 0, "[]").otherwise(F.to_json(F.array("evidence_id")))
    log = obs.select("observation_id", "seq", "subject", box.alias("bbox"), refs.alias("refs"), "metadata")
    path = work_path(spark, "observations")
    W.append_jsonl(log, path)
    read = R.scan_jsonl(spark, path, "observation_id string, seq long, subject string, bbox string, refs string, metadata string")
    typed = R.parse_ledger(read, {"bbox": "array<double>", "refs": "array<string>", "metadata": "struct<k long>"})
    return typed.select("observation_id", "subject", F.col("bbox")[0].alias("x1"), "metadata.k", F.size("refs").alias("n_refs"))


@query(
    "ledger_upsert",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL} SELECT evidence_id, CASE WHEN seq % 3 = 0 THEN 'validated' ELSE status END AS status, CASE WHEN seq % 3 = 0 THEN seq + 1000000 ELSE seq END AS seq, CASE WHEN seq % 6 = 0 THEN (video_id + 1) % 10 ELSE video_id % 10 END AS bucket FROM ev
      UNION ALL SELECT 'new_' || evidence_id, 'candidate', seq + 1000000, video_id % 10 FROM ev WHERE seq % 5 = 0""",
)
def _(spark, sf):
    ev = materialize(B.evidence(spark, sf).select("evidence_id", "status", "seq", (F.col("video_id") % 10).alias("bucket")), "evidence")
    ledger = Ledger(spark, work_path(spark, "ledger"), "evidence_id", "seq", "bucket")
    ledger.upsert(ev)
    # Every second replaced row moves to the next partition; the last commit brings old versions, which change nothing.
    replaced = ev.filter(F.col("seq") % 3 == 0).withColumns({"status": F.lit("validated"), "bucket": F.when(F.col("seq") % 6 == 0, (F.col("bucket") + 1) % 10).otherwise(F.col("bucket"))})
    added = ev.filter(F.col("seq") % 5 == 0).withColumns({"evidence_id": F.concat(F.lit("new_"), "evidence_id"), "status": F.lit("candidate")})
    ledger.upsert(replaced.unionByName(added).withColumn("seq", F.col("seq") + 1_000_000))
    ledger.upsert(ev.filter(F.col("seq") % 2 == 0).withColumns({"status": F.lit("stale"), "seq": F.col("seq") - 1}))
    return ledger.read().select("evidence_id", "status", "seq", F.col("bucket").cast("long").alias("bucket"))


@query(
    "ledger_schema_evolve",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL} SELECT evidence_id, CASE WHEN seq % 2 = 0 THEN 'candidate' ELSE status END AS status, CASE WHEN seq % 2 = 1 THEN start_ms / 1000.0::DOUBLE END AS time_start_s, '[]' AS time_intervals_json FROM ev""",
)
def _(spark, sf):
    ev = B.evidence(spark, sf)
    old, new = work_path(spark, "old"), work_path(spark, "new")
    ev.filter(F.col("seq") % 2 == 0).select("evidence_id", "tool_name").write.parquet(old)
    ev.filter(F.col("seq") % 2 == 1).select("evidence_id", "tool_name", "status", (F.col("start_ms") / 1000.0).alias("time_start_s")).write.parquet(new)
    return R.evolved_ledger(spark, old, new).select("evidence_id", "status", "time_start_s", "time_intervals_json")


@query("sink_jsonl_append", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    path = work_path(spark, "append")
    ev = B.table(spark, sf, "events").select("event_id", "event_type")
    for part in range(2):
        W.append_jsonl(ev.filter(F.col("event_id") % 2 == part), path)
    back = R.scan_jsonl(spark, path, "event_id long, event_type string")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sink_json", "SELECT o_orderstatus AS status, count(*) AS n, max(o_orderpriority) AS answer FROM orders GROUP BY o_orderstatus")
def _(spark, sf):
    runs = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("answer"), F.col("o_orderstatus").alias("status"))
    path = work_path(spark, "results")
    W.write_documents(runs, path, "status")
    back = spark.read.schema("o_orderkey long, answer string, status string").json(path)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("answer").alias("answer"))


MD_STEP = """list_transform(l, lambda x, i: i || '. ' || CASE WHEN i % 3 = 0 THEN x WHEN x LIKE '[%' THEN regexp_extract(x, '(?s)^\\[([^\\]]*)\\] (.*)$', 2) || ' [' || regexp_extract(x, '(?s)^\\[([^\\]]*)\\] (.*)$', 1) || ']' ELSE x END)""".replace("\\\\", "\\")


@query(
    "sink_trace_markdown",
    f"""WITH {LINE_SQL} SELECT doc_id, rtrim('# Trace' || chr(10) || chr(10) || '## Final Answer' || chr(10) || chr(10) || lang || chr(10) || chr(10) || '## Inference' || chr(10) || CASE WHEN len(l) > 0 THEN chr(10) || array_to_string({MD_STEP}, chr(10)) ELSE '' END
      || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10) || '### ev_' || doc_id || chr(10) || chr(10) || '- Status: candidate' || chr(10) || '- Time: 2s' || chr(10) || '- Text: ' || lang || chr(10) || '- Observations: a, b', chr(10)) || chr(10) AS markdown FROM ln""",
)
def _(spark, sf):
    entry = F.struct(
        F.concat(F.lit("ev_"), "doc_id").alias("evidence_id"), F.lit("candidate").alias("status"), F.lit("2s").alias("anchor"),
        F.col("lang").alias("text"), F.array(F.lit("a"), F.lit("b")).alias("observation_ids"),
    )
    rows = traces(spark, sf).withColumn("entries", F.array(entry))
    md = rows.select("doc_id", X.markdown(rows, "lang", "steps", "entries").alias("markdown"))
    W.write_markdown(md, "markdown", work_path(spark, "markdown"))
    return md


@query(
    "scan_artifact_manifest",
    r"""WITH u AS (SELECT page_id, 'p' || page_id || '_' || regexp_extract(regexp_extract(url, '^[^?#]*') || CASE page_id % 7 WHEN 0 THEN '.PNG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.flac' WHEN 3 THEN '.json' WHEN 4 THEN '.md' WHEN 5 THEN '.zip' ELSE '' END, '([^/]*)$', 1) AS name, octet_length(encode(html)) AS length FROM pages),
    m AS (SELECT *, CASE WHEN regexp_matches(name, '[^/.]\.[^./]+$') THEN CASE page_id % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' WHEN 3 THEN 'application/json' WHEN 4 THEN 'text/plain' END END AS media_type FROM u)
    SELECT regexp_replace(name, '(.)\.[^.]*$', '\1') AS artifact_id, 'artifacts/frame/' || name AS relpath, media_type, length, length <= 2000 AND coalesce(media_type, '') <> 'video' AS copy_file FROM m""",
)
def _(spark, sf):
    name = F.concat(F.lit("p"), "page_id", F.lit("_"), F.regexp_extract("path", "([^/]*)$", 1))
    path = work_path(spark, "artifacts")
    folders.write_tree(page_files(spark, sf).select(F.concat(F.col("page_id") % 9, F.lit("/"), name).alias("path"), F.col("html").alias("content")), path)
    return R.artifact_manifest(R.listing(spark, path), "frame", 2000).select("artifact_id", "relpath", "media_type", "length", "copy_file")


@query(
    "scan_dense_frames",
    "SELECT 'v' || label AS video_id, (vec_id / 4.0::DOUBLE) AS timestamp_s, 'v' || label || '/frame_' || printf('%.2f', vec_id / 4.0::DOUBLE) || '.png' AS path FROM embeddings WHERE vec_id % 6 <> 5",
)
def _(spark, sf):
    v = F.col("vec_id")
    suffix = F.when(v % 6 == 5, ".jpg").otherwise(".png")
    file = F.concat(F.lit("v"), F.col("label"), F.lit("/frame_"), F.format_string("%.2f", v / 4.0), suffix)
    path = work_path(spark, "dense")
    folders.write_tree(B.table(spark, sf, "embeddings").select(file.alias("path"), F.col("embedding").cast("string").alias("content")), path)
    frames = R.dense_frames(R.listing(spark, path))
    return frames.withColumn("path", F.regexp_extract("path", "([^/]+/[^/]+)$", 1))


@query(
    "file_fingerprint",
    """WITH b AS (SELECT doc_id, encode(text) AS b FROM documents) SELECT doc_id, octet_length(b) AS length, sha256(encode(octet_length(b)::VARCHAR) || b[1:1000] || CASE WHEN octet_length(b) > 2000 THEN b[-1000:] ELSE b[1001:] END) AS fingerprint FROM b""",
)
def _(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    # A file to a row, also where rows share an id, and a thousand files to a folder; no text is no file.
    at = docs.filter("text IS NOT NULL").withColumn("at", F.monotonically_increasing_id())
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("-"), "at", F.lit(".txt"))
    path = work_path(spark, "texts")
    folders.write_tree(at.select(F.concat(F.floor(F.col("at") / 1000), F.lit("/"), name).alias("path"), F.col("text").alias("content")), path)
    doc_id = F.regexp_extract("path", r"([^/]+)-\d+\.txt$", 1).try_cast("long").alias("doc_id")
    prints = R.file_fingerprints(spark, path, 1000).select(doc_id, "length", "fingerprint")
    return prints.unionByName(docs.filter("text IS NULL").select("doc_id"), allowMissingColumns=True)


@query(
    "redact_secret_fields",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '<redacted>' END AS api_key, '<redacted>' AS workspace_root, c_mktsegment AS base_url FROM customer""",
)
def _(spark, sf):
    cust = B.table(spark, sf, "customer")
    settings = F.create_map(
        F.lit("api_key"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), F.lit("workspace_root"), F.concat(F.lit("/home/"), "c_name"), F.lit("base_url"), F.col("c_mktsegment"),
    )
    safe = cust.select("c_custkey", R.redact_secrets(settings).alias("s"))
    return safe.select("c_custkey", *[F.col("s")[k].alias(k) for k in ("api_key", "workspace_root", "base_url")])
