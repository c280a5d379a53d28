"""Domain jobs: observation extraction, evidence lifecycle, exports, plan checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import tables as B
from sightline.catalog.aggregates import half_timed
from sightline.catalog.columns import PIECES_SQL, SECONDS_SQL, SENTENCES_SQL
from sightline.catalog.registry import query
from sightline.operators.frames import frames_from_evidence, model_scan_windows, regions_from_detections
from sightline.operators.runs import artifacts_from_requests, build_evidence, fanout_requests
from sightline.catalog.windows import merged_sql
from sightline.functions import text
from sightline.functions.text import WS
from sightline.operators import export as X
from sightline.operators import ledger as L
from sightline.operators import observe as O
from sightline.plans import checks


def hash_sql(tool: str, subject: str, predicate: str, atomic: str, obj: str, start: str, end: str, frame: str) -> str:
    """The observation id over the printed JSON, keys in order."""
    quoted = {k: f"to_json(({v})::VARCHAR)::VARCHAR" for k, v in {"a": atomic, "o": obj, "p": predicate, "s": subject, "t": tool}.items()}
    numbers = [f"coalesce(({v})::DOUBLE::VARCHAR, 'null')" for v in (frame, end, start)]
    return (
        f"'obs_' || left(sha256('{{\"atomic_text\":' || {quoted['a']} || ',\"frame_ts_s\":' || {numbers[0]} || ',\"object_text\":' || {quoted['o']} || ',\"predicate\":' || {quoted['p']}"
        f" || ',\"subject\":' || {quoted['s']} || ',\"time_end_s\":' || {numbers[1]} || ',\"time_start_s\":' || {numbers[2]} || ',\"tool_name\":' || {quoted['t']} || '}}'), 16)"
    )


T2 = "printf('%.2f', {0})"
SPAN2 = f"{T2.format('time_start_s')} || 's{{0}}' || {T2.format('time_end_s')} || 's'"


@query(
    "observe_intervals",
    f"""WITH {B.OBS_SQL}, r AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'visual event' ELSE predicate END AS q FROM obs),
    f AS (SELECT *, {SPAN2.format('-')} AS object_text, '"' || q || '" is present from ' || {SPAN2.format(' to ')} || '.' AS atomic_text FROM r)
    SELECT seq, {hash_sql("'visual_temporal_grounder'", 'q', "'present_in_interval'", 'atomic_text', 'object_text', 'time_start_s', 'time_end_s', 'NULL')} AS observation_id, q AS subject, object_text, atomic_text, confidence FROM f""",
)
def _(spark, sf):
    q = F.when(F.col("seq") % 5 == 0, F.lit(" ")).otherwise(F.col("predicate"))
    clips = B.observations(spark, sf).withColumns({"query": q, "refs": F.array(F.lit("a1"))})
    return O.from_intervals(clips, ["seq"]).select("seq", "observation_id", "subject", "object_text", "atomic_text", "confidence")


@query(
    "observe_frames",
    f"""WITH {B.FRAMES_SQL}, f AS (SELECT *, {T2.format('timestamp_s')} || 's' AS object_text, 'A candidate frame was retrieved at ' || {T2.format('timestamp_s')} || 's.' AS atomic_text FROM fr)
    SELECT seq, {hash_sql("'frame_retriever'", "'requested frame'", "'retrieved_frame_at'", 'atomic_text', 'object_text', 'NULL', 'NULL', 'timestamp_s')} AS observation_id, atomic_text,
      CASE WHEN seq % 2 = 0 THEN frame_path || ',clip' ELSE 'tool' END AS refs FROM f""",
)
def _(spark, sf):
    own = F.when(F.col("seq") % 2 == 0, F.array("frame_path", F.lit("clip"), F.lit("clip"))).otherwise(F.array(F.lit(" ")))
    frames = B.scored_frames(spark, sf).withColumns({"query": F.lit(None).cast("string"), "own_refs": own, "refs": F.array(F.lit("tool")), "score": F.col("score_u") / 1e6})
    out = O.from_frames(frames, ["seq"])
    return out.select("seq", "observation_id", "atomic_text", F.array_join("source_artifact_refs", ",").alias("refs"))


@query(
    "observe_transcripts",
    f"""WITH {B.SEGMENTS_SQL}, s AS (SELECT transcript_id, seg_idx, CASE WHEN seg_idx % 4 = 3 THEN 'unknown_speaker' ELSE speaker_id END AS who, start_ms / 1000.0::DOUBLE AS time_start_s, end_ms / 1000.0::DOUBLE AS time_end_s, unnest({SENTENCES_SQL}) AS said FROM seg),
    f AS (SELECT *, who || ' said "' || said || '" from ' || {SPAN2.format(' to ')} || '.' AS atomic_text FROM s)
    SELECT transcript_id, seg_idx, {hash_sql("'asr'", 'who', "'said'", 'atomic_text', 'said', 'time_start_s', 'time_end_s', 'NULL')} AS observation_id, who AS subject, said AS object_text FROM f""",
)
def _(spark, sf):
    who = F.when(F.col("seg_idx") % 4 == 3, F.lit("")).otherwise(F.col("speaker_id"))
    seg = B.segments(spark, sf).withColumns({"speaker_id": who, "confidence": F.lit(None), "refs": F.array(F.lit("t"))})
    return O.from_transcripts(seg, ["transcript_id", "seg_idx"]).select("transcript_id", "seg_idx", "observation_id", "subject", "object_text")


CAPTION_SQL = """cap AS (SELECT doc_id, doc_id * 1.0::DOUBLE AS time_start_s, doc_id + 2.5::DOUBLE AS time_end_s, text, source, lang FROM documents)"""


@query(
    "observe_captions",
    f"""WITH {CAPTION_SQL}, p AS (SELECT doc_id, time_start_s, time_end_s, unnest(range(len({PIECES_SQL}))) AS i, unnest({PIECES_SQL}) AS chunk FROM cap),
    v AS (SELECT doc_id, time_start_s, time_end_s, arg_min(chunk, i) AS chunk FROM p GROUP BY doc_id, time_start_s, time_end_s, lower(chunk)),
    t AS (SELECT doc_id, time_start_s, time_end_s, {SPAN2.format(' to ')} AS tm, {SPAN2.format('-')} AS rng, source, lang FROM cap),
    f AS (SELECT doc_id, 'shows_action' AS predicate, source AS object_text, 'The clip from ' || tm || ' shows: ' || source || '.' AS atomic_text FROM t
      UNION ALL SELECT doc_id, 'appears_in_clip', rng, lang || ' appears from ' || tm || '.' FROM t
      UNION ALL SELECT doc_id, 'shows_text', source, 'Visible text from ' || tm || ': "' || source || '".' FROM t WHERE doc_id % 2 = 0
      UNION ALL SELECT v.doc_id, 'visual_fact', chunk, 'Visual fact from ' || tm || ': ' || chunk || '.' FROM v JOIN t ON v.doc_id = t.doc_id
      UNION ALL SELECT doc_id, 'contains_audio_event', 'music', 'Audio fact from ' || tm || ': music.' FROM t WHERE doc_id % 3 <> 0
      UNION ALL SELECT doc_id, 'has_attribute', 'tone: ' || lang, 'An observed attribute from ' || tm || ' is: tone: ' || lang || '.' FROM t)
    SELECT * FROM f""",
)
def _(spark, sf):
    d = F.col("doc_id")
    captions = B.table(spark, sf, "documents").select(
        "doc_id",
        (d * 1000).alias("start_ms"),
        (d * 1000 + 2500).alias("end_ms"),
        F.col("text").alias("visual"),
        F.when(d % 3 == 0, "Unknown").otherwise("music").alias("audio"),
        F.when(d % 2 == 0, F.col("source")).otherwise("None").alias("on_screen_text"),
        F.array("source", F.lit(" ")).alias("actions"),
        F.array("lang").alias("objects"),
        F.array(F.concat(F.lit("tone: "), "lang")).alias("attributes"),
        F.array(F.lit("c")).alias("refs"),
    )
    return O.from_captions(captions, ["doc_id"]).select("doc_id", "predicate", "object_text", "atomic_text")


@query(
    "observe_ocr",
    rf"""WITH l AS (SELECT doc_id, TRUE AS lined, regexp_replace(unnest(string_split(text, chr(10))), '^{WS}+|{WS}+$', '', 'g') AS line FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, FALSE, unnest({SENTENCES_SQL}) FROM documents WHERE doc_id % 2 = 1)
    SELECT doc_id, line AS object_text, TRY_CAST(replace(regexp_extract(line, '[-+]?\$?\s*(\d+(?:,\d{{3}})*(?:\.\d+)?|\.\d+)\s*%?', 1), ',', '') AS DOUBLE) AS numeric_value,
      CASE WHEN lined THEN 1.0::DOUBLE ELSE 9.0 END AS x1, doc_id::DOUBLE AS frame_ts_s, 'OCR detected text: "' || line || '".' AS atomic_text FROM l WHERE line <> ''""",
)
def _(spark, sf):
    d = F.col("doc_id")
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text"), F.array(*[F.lit(1.0)] * 4).alias("bbox")))
    none = F.array().cast("array<string>")
    reads = B.table(spark, sf, "documents").select(
        "doc_id", "text", (d * 1000).alias("t_ms"), F.when(d % 2 == 0, lines).alias("lines"), F.array(*[F.lit(9.0)] * 4).alias("region_box"),
        none.alias("region_refs"), F.array(F.lit("f")).alias("frame_refs"), none.alias("refs"),
    )
    out = O.from_text_reads(reads, ["doc_id"])
    return out.select("doc_id", "object_text", "numeric_value", F.col("bbox")[0].alias("x1"), "frame_ts_s", "atomic_text")


@query(
    "observe_detections",
    f"""WITH {B.BOXES_SQL}, t AS (SELECT seq, video_id, 'obj ' || video_id AS who, '[' || b1 || ', ' || b2 || ', ' || b3 || ', ' || b4 || ']' AS loc FROM bx),
    f AS (SELECT *, who || ' is located at ' || loc || ' in the frame.' AS atomic_text FROM t)
    SELECT seq, {hash_sql("'spatial_grounder'", 'who', "'located_in_frame'", 'atomic_text', 'loc', 'NULL', 'NULL', 'seq / 2.0::DOUBLE')} AS observation_id, atomic_text, seq / 2.0::DOUBLE AS frame_ts_s FROM f""",
)
def _(spark, sf):
    rows = B.boxes(spark, sf).withColumns(
        {"label": F.concat(F.lit("obj "), "video_id"), "t_ms": F.col("seq") * 500, "confidence": F.lit(0.5), "refs": F.array(F.lit("f"))}
    )
    return O.from_detections(rows, ["seq"]).select("seq", "observation_id", "atomic_text", "frame_ts_s")


@query(
    "observe_reports",
    f"""WITH r AS (SELECT conv_id, turn, 0 AS part_no, 'Frame 2 shows ' || role AS text FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END, text FROM conversations WHERE turn % 5 <> 4),
    p AS (SELECT conv_id, turn, part_no, unnest(range(len({PIECES_SQL}))) AS i, unnest({PIECES_SQL}) AS chunk FROM r),
    c AS (SELECT conv_id, turn, part_no, arg_min(chunk, i) AS chunk FROM p GROUP BY conv_id, turn, part_no, lower(chunk))
    SELECT conv_id, turn, chunk AS atomic_text, CASE WHEN regexp_matches(lower(chunk), '\\bframe\\s+2\\b') THEN 'b' ELSE 'a,b' END AS refs FROM c
    UNION ALL SELECT conv_id, turn, left('{{"turn":' || turn || '}}', 500), 'a,b' FROM conversations WHERE turn % 5 = 4 AND turn % 3 <> 0""".replace("\\\\", "\\"),
)
def _(spark, sf):
    t = F.col("turn")
    reports = B.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(t % 5 != 4, F.col("text")).otherwise("").alias("answer"),
        F.when(t % 3 == 0, F.array(F.concat(F.lit("Frame 2 shows "), "role"))).otherwise(F.array().cast("array<string>")).alias("points"),
        F.array(F.lit("a"), F.lit("b")).alias("refs"),
    )
    out = O.from_reports(reports, ["conv_id", "turn"], F.to_json(F.struct("turn")))
    return out.select("conv_id", "turn", "atomic_text", F.array_join("source_artifact_refs", ",").alias("refs"))


@query(
    "build_evidence",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL}, st AS (SELECT *, seq % 290 + 1 AS step_id, sha256(evidence_id) AS request FROM ev),
    half AS (SELECT evidence_id, seq, predicate, CASE WHEN seq % 5 = 0 THEN start_ms END AS frame_ms, CASE WHEN seq % 5 NOT IN (0, 2) THEN start_ms END AS start_ms, CASE WHEN seq % 5 NOT IN (0, 1) THEN end_ms END AS end_ms FROM obs),
    ends AS (SELECT evidence_id, seq, coalesce(start_ms, end_ms) AS start_ms, coalesce(end_ms, start_ms) AS end_ms FROM half WHERE frame_ms IS NULL), {merged_sql('ends', 'evidence_id')},
    b AS (SELECT evidence_id, count(*) AS c, min(start_ms) AS s, max(end_ms) AS e FROM merged GROUP BY evidence_id),
    f AS (SELECT evidence_id, count(DISTINCT frame_ms) AS c, min(frame_ms) AS f FROM half WHERE frame_ms IS NOT NULL GROUP BY evidence_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY seq) AS p, count(*) OVER (PARTITION BY evidence_id) AS n FROM half),
    d AS (SELECT evidence_id, max(n) AS n, string_agg('[' || CASE WHEN frame_ms IS NOT NULL THEN 'frame ' || {T2.format('frame_ms / 1000.0::DOUBLE')} || 's' WHEN coalesce(start_ms, end_ms) = coalesce(end_ms, start_ms) THEN {T2.format('coalesce(start_ms, end_ms) / 1000.0::DOUBLE')} || 's'
      ELSE {T2.format('start_ms / 1000.0::DOUBLE')} || '-' || {T2.format('end_ms / 1000.0::DOUBLE')} || 's' END || '] ' || predicate, chr(10) ORDER BY p) AS t, count(*) AS shown FROM r WHERE p <= 8 GROUP BY evidence_id)
    SELECT st.evidence_id AS evidence_key, printf('ev_%02d_', step_id) || left(request, 8) AS evidence_id, tool_name,
      CASE WHEN st.seq % 8 = 0 THEN 'unknown' ELSE 'candidate' END AS status,
      CASE WHEN st.seq % 8 = 0 THEN 'Step failed: s' || step_id ELSE substr(t, 1, 2000) || CASE WHEN n > shown THEN chr(10) || '... ' || (n - shown) || ' additional linked observation(s).' ELSE '' END END AS evidence_text,
      n AS n_observations, CASE WHEN b.c = 1 THEN s END AS start_ms, CASE WHEN b.c = 1 THEN e END AS end_ms, CASE WHEN b.c IS NULL AND f.c = 1 THEN f END AS frame_ms,
      CASE WHEN b.c = 1 OR (b.c IS NULL AND f.c = 1) THEN 0 ELSE coalesce(b.c, f.c) END AS n_listed
    FROM st LEFT JOIN b ON st.evidence_id = b.evidence_id LEFT JOIN f ON st.evidence_id = f.evidence_id JOIN d ON st.evidence_id = d.evidence_id""",
)
def _(spark, sf):
    results = B.evidence(spark, sf).select(
        F.col("evidence_id").alias("evidence_key"),
        (F.col("seq") % 290 + 1).alias("step_id"),
        F.sha2("evidence_id", 256).alias("request_hash"),
        "tool_name",
        (F.col("seq") % 8 != 0).alias("ok"),
    ).withColumn("summary", F.concat(F.lit("s"), "step_id"))
    obs = half_timed(B.observations(spark, sf)).withColumnRenamed("evidence_id", "evidence_key")
    return build_evidence(results, obs)


@query(
    "evidence_status_step",
    """WITH e AS (SELECT l_orderkey AS run_id, l_linenumber AS evidence_id, CASE min(l_partkey) % 4 WHEN 0 THEN 'Validated' WHEN 1 THEN 'odd' WHEN 2 THEN 'stale' ELSE '' END AS status FROM lineitem GROUP BY ALL),
    c AS (SELECT DISTINCT l_orderkey AS run_id, l_suppkey AS o FROM lineitem WHERE l_quantity > 40),
    h AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS evidence_id FROM lineitem l JOIN c ON c.run_id = l_orderkey AND c.o = l_suppkey),
    s AS (SELECT e.run_id, e.evidence_id, lower(CASE WHEN status = '' THEN 'candidate' ELSE status END) AS status, e.run_id % 2 = 0 AS acc, h.run_id IS NOT NULL AS hit, e.run_id IN (SELECT run_id FROM c) AS cites
      FROM e LEFT JOIN h ON e.run_id = h.run_id AND e.evidence_id = h.evidence_id),
    n AS (SELECT *, CASE WHEN acc AND hit THEN 'validated' WHEN acc AND status = 'validated' THEN 'superseded' WHEN status NOT IN ('validated','superseded','refuted','irrelevant','stale','unknown') THEN 'candidate' ELSE status END AS new_status FROM s WHERE NOT acc OR cites)
    SELECT run_id, evidence_id, status, new_status FROM n WHERE status <> new_status""",
)
def _(spark, sf):
    lines = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("evidence_id"), F.col("l_suppkey").alias("observation_id"), "l_partkey", "l_quantity"
    )
    words = F.array(F.lit("Validated"), F.lit("odd"), F.lit("stale"), F.lit(""))
    entries = lines.groupBy("run_id", "evidence_id").agg(F.min("l_partkey").alias("p"))
    entries = entries.select("run_id", "evidence_id", F.element_at(words, (F.col("p") % 4 + 1).cast("int")).alias("status"))
    cited = lines.filter(F.col("l_quantity") > 40)
    accepted = lines.select("run_id").distinct().withColumn("accepted", F.col("run_id") % 2 == 0)
    return L.status_step(entries, lines, cited, accepted)


@query(
    "apply_status_updates",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL} SELECT evidence_id, CASE WHEN seq % 3 = 0 THEN 'validated' ELSE status END AS status, seq % 3 = 0 AS changed FROM ev""",
)
def _(spark, sf):
    ev = B.evidence(spark, sf).select("evidence_id", "seq", "status")
    changes = ev.filter(F.col("seq") % 3 == 0).select("evidence_id", F.lit("validated").alias("new_status"))
    out = L.apply_status(ev, changes, ["evidence_id"])
    return out.select("evidence_id", "status", (F.col("seq") % 3 == 0).alias("changed"))


@query(
    "regions_from_detections",
    f"""WITH {B.BOXES_SQL} SELECT seq, 'o' || video_id AS label, CASE seq % 3 WHEN 0 THEN seq::DOUBLE WHEN 1 THEN seq * 2.0::DOUBLE ELSE (seq * 1000 + 2000) / 2000.0::DOUBLE END AS timestamp_s, CASE WHEN seq % 3 = 0 THEN 'f' || seq ELSE '' END AS frame_path, b1 AS x1
    FROM bx WHERE seq % 5 <> 0""",
)
def _(spark, sf):
    q = F.col("seq")
    rows = B.boxes(spark, sf).select(
        "seq", "video_id", F.concat(F.lit("o"), "video_id").alias("label"), F.when(q % 5 != 0, F.col("bbox")).alias("bbox"),
        F.when(q % 3 == 0, F.concat(F.lit("f"), q)).alias("frame_path"), (q * 1000).alias("frame_ms"), F.when(q % 3 == 1, q * 2000).alias("t_ms"),
        F.lit(2000).alias("clip_start_ms"), (q * 1000).alias("clip_end_ms"),
    )
    out = regions_from_detections(rows)
    return out.select("seq", "label", "frame.timestamp_s", "frame.frame_path", F.col("bbox")[0].alias("x1"))


@query(
    "frames_from_evidence",
    f"""WITH {B.OBS_SQL}, a AS (SELECT seq, 0 AS position, 'f/' || (seq % 700) || '.png' AS relpath, CASE WHEN seq % 2 = 0 THEN (seq % 5) * 100 ELSE start_ms % 10 END AS t_ms, video_id, start_ms, end_ms FROM obs WHERE seq % 3 <> 1)
    SELECT seq, position, relpath, t_ms, video_id, start_ms AS clip_start_ms, end_ms AS clip_end_ms FROM a QUALIFY row_number() OVER (PARTITION BY relpath, t_ms ORDER BY seq) = 1""",
)
def _(spark, sf):
    q = F.col("seq")

    def artifact(kind, path, t):
        return F.struct(
            kind.alias("kind"), F.lit(None).cast("string").alias("media_type"), path.alias("relpath"), t.cast("long").alias("t_ms"), F.lit(None).cast("long").alias("video_id")
        )

    image = artifact(F.when(q % 3 == 0, "frame").otherwise("blob"), F.concat(F.lit("f/"), q % 700, F.when(q % 3 == 1, ".bin").otherwise(".png")), F.when(q % 2 == 0, (q % 5) * 100))
    other = artifact(F.lit("clip"), F.lit("c.mp4"), F.lit(None))
    ev = B.observations(spark, sf).select("seq", "video_id", "start_ms", "end_ms", (F.col("start_ms") % 10).alias("frame_ms"), F.array(image, other).alias("artifact_refs"))
    return frames_from_evidence(ev)


# ---------------------------------------------------------------- exports: a document is a trace, its sentences are steps

LINE_SQL = f"""tr AS (SELECT doc_id, {SENTENCES_SQL} AS l, string_split(text, chr(10)) AS e, lang FROM documents),
ln AS (SELECT doc_id, lang, e, list_transform(l, lambda x, i: CASE WHEN i % 3 = 0 THEN x WHEN i % 3 = 1 THEN '[' || {SECONDS_SQL.format('((i - 1) / 4.0::DOUBLE)')} || ' to ' || {SECONDS_SQL.format('((i - 1) / 4.0::DOUBLE + 1)')} || '] ' || x ELSE '[' || {SECONDS_SQL.format('((i - 1) / 4.0::DOUBLE)')} || '] ' || x END) AS l FROM tr)"""


def traces(spark, sf):
    def step(t, i):
        at = i / F.lit(4.0)
        timed = F.when(i % 3 == 0, at)
        return F.struct(t.alias("text"), timed.alias("start_s"), (timed + 1).alias("end_s"), F.when(i % 3 == 1, at).alias("frame_s"))

    docs = B.table(spark, sf, "documents")
    return docs.select("doc_id", "lang", F.split("text", "\n").alias("evidence"), F.transform(text.sentence_chunks(F.col("text")), step).alias("steps"))


@query("export_numbered_steps", f"WITH {LINE_SQL} SELECT doc_id, unnest(range(len(l))) AS pos, unnest(list_transform(l, lambda x, i: i || '. ' || x)) AS step, lang AS answer FROM ln")
def _(spark, sf):
    rows = traces(spark, sf).select("doc_id", F.posexplode(X.numbered(F.col("steps"))).alias("pos", "step"), F.col("lang").alias("answer"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("export_joined_trace", f"WITH {LINE_SQL} SELECT doc_id, array_to_string(l, chr(10)) AS trace, lang AS answer FROM ln")
def _(spark, sf):
    return traces(spark, sf).select("doc_id", X.joined(F.col("steps")).alias("trace"), F.col("lang").alias("answer"))


@query(
    "export_triples",
    f"WITH {LINE_SQL} SELECT doc_id, pos, 'mixed' AS modality, coalesce(e[pos + 1], '') AS evidence, coalesce(l[pos + 1], '') AS inference FROM (SELECT *, unnest(range(greatest(len(e), len(l)))) AS pos FROM ln)",
)
def _(spark, sf):
    rows = traces(spark, sf).select("doc_id", F.posexplode(X.triples(F.col("evidence"), F.col("steps"))).alias("pos", "t"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "t.*")


@query("export_generic", f"WITH {LINE_SQL} SELECT doc_id, 'k' || doc_id AS sample_key, array_to_string(l, '|') AS steps, array_to_string(e, '|') AS evidence, lang AS answer FROM ln")
def _(spark, sf):
    out = traces(spark, sf).select("doc_id", X.generic(F.concat(F.lit("k"), "doc_id"), F.col("steps"), F.col("evidence"), F.col("lang")).alias("x"))
    return out.select(
        "doc_id", "x.sample_key", F.array_join("x.trace.inference_steps", "|").alias("steps"), F.array_join("x.trace.evidence", "|").alias("evidence"), "x.answer"
    )


# ---------------------------------------------------------------- plans: an order is a plan, its lines are steps

TOOL_NAMES = ["asr", "dense_captioner", "frame_retriever", "ocr", "spatial_grounder", "visual_temporal_grounder", "generic_purpose", "audio_temporal_grounder"]
PATH_NAMES = ["clips[].id", "clips", "frames", "clips[2]", "frames.0.clip", "phrase_matches[1].time_hint", "phrase_matches[].time_hint", "answer", "overall_summary", "transcripts", "transcripts[0].text"]
PATH_LIST = "[" + ", ".join(f"'{t}'" for t in PATH_NAMES) + "]"
TOOL_LIST = "[" + ", ".join(f"'{t}'" for t in TOOL_NAMES) + "]"
RULES_SQL = (
    "em(tool, head) AS (VALUES " + ", ".join(f"('{t}', '{v}')" for t, vs in checks.TOOL_OUTPUTS.items() for v in vs) + "), "
    "nd(tool, field) AS (VALUES " + ", ".join(f"('{t}', '{v}')" for t, vs in checks.NEEDS_ONE_OF.items() for v in vs) + "), "
    "pt(field, path) AS (VALUES " + ", ".join(f"('{t}', '{v}')" for t, vs in checks.PART_PATHS.items() for v in vs) + "), "
    "tx(path) AS (VALUES " + ", ".join(f"('{v}')" for v in checks.TEXT_OUTPUTS) + ")"
)


@query(
    "plan_lint",
    f"""WITH {RULES_SQL}, s AS (SELECT l_orderkey AS plan_id, l_linenumber AS step_id, l_partkey * 1000 + l_suppkey AS pos, {TOOL_LIST}[l_partkey % 8 + 1] AS tool, CASE WHEN l_quantity > 25 THEN ['clips'] ELSE ['query'] END AS lit FROM lineitem),
    k AS (SELECT plan_id, step_id, count(*) AS n, arg_min(tool, pos) AS tool FROM s GROUP BY ALL),
    r AS (SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS step_id, l_linenumber - 1 + l_suppkey % 3 AS src, ['time_hints', 'clips', 'query', 'frames', 'evidence_ids', 'text_contexts', 'transcripts'][l_suppkey % 7 + 1] AS target,
      {PATH_LIST}[(l_partkey + l_suppkey) % 11 + 1] AS path FROM lineitem WHERE l_partkey % 3 <> 0),
    w AS (SELECT r.*, regexp_replace(regexp_replace(path, '\\[\\d+\\]', '[]', 'g'), '\\.\\d+', '[]', 'g') AS general, a.tool AS src_tool, b.tool AS tool FROM r LEFT JOIN k a ON a.plan_id = r.plan_id AND a.step_id = r.src JOIN k b ON b.plan_id = r.plan_id AND b.step_id = r.step_id),
    fed AS (SELECT plan_id, step_id, target AS field FROM r UNION ALL SELECT plan_id, step_id, unnest(lit) FROM s),
    fd AS (SELECT DISTINCT f.plan_id, f.step_id FROM fed f JOIN k ON k.plan_id = f.plan_id AND k.step_id = f.step_id JOIN nd ON nd.tool = k.tool AND nd.field = f.field UNION SELECT r.plan_id, r.step_id FROM r JOIN k ON r.plan_id = k.plan_id AND r.step_id = k.step_id WHERE k.tool = 'generic_purpose'),
    o AS (SELECT plan_id, step_id, 'duplicate_step_id' AS rule, n::VARCHAR AS detail FROM k WHERE n > 1
      UNION ALL SELECT plan_id, step_id, 'missing_source', src::VARCHAR FROM w WHERE src_tool IS NULL
      UNION ALL SELECT plan_id, step_id, 'self_reference', target FROM r WHERE src = step_id
      UNION ALL SELECT plan_id, step_id, 'later_source', src::VARCHAR FROM w WHERE src_tool IS NOT NULL AND src > step_id
      UNION ALL SELECT plan_id, step_id, 'path_not_emitted', src_tool || '.' || path FROM w WHERE src_tool IS NOT NULL AND (src_tool, regexp_extract(path, '^([^.\\[]*)', 1)) NOT IN (SELECT (tool, head) FROM em)
      UNION ALL SELECT plan_id, step_id, 'missing_context', tool FROM k WHERE tool IN (SELECT tool FROM nd) AND (plan_id, step_id) NOT IN (SELECT (plan_id, step_id) FROM fd)
      UNION ALL SELECT plan_id, step_id, 'time_hints_not_from_speech', src_tool FROM w WHERE target = 'time_hints' AND src_tool <> 'asr'
      UNION ALL SELECT plan_id, step_id, 'regions_into_text_reader', src::VARCHAR FROM w WHERE tool = 'ocr' AND src_tool = 'spatial_grounder'
      UNION ALL SELECT plan_id, step_id, 'evidence_ids_by_reference', src::VARCHAR FROM w WHERE target = 'evidence_ids'
      UNION ALL SELECT plan_id, step_id, 'path_of_other_parts', path || ' -> ' || target FROM w WHERE target IN (SELECT field FROM pt) AND (target, path) NOT IN (SELECT (field, path) FROM pt) AND (target, general) NOT IN (SELECT (field, path) FROM pt)
      UNION ALL SELECT plan_id, step_id, 'no_text_output', path FROM w WHERE target = 'text_contexts' AND path NOT IN (SELECT path FROM tx)
      UNION ALL SELECT plan_id, step_id, 'speech_not_as_transcripts', path || ' -> ' || target FROM w WHERE tool = 'generic_purpose' AND src_tool = 'asr' AND (target = 'text_contexts' OR target = 'transcripts' AND path <> 'transcripts')
      UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, 'evidence_not_retrieved', 'ev_' || l_suppkey FROM lineitem l WHERE l_partkey % 5 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_suppkey = l.l_suppkey AND x.l_partkey % 5 <> 0)
      UNION ALL SELECT plan_id, step_id, 'sound_before_sight', tool FROM k WHERE tool = 'audio_temporal_grounder' AND plan_id % 4 = 0 AND (plan_id, step_id) NOT IN (SELECT (plan_id, step_id) FROM w WHERE target = 'clips' AND src_tool = 'visual_temporal_grounder'))
    SELECT DISTINCT * FROM o""",
)
def _(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    tools, paths = (F.array(*[F.lit(t) for t in names]) for names in (TOOL_NAMES, PATH_NAMES))
    targets = F.array(*[F.lit(t) for t in ("time_hints", "clips", "query", "frames", "evidence_ids", "text_contexts", "transcripts")])
    ids = [F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").cast("long").alias("step_id")]
    steps = lines.select(
        *ids,
        (part * 1000 + supp).alias("pos"),
        F.element_at(tools, (part % 8 + 1).cast("int")).alias("tool_name"),
        F.when(F.col("l_quantity") > 25, F.array(F.lit("clips"))).otherwise(F.array(F.lit("query"))).alias("literals"),
    )
    refs = lines.filter(part % 3 != 0).select(
        *ids,
        F.element_at(targets, (supp % 7 + 1).cast("int")).alias("target_field"),
        (F.col("l_linenumber") - 1 + supp % 3).alias("source_step_id"),
        F.element_at(paths, ((part + supp) % 11 + 1).cast("int")).alias("field_path"),
    )
    evidence = F.concat(F.lit("ev_"), supp).alias("evidence_id")
    cited, retrieved = lines.filter(part % 5 == 0).select(*ids, evidence), lines.filter(part % 5 != 0).select(ids[0], evidence)
    conditioned = lines.filter("l_orderkey % 4 = 0").select(ids[0])
    return checks.plan_lint(steps, refs.distinct(), cited, retrieved, conditioned)


@query(
    "plan_levels",
    """WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS step_id FROM lineitem),
    e AS (SELECT a.plan_id, a.step_id, a.src FROM (SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS step_id, CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN 3 ELSE l_linenumber - 1 - l_suppkey % 2 END AS src FROM lineitem WHERE l_partkey % 4 <> 0) a JOIN s ON s.plan_id = a.plan_id AND s.step_id = a.src),
    w AS (SELECT plan_id, step_id, step_id AS at, 0 AS d FROM s UNION SELECT w.plan_id, w.step_id, e.src, d + 1 FROM w JOIN e ON e.plan_id = w.plan_id AND e.step_id = w.at WHERE d < 8)
    SELECT plan_id, step_id, CASE WHEN max(d) < 8 THEN max(d) END AS level, max(d) >= 8 AS in_cycle FROM w GROUP BY plan_id, step_id""",
)
def _(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    ids = [F.col("l_orderkey").alias("plan_id"), n.alias("step_id")]
    source = F.when((F.col("l_orderkey") % 50 == 0) & (n == 1), 3).otherwise(n - 1 - F.col("l_suppkey") % 2)
    edges = lines.filter(F.col("l_partkey") % 4 != 0).select(*ids, source.cast("int").alias("source_step_id"))
    return checks.plan_levels(lines.select(*ids), edges)


@query(
    "model_scan_windows",
    f"""WITH {B.FRAMES_SQL}, du AS (SELECT video_id, max(t_ms) AS d FROM fr GROUP BY video_id), b AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score_u DESC, t_ms, seq) <= 24),
    p AS (SELECT b.video_id, greatest(1, ceil(d / 10000.0::DOUBLE)::BIGINT) - 1 AS last, least(greatest(1, ceil(d / 10000.0::DOUBLE)::BIGINT) - 1, greatest(0, ceil(t_ms / 10000.0::DOUBLE)::BIGINT - 1)) AS i FROM b JOIN du ON b.video_id = du.video_id),
    e AS (SELECT DISTINCT video_id, unnest(range(greatest(0, i - 1), least(last, i + 1) + 1)) AS idx FROM p)
    SELECT video_id, idx FROM e QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY idx) <= 12""",
)
def _(spark, sf):
    frames = B.scored_frames(spark, sf)
    return model_scan_windows(frames, frames.groupBy("video_id").agg(F.max("t_ms").alias("duration_ms")), 10_000, 3)


@query(
    "fanout_requests",
    r"""WITH d AS (SELECT doc_id, doc_id % 5 AS k, string_split(text, chr(10)) AS l FROM documents),
    c AS (SELECT doc_id, CASE k WHEN 0 THEN 'region' WHEN 1 THEN 'frame' WHEN 2 THEN 'clip' WHEN 3 THEN 'time_hint' ELSE 'request' END AS field, CASE WHEN k = 4 THEN [NULL] ELSE l END AS l FROM d)
    SELECT doc_id AS request_id, unnest(range(len(l))) AS group_no, field, unnest(l) AS item FROM c""",
)
def _(spark, sf):
    k, parts = F.col("doc_id") % 5, F.split("text", "\n")
    requests = B.table(spark, sf, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.when(k == 0, parts).alias("regions"),
        F.when(k <= 1, parts).alias("frames"),
        F.when(k <= 2, parts).alias("clips"),
        F.when(k <= 3, parts).alias("time_hints"),
    )
    return fanout_requests(requests).withColumn("group_no", F.col("group_no").cast("long"))


@query(
    "artifacts_from_requests",
    """WITH i AS (SELECT vec_id * 2 AS seq, 'frame' AS kind, CASE WHEN vec_id % 2 = 0 THEN 'art' || (vec_id % 30) END AS aid, CASE WHEN vec_id % 3 <> 0 THEN 'frames/img.' || (vec_id % 40) || '.png' END AS relpath FROM embeddings
      UNION ALL SELECT vec_id * 2 + 1, 'clip', NULL, 'c/clip_' || label || '.mp4' FROM embeddings),
    a AS (SELECT seq, kind, coalesce(aid, regexp_replace(regexp_extract(relpath, '([^/]*)$', 1), '\\.[^.]*$', '')) AS artifact_id, relpath FROM i WHERE aid IS NOT NULL OR relpath IS NOT NULL)
    SELECT min(seq) AS seq, kind, artifact_id, relpath, CASE kind WHEN 'clip' THEN 'video' ELSE 'image' END AS media_type, 'ocr' AS source_tool FROM a GROUP BY kind, artifact_id, relpath""".replace("\\\\", "\\"),
)
def _(spark, sf):
    v = F.col("vec_id")
    emb = B.table(spark, sf, "embeddings")
    frames = emb.select(
        (v * 2).alias("seq"), F.lit("frame").alias("kind"), F.when(v % 2 == 0, F.concat(F.lit("art"), v % 30)).alias("artifact_id"),
        F.when(v % 3 != 0, F.concat(F.lit("frames/img."), v % 40, F.lit(".png"))).alias("relpath"),
    )
    clips = emb.select((v * 2 + 1).alias("seq"), F.lit("clip").alias("kind"), F.lit(" ").alias("artifact_id"), F.concat(F.lit("c/clip_"), "label", F.lit(".mp4")).alias("relpath"))
    return artifacts_from_requests(frames.unionByName(clips), "ocr")


@query(
    "initial_steps_to_trace",
    rf"""WITH l AS (SELECT item_id, string_split(text || chr(10) || ' ' || chr(10) || 'end', chr(10)) AS l FROM benchmark), u AS (SELECT item_id, unnest(range(len(l))) + 1 AS step_id, unnest(l) AS text FROM l)
    SELECT item_id, step_id, text, 'medium' AS answer_relevance, 'refine' AS mode FROM u WHERE regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') <> ''""",
)
def _(spark, sf):
    given = F.split(F.concat("text", F.lit("\n \nend")), "\n")
    rows = B.table(spark, sf, "benchmark").select("item_id", F.explode(X.initial_steps(given)).alias("s"), F.lit("refine").alias("mode"))
    return rows.select("item_id", F.col("s.step_id").cast("long").alias("step_id"), "s.text", "s.answer_relevance", "mode")
