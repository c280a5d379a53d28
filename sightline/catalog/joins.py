"""Joins as table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import tables as B
from sightline.catalog.columns import SECONDS_SQL, SENTENCES_SQL
from sightline.catalog.registry import query
from sightline.operators.transcripts import segments_by_window
from sightline.session import materialize
from sightline.catalog.windows import DURATIONS_SQL, merged_sql, seconds
from sightline.catalog.windows import durations as video_durations
from sightline.functions import text
from sightline.functions.text import WS
from sightline.functions.timing import seconds_text
from sightline.operators import intervals as I
from sightline.operators import lookups as J


@query(
    "observations_with_status",
    f"WITH {B.OBS_SQL}, {B.EVIDENCE_SQL} SELECT o.seq, o.subject, o.predicate, ev.status FROM obs o LEFT JOIN ev ON o.evidence_id = ev.evidence_id AND ev.seq % 5 <> 0",
)
def _(spark, sf):
    ev = B.evidence(spark, sf).filter(F.col("seq") % 5 != 0)
    return J.with_status(B.observations(spark, sf), ev).select("seq", "subject", "predicate", "status")


@query(
    "lookup_records",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL}, req AS (SELECT video_id AS request_id, unnest([seq * 10, seq * 10 + 1, seq * 10 + 2, seq * 10 + 3]) AS pos, unnest([evidence_id, 'obs_' || seq, 'nope', 'obs_' || (seq + 1)]) AS id FROM ev WHERE seq % 7 = 0),
    e AS (SELECT request_id, pos, evidence_id, tool_name FROM req JOIN ev ON id = evidence_id),
    f AS (SELECT request_id, pos, -1 AS sub, evidence_id, '' AS observation_id, tool_name AS text FROM e UNION ALL
      SELECT request_id, pos, seq, o.evidence_id, observation_id, predicate FROM e JOIN obs o ON e.evidence_id = o.evidence_id UNION ALL
      SELECT request_id, pos, seq, evidence_id, observation_id, predicate FROM req JOIN obs ON id = observation_id)
    SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY request_id, evidence_id, observation_id, text ORDER BY pos, sub) = 1""",
)
def _(spark, sf):
    ev = B.evidence(spark, sf)
    ids = F.array("evidence_id", F.concat(F.lit("obs_"), "seq"), F.lit("nope"), F.concat(F.lit("obs_"), F.col("seq") + 1))
    asked = ev.filter(F.col("seq") % 7 == 0).select(F.col("video_id").alias("request_id"), "seq", F.posexplode(ids).alias("_p", "id"))
    requests = asked.select("request_id", (F.col("seq") * 10 + F.col("_p")).alias("pos"), "id")
    return J.lookup_records(requests, ev, B.observations(spark, sf))


@query(
    "round_context_semi",
    """WITH o AS (SELECT l_orderkey AS evidence_id, l_orderkey || '_' || l_linenumber AS observation_id, l_quantity FROM lineitem),
    k AS (SELECT DISTINCT evidence_id, observation_id FROM o WHERE l_quantity > 10 AND evidence_id % 3 <> 0)
    SELECT DISTINCT evidence_id, observation_id FROM o WHERE (evidence_id, observation_id) IN (SELECT (evidence_id, observation_id) FROM k) OR evidence_id NOT IN (SELECT evidence_id FROM k)""",
)
def _(spark, sf):
    lines = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("evidence_id"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("observation_id"), "l_quantity"
    )
    links = lines.filter((F.col("l_quantity") > 10) & (F.col("evidence_id") % 3 != 0))
    return J.listed_only(lines, links).select("evidence_id", "observation_id").distinct()


@query(
    "missing_evidence_anti",
    "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def _(spark, sf):
    asked = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    available = B.table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("id"))
    return J.missing_ids(asked, available, "id")


@query(
    "cited_evidence_overlap",
    "SELECT DISTINCT l_orderkey AS evidence_id FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R' AND l_discount = 0.1)",
)
def _(spark, sf):
    lines = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("evidence_id"), F.col("l_partkey").alias("observation_id"), "l_quantity", "l_returnflag", "l_discount"
    )
    cited = lines.filter((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.1))
    return J.cited_entries(lines, cited, ["evidence_id"])


@query(
    "step_time_anchor_join",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL}, a AS (SELECT evidence_id, seq, CASE WHEN seq % 9 = 0 THEN '' ELSE {SECONDS_SQL.format('((start_ms // 60000) / 1.0::DOUBLE)')} END AS anchor FROM ev),
    h AS (SELECT DISTINCT o.video_id AS trace_id, o.predicate AS step_id, a.anchor, min(a.seq) AS seq FROM obs o JOIN a ON o.evidence_id = a.evidence_id WHERE o.seq % 6 = 0 AND anchor <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY trace_id, step_id ORDER BY seq) AS n FROM h)
    SELECT trace_id, step_id, string_agg(anchor, ' | ' ORDER BY n) AS anchor FROM r WHERE n <= 2 GROUP BY ALL""",
)
def _(spark, sf):
    obs = B.observations(spark, sf)
    cites = obs.filter(F.col("seq") % 6 == 0).select(F.col("video_id").alias("trace_id"), F.col("predicate").alias("step_id"), "observation_id")
    minute = F.floor(F.col("start_ms") / 60_000).cast("double")
    anchors = B.evidence(spark, sf).select("evidence_id", "seq", F.when(F.col("seq") % 9 == 0, "").otherwise(seconds_text(minute)).alias("anchor"))
    return J.step_anchors(cites, obs.select("evidence_id", "observation_id"), anchors)


@query(
    "interval_overlap_join",
    f"""WITH {B.OBS_SQL}, cand AS (SELECT *, CASE WHEN seq % 3 = 0 OR confidence = 0 THEN 0.5::DOUBLE ELSE confidence END AS conf FROM obs),
    vis AS (SELECT * FROM cand WHERE seq % 2 = 0), {merged_sql('vis', 'video_id', 750)}
    SELECT m.video_id, m.start_ms / 1000.0::DOUBLE AS start_s, m.end_ms / 1000.0::DOUBLE AS end_s, max(c.conf) AS confidence FROM merged m JOIN cand c
      ON m.video_id = c.video_id AND c.start_ms <= m.end_ms AND c.end_ms >= m.start_ms GROUP BY ALL""",
)
def _(spark, sf):
    # A missing or zero confidence counts one half.
    conf = F.when(F.col("seq") % 3 != 0, F.nullif("confidence", F.lit(0.0)))
    cand = B.observations(spark, sf).withColumn("confidence", F.coalesce(conf, F.lit(0.5)))
    merged = I.merge_intervals(cand.filter(F.col("seq") % 2 == 0), ["video_id"], 750).drop("n")
    return seconds(I.overlap_max(materialize(merged, "merged"), cand, ["video_id"], "confidence"))


@query(
    "point_in_window_join",
    f"""WITH {B.OBS_SQL}, {DURATIONS_SQL}, w AS (SELECT video_id, greatest(1, ceil(duration_ms / 3600000.0::DOUBLE)::BIGINT) - 1 AS last FROM du),
    p AS (SELECT o.video_id, least(last, greatest(0, ceil(CASE WHEN seq % 3 = 0 THEN (start_ms // 3600000) * 3600000 ELSE start_ms END / 3600000.0::DOUBLE)::BIGINT - 1)) AS i, last FROM obs o JOIN w ON o.video_id = w.video_id WHERE predicate = 'click'),
    e AS (SELECT DISTINCT video_id, unnest(range(greatest(0, i - 1), least(last, i + 1) + 1)) AS idx FROM p)
    SELECT video_id, idx FROM e QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY idx) <= 12""",
)
def _(spark, sf):
    edge = F.floor(F.col("start_ms") / 3_600_000) * 3_600_000
    t = F.when(F.col("seq") % 3 == 0, edge).otherwise(F.col("start_ms")).cast("long")
    points = B.observations(spark, sf).filter("predicate = 'click'").select("video_id", t.alias("t_ms"))
    return I.windows_for_points(points, video_durations(spark, sf), ["video_id"], 3_600_000, 1, 12)


@query(
    "nearest_anchor_join",
    f"""WITH {B.OBS_SQL}, a AS (SELECT video_id, start_ms AS t FROM obs WHERE predicate = 'error' AND video_id % 4 <> 0),
    d AS (SELECT o.seq, o.video_id, min(abs(o.start_ms - a.t)) AS distance_ms FROM obs o LEFT JOIN a ON o.video_id = a.video_id WHERE predicate <> 'error' GROUP BY ALL),
    n AS (SELECT *, coalesce(distance_ms <= 5000000, FALSE) AS near FROM d)
    SELECT seq, distance_ms FROM n QUALIFY near OR NOT bool_or(near) OVER (PARTITION BY video_id)""",
)
def _(spark, sf):
    obs = B.observations(spark, sf)
    anchors = obs.filter((F.col("predicate") == "error") & (F.col("video_id") % 4 != 0)).select("video_id", "start_ms")
    rows = obs.filter("predicate <> 'error'").select("seq", "video_id", "start_ms")
    return I.near_anchors(rows, anchors, ["video_id"], "start_ms", 5_000_000).select("seq", "distance_ms")


@query(
    "asof_neighbours",
    f"""WITH {B.OBS_SQL}, a AS (SELECT DISTINCT video_id, start_ms AS t FROM obs WHERE predicate = 'error'), r AS (SELECT video_id, start_ms, min(seq) AS seq FROM obs WHERE predicate <> 'error' OR seq % 2 = 0 GROUP BY ALL),
    j AS (SELECT a.video_id, a.t, max(CASE WHEN start_ms < t THEN start_ms END) AS tb, min(CASE WHEN start_ms > t THEN start_ms END) AS ta, min(abs(start_ms - t)) AS g FROM a LEFT JOIN r ON a.video_id = r.video_id GROUP BY ALL)
    SELECT j.video_id, j.t AS start_ms, b.seq AS before_id, n.seq AS after_id, coalesce(c1.seq, c2.seq) AS closest_id, j.g AS closest_gap_ms FROM j
      LEFT JOIN r b ON b.video_id = j.video_id AND b.start_ms = tb LEFT JOIN r n ON n.video_id = j.video_id AND n.start_ms = ta
      LEFT JOIN r c1 ON c1.video_id = j.video_id AND c1.start_ms = t - g LEFT JOIN r c2 ON c2.video_id = j.video_id AND c2.start_ms = t + g""",
)
def _(spark, sf):
    obs = B.observations(spark, sf)
    rows = obs.filter((F.col("predicate") != "error") | (F.col("seq") % 2 == 0))
    out = I.asof_neighbours(obs.filter("predicate = 'error'"), rows, ["video_id"], "start_ms", "seq")
    return out.withColumn("closest_gap_ms", F.col("closest_gap_ms").cast("long"))


@query("phrase_window_cross")
def _(spark, sf):
    seg = B.segments(spark, sf)
    # Each transcript's question quotes the opening of one of its turns and a phrase that is not there.
    opening = F.concat_ws(" ", F.slice(F.split("text", " "), 1, 4))
    asked = seg.groupBy("transcript_id").agg(F.min_by(opening, "seg_idx").alias("said"))
    question = F.concat(F.lit('Who says "'), F.regexp_replace("said", '["\n]', " "), F.lit("\" after 'never said at all'?"))
    return J.phrase_matches(asked.select("transcript_id", question.alias("question")), seg)


def path_model(paths):
    """Stand-in embedding model: three numbers from the path; paths ending in 7 cannot be read."""
    if any(p.endswith("7") for p in paths):
        raise ValueError("unreadable frame")
    return [[float(len(p)), float(p.rsplit("_", 1)[1]), 1.0] for p in paths]


@query(
    "embedding_cache_join",
    """WITH f AS (SELECT vec_id, 'frame_' || vec_id AS frame_path, embedding FROM embeddings)
    SELECT frame_path, CASE WHEN vec_id % 4 <> 0 THEN 'cache' WHEN frame_path LIKE '%7' THEN 'failed' ELSE 'computed' END AS source,
      CASE WHEN vec_id % 4 <> 0 THEN embedding[2]::DOUBLE WHEN frame_path LIKE '%7' THEN 0 ELSE vec_id::DOUBLE END AS second FROM f""",
)
def _(spark, sf):
    frames = B.frames(spark, sf)
    cache = frames.filter(F.col("seq") % 4 != 0).select("frame_path", "embedding")
    out = J.cached_embeddings(frames.select("frame_path"), cache, path_model, 3)
    return out.select("frame_path", "source", F.col("embedding")[1].cast("double").alias("second"))


def step_outputs(spark, sf):
    """Outputs of plan steps (orders' lines), and references of each step to the one before it by paths of every form."""
    lines = B.table(spark, sf, "lineitem")
    p = F.col("l_partkey")
    output = F.format_string('{"answer": "p%d", "clips": [{"id": %d, "label": "Red Car"}, {"id": %d, "tags": [1, null]}, {"tags": []}, {"id": null, "tags": [%d]}], "empty": null}', p, p, p + 1, p)
    outputs = lines.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step_id"), p.alias("seq"), output.alias("output"))
    step = F.col("step_id")
    paths = F.array(*[F.lit(x) for x in ("clips[].id", "answer", "empty", "nothing.here", "clips[].tags[]", "clips[1].id", "clips.red.id", "clips.3")])
    source = F.col("step_id") - 1
    refs = outputs.filter(step > 1).select("plan_id", "step_id").distinct().withColumns({"source_step_id": source, "field_path": F.element_at(paths, ((F.col("plan_id") + step) % 8 + 1).cast("int"))})
    return outputs, refs


REF_SQL = """s AS (SELECT l_orderkey AS plan_id, l_linenumber AS step_id, max(l_partkey) AS part FROM lineitem GROUP BY ALL),
o AS (SELECT plan_id, step_id, unnest(['clips[].id', 'answer', 'empty', 'nothing.here', 'clips[].tags[]', 'clips[1].id', 'clips.red.id', 'clips.3']) AS field_path,
  unnest(['[' || part || ',' || (part + 1) || ']', '"p' || part || '"', NULL, NULL, '[[1],[' || part || ']]', (part + 1)::VARCHAR, part::VARCHAR, '{"id":null,"tags":[' || part || ']}']) AS value FROM s)"""


@query(
    "resolve_refs_join",
    f"""WITH {REF_SQL}, r AS (SELECT plan_id, step_id, ['clips[].id', 'answer', 'empty', 'nothing.here', 'clips[].tags[]', 'clips[1].id', 'clips.red.id', 'clips.3'][((plan_id + step_id) % 8 + 1)::INTEGER] AS field_path FROM s WHERE step_id > 1)
    SELECT r.plan_id, r.step_id, r.field_path, o.value, CASE WHEN o.value IS NULL THEN 'unresolved_dependency' END AS error FROM r LEFT JOIN o ON r.plan_id = o.plan_id AND r.step_id = o.step_id + 1 AND r.field_path = o.field_path""",
)
def _(spark, sf):
    outputs, refs = step_outputs(spark, sf)
    found = J.resolved_refs(refs.withColumn("target_field", F.lit("text_contexts")), outputs)
    return found.select("plan_id", "step_id", "field_path", "value", "error")


@query(
    "merge_refs",
    f"""WITH {REF_SQL}, f(target_field, pos, field_path) AS (VALUES ('clips', 0, 'clips[].id'), ('clips', 1, 'answer'), ('clips', 2, 'clips[].tags[]'), ('query', 0, 'answer'), ('query', 1, 'clips[1].id'), ('a.frames', 0, 'clips[1].id'),
      ('scope', 0, 'answer'), ('scope', 1, 'clips[1].id'), ('scope', 2, 'clips[].id'), ('scope', 3, 'answer'), ('broken', 0, 'empty')),
    t AS (SELECT plan_id, step_id FROM s WHERE step_id > 1),
    j AS (SELECT t.plan_id, t.step_id, f.target_field, f.pos, f.field_path, o.value FROM t JOIN f ON f.target_field <> 'broken' OR t.step_id % 3 = 0 LEFT JOIN o ON o.plan_id = t.plan_id AND o.step_id + 1 = t.step_id AND o.field_path = f.field_path),
    e AS (SELECT plan_id, step_id, arg_min('unresolved_dependency: ' || field_path, target_field || pos) FILTER (value IS NULL) AS error FROM j GROUP BY ALL),
    v AS (SELECT plan_id, step_id, target_field, count(*) AS n_refs, map(list(pos), list(value)) AS m FROM j GROUP BY ALL)
    SELECT v.plan_id, v.step_id, target_field, n_refs, error, CASE WHEN error IS NULL THEN CASE target_field WHEN 'clips' THEN '[' || CASE WHEN v.step_id % 2 = 0 THEN '"given",' ELSE '' END || m[0][2:-2] || ',' || m[1] || ',' || m[2][2:-2] || ']'
      WHEN 'query' THEN m[1] WHEN 'a.frames' THEN '[' || m[0] || ']' ELSE '[' || m[1] || ',' || m[2][2:-2] || ',' || m[3] || ']' END END AS value FROM v JOIN e ON v.plan_id = e.plan_id AND v.step_id = e.step_id""",
)
def _(spark, sf):
    outputs, refs = step_outputs(spark, sf)
    named = [("clips", ["clips[].id", "answer", "clips[].tags[]"]), ("query", ["answer", "clips[1].id"]), ("a.frames", ["clips[1].id"]), ("scope", ["answer", "clips[1].id", "clips[].id", "answer"]), ("broken", ["empty"])]
    each = F.array(*[F.struct(F.lit(t).alias("target_field"), F.lit(i).alias("pos"), F.lit(p).alias("field_path")) for t, paths in named for i, p in enumerate(paths)])
    rows = refs.select("plan_id", "step_id", "source_step_id", F.explode(each).alias("r")).select("plan_id", "step_id", "source_step_id", "r.*")
    rows = rows.filter((F.col("target_field") != "broken") | (F.col("step_id") % 3 == 0))
    given = refs.filter(F.col("step_id") % 2 == 0).select("plan_id", "step_id", F.lit("clips").alias("target_field"), F.lit('"given"').alias("value"))
    return J.merged_refs(rows, outputs, given)


@query(
    "zip_steps_evidence",
    f"""WITH s AS (SELECT doc_id, unnest(range(len({SENTENCES_SQL}))) AS pos, unnest({SENTENCES_SQL}) AS inference FROM documents),
    e AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS evidence FROM documents)
    SELECT coalesce(s.doc_id, e.doc_id) AS doc_id, coalesce(s.pos, e.pos) AS pos, coalesce(evidence, '') AS evidence, coalesce(inference, '') AS inference, 'mixed' AS modality FROM s FULL JOIN e ON s.doc_id = e.doc_id AND s.pos = e.pos""",
)
def _(spark, sf):
    docs = B.table(spark, sf, "documents")
    steps = docs.select("doc_id", F.posexplode(text.sentence_chunks(F.col("text"))).alias("pos", "inference"))
    evidence = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "evidence"))
    rows = J.zip_rows(evidence, steps, ["doc_id", "pos"], "evidence", "inference")
    return rows.withColumns({"modality": F.lit("mixed"), "pos": F.col("pos").cast("long")})


@query(
    "zip_text_box_score",
    r"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS t, regexp_extract_all(text, '\d+') AS s FROM documents),
    u AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS text, s FROM a)
    SELECT doc_id, text, CASE WHEN pos < 3 THEN pos::DOUBLE END AS x1, TRY_CAST(s[pos + 1] AS DOUBLE) AS confidence FROM u WHERE trim(text) <> ''""",
)
def _(spark, sf):
    boxes = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array(*[i.cast("double")] * 4))
    scores = F.transform(F.regexp_extract_all("text", F.lit(r"\d+"), 0), lambda s: s.try_cast("double"))
    lines = J.zip_lines(F.split("text", "\n"), boxes, scores)
    rows = B.table(spark, sf, "documents").select("doc_id", F.explode(lines).alias("l"))
    return rows.select("doc_id", "l.text", F.col("l.bbox")[0].alias("x1"), "l.confidence")


@query(
    "segment_window_overlap",
    rf"""WITH {B.SEGMENTS_SQL} SELECT transcript_id, start_ms // 12000 AS "window", seg_idx // 1000 AS part, string_agg(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), ' ' ORDER BY seg_idx) AS text, count(*) AS n_segments, max(end_ms) AS end_ms FROM seg GROUP BY ALL""",
)
def _(spark, sf):
    return segments_by_window(B.segments(spark, sf), 12_000)
