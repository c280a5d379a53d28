"""Aggregations and de-duplication as table jobs, and the flagship report."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import tables as B
from sightline.catalog.columns import SECONDS_SQL
from sightline.catalog.registry import query
from sightline.operators.frames import frame_sequence_context
from sightline.operators.intervals import label_memory, timing_rollup
from sightline.operators.runs import PART, group_flags, ledger_by_subject, merge_group_outputs, result_item_counts, result_parts, round_summary
from sightline.operators.transcripts import captions_summary, transcript_render, transcript_text
from sightline.catalog.windows import merged_sql
from sightline.functions import text, timing
from sightline.functions.text import WS
from sightline.operators import intervals as I
from sightline.operators import ledger as L
from sightline.operators.core import keep_first, top_n

PART = 1000


@query(
    "subject_evidence_report",
    f"""WITH {B.OBS_SQL}, keep AS (SELECT * FROM obs WHERE numeric_value > 10 AND predicate <> 'error'),
    {merged_sql('keep', 'subject, predicate')},
    t AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, end_ms - start_ms DESC, start_ms, predicate) AS rank FROM merged)
    SELECT subject, predicate, rank, n, {SECONDS_SQL.format('(start_ms / 1000.0::DOUBLE)')} || ' to ' || {SECONDS_SQL.format('(end_ms / 1000.0::DOUBLE)')} AS anchor
    FROM t WHERE rank <= 5""",
)
def subject_evidence_report(spark, sf):
    """Five strongest stretches of evidence per subject with their merged time anchors."""
    obs = B.observations(spark, sf).filter((F.col("numeric_value") > 10) & (F.col("predicate") != "error"))
    merged = I.merge_intervals(obs, ["subject", "predicate"])
    order = [F.desc("n"), F.desc(F.col("end_ms") - F.col("start_ms")), F.asc("start_ms"), F.asc("predicate")]
    best = top_n(merged, ["subject"], order, 5)
    anchor = timing.interval_text(timing.to_s(F.col("start_ms")), timing.to_s(F.col("end_ms")))
    return best.select("subject", "predicate", F.col("rank").cast("long").alias("rank"), "n", anchor.alias("anchor"))


REPEATS_SQL = "rep AS (SELECT *, subject || ':' || predicate AS fact_id FROM obs)"


def repeats(spark, sf):
    return B.observations(spark, sf).withColumn("fact_id", F.concat_ws(":", "subject", "predicate"))


@query(
    "dedupe_keep_last",
    f"""WITH {B.OBS_SQL}, {REPEATS_SQL}, l AS (SELECT fact_id, max(seq) AS seq, arg_max(numeric_value, seq) AS value, min(seq) AS first_seq FROM rep GROUP BY fact_id)
    SELECT fact_id, 'last' AS kind, seq, value, seq AS position FROM l UNION ALL SELECT fact_id, 'first', seq, value, first_seq FROM l""",
)
def _(spark, sf):
    rows = repeats(spark, sf).select("fact_id", "seq", F.col("numeric_value").alias("value"))
    last = L.dedupe_last(rows, "fact_id", position="last").withColumn("kind", F.lit("last"))
    return last.unionByName(L.dedupe_last(rows, "fact_id", position="first").withColumn("kind", F.lit("first")))


@query(
    "dedupe_evidence_first",
    "WITH e AS (SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN source || '_' || (doc_id % 50) ELSE ' ' END AS evidence_id, text FROM documents) "
    "SELECT min(seq) AS seq, arg_min(CASE WHEN trim(evidence_id) = '' THEN NULL ELSE evidence_id END, seq) AS evidence_id FROM e "
    "GROUP BY CASE WHEN trim(evidence_id) <> '' THEN evidence_id ELSE 'text:' || text END",
)
def _(spark, sf):
    eid = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("_", "source", F.col("doc_id") % 50)).otherwise(F.lit(" "))
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), eid.alias("evidence_id"), "text")
    first = L.dedupe_first(docs, L.evidence_key(docs, "evidence_id"))
    return first.select("seq", text.blank_to_null(F.col("evidence_id")).alias("evidence_id"))


@query(
    "dedupe_observations_first",
    "SELECT min(doc_id) AS seq FROM documents GROUP BY CASE WHEN doc_id % 3 = 0 THEN 'id' || (doc_id % 40) ELSE source || chr(1) || trim(text) END",
)
def _(spark, sf):
    oid = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("id"), F.col("doc_id") % 40))
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), oid.alias("oid"), "source", "text")
    return L.dedupe_first(docs, L.observation_key(F.col("oid"), F.col("source"), F.col("text"))).select("seq")


@query(
    "dedupe_artifacts_first",
    "SELECT min(l_orderkey * 10 + l_linenumber) AS seq, l_partkey AS artifact_id, 'p/' || l_suppkey AS relpath, l_returnflag AS kind FROM lineitem GROUP BY ALL",
)
def _(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_partkey").alias("artifact_id"),
        F.concat(F.lit("p/"), "l_suppkey").alias("relpath"),
        F.col("l_returnflag").alias("kind"),
    )
    return keep_first(rows, ["artifact_id", "relpath", "kind"], ["seq"])


WORDS_SQL = "w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations)"


@query(
    "dedupe_text_casefold",
    rf"""WITH {WORDS_SQL}, v AS (SELECT conv_id, turn * 1000000 + pos AS seq, regexp_replace(word, '^{WS}+|{WS}+$', '', 'g') AS word FROM w WHERE regexp_matches(word, '[\p{{L}}\p{{N}}]'))
    SELECT conv_id, min(seq) AS seq, arg_min(word, seq) AS word FROM v WHERE NOT (length(word) >= 8 AND replace(lower(regexp_replace(word, '[^\p{{L}}\p{{N}}]+', '', 'g')), lower(left(regexp_replace(word, '[^\p{{L}}\p{{N}}]+', '', 'g'), 1)), '') = '')
    GROUP BY conv_id, lower(word)""",
)
def _(spark, sf):
    words = B.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    rows = words.select("conv_id", (F.col("turn") * 1_000_000 + F.col("pos")).alias("seq"), "word")
    return L.distinct_texts(rows, ["conv_id"], "word", "seq")


@query(
    "evidence_rollup",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL}
    SELECT 'total' AS section, 'evidence' AS name, count(*) AS n, NULL::BIGINT AS rank FROM ev UNION ALL SELECT 'total', 'observations', count(*), NULL FROM obs
    UNION ALL SELECT 'status', CASE WHEN status = 'provisional' THEN 'candidate' ELSE status END, count(*), NULL FROM ev GROUP BY ALL
    UNION ALL (SELECT 'subject', subject, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, subject) AS r FROM obs GROUP BY subject QUALIFY r <= 15)
    UNION ALL (SELECT 'predicate', predicate, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, predicate) AS r FROM obs GROUP BY predicate QUALIFY r <= 15)""",
)
def _(spark, sf):
    out = L.rollup(B.observations(spark, sf), B.evidence(spark, sf))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "counts_by_tool",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL}, c AS (SELECT 'observations' AS kind, predicate AS tool, count(*) AS n FROM obs GROUP BY ALL UNION ALL SELECT 'evidence', tool_name, count(*) FROM ev GROUP BY ALL)
    SELECT kind, tool, n FROM c WHERE trim(tool) <> ''""",
)
def _(spark, sf):
    def counted(df, column, kind):
        named = df.withColumn("tool", text.blank_to_null(F.col(column))).filter("tool IS NOT NULL")
        return named.groupBy("tool").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))

    both = counted(B.observations(spark, sf), "predicate", "observations").unionByName(counted(B.evidence(spark, sf), "tool_name", "evidence"))
    return both.select("kind", "tool", "n").orderBy("kind", F.desc("n"), "tool")


@query(
    "confidence_stats",
    f"""WITH {B.OBS_SQL}, c AS (SELECT evidence_id, CASE WHEN seq % 4 = 0 THEN NULL WHEN seq % 4 = 1 THEN round(numeric_value)::BIGINT END AS v FROM obs)
    SELECT evidence_id, max(v)::DOUBLE AS confidence, round(sum(v)::DOUBLE / count(v), 4) AS confidence_avg, count(v) AS confidence_count FROM c WHERE v IS NOT NULL GROUP BY evidence_id""",
)
def _(spark, sf):
    raw = F.when(F.col("seq") % 4 == 1, F.round("numeric_value").cast("long").cast("string")).when(F.col("seq") % 4 == 2, F.lit("n/a"))
    return L.confidence_stats(B.observations(spark, sf), ["evidence_id"], raw)


@query(
    "group_flags_merge",
    f"""WITH {B.OBS_SQL} SELECT video_id, bool_and(seq % 13 <> 0) AS cache_hit, max(seq % 1000) AS frame_count, sum(seq % 100)::BIGINT AS bounded_count, count(*) AS groups FROM obs GROUP BY video_id""",
)
def _(spark, sf):
    q = F.col("seq")
    groups = B.observations(spark, sf).select("video_id", (q % 13 != 0).alias("hit"), (q % 1000).alias("frames"), (q % 100).alias("bounded"))
    return group_flags(groups, ["video_id"])


TIMED_SQL = f"""{B.OBS_SQL}, timed AS (SELECT evidence_id, seq, CASE WHEN video_id % 3 = 0 OR seq % 5 = 0 THEN NULL ELSE start_ms END AS start_ms,
   CASE WHEN video_id % 3 = 0 OR seq % 5 = 0 OR seq % 7 = 0 THEN NULL ELSE end_ms END AS end_ms, CASE WHEN video_id % 3 = 0 OR seq % 5 = 0 THEN start_ms END AS frame_ms FROM obs)"""


def timed_rows(spark, sf):
    q = F.col("seq")
    framed = (F.col("video_id") % 3 == 0) | (q % 5 == 0)
    return B.observations(spark, sf).select(
        "evidence_id",
        "seq",
        F.when(~framed, F.col("start_ms")).alias("start_ms"),
        F.when(~framed & (q % 7 != 0), F.col("end_ms")).alias("end_ms"),
        F.when(framed, F.col("start_ms")).alias("frame_ms"),
    )


@query(
    "temporal_bounds",
    f"""WITH {TIMED_SQL}, iv AS (SELECT evidence_id, seq, start_ms, coalesce(end_ms, start_ms) AS end_ms FROM timed WHERE start_ms IS NOT NULL),
    {merged_sql('iv', 'evidence_id')},
    i AS (SELECT evidence_id, count(*) AS ni, min(start_ms) AS s, max(end_ms) AS e FROM merged GROUP BY evidence_id),
    f AS (SELECT evidence_id, count(DISTINCT frame_ms) AS nf, min(frame_ms) AS f FROM timed WHERE frame_ms IS NOT NULL GROUP BY evidence_id),
    j AS (SELECT coalesce(i.evidence_id, f.evidence_id) AS evidence_id, coalesce(ni, 0) AS ni, coalesce(nf, 0) AS nf, s, e, f FROM i FULL JOIN f ON i.evidence_id = f.evidence_id)
    SELECT evidence_id, CASE WHEN ni = 1 THEN s END AS start_ms, CASE WHEN ni = 1 THEN e END AS end_ms, CASE WHEN ni = 0 AND nf = 1 THEN f END AS frame_ms,
      CASE WHEN ni = 1 OR (ni = 0 AND nf = 1) THEN 0 WHEN ni > 0 THEN ni ELSE nf END AS n_listed FROM j""",
)
def _(spark, sf):
    return L.temporal_bounds(timed_rows(spark, sf), ["evidence_id"])


@query(
    "temporal_interval_list",
    f"""WITH {TIMED_SQL}, iv AS (SELECT evidence_id, seq, start_ms, coalesce(end_ms, start_ms) AS end_ms FROM timed WHERE start_ms IS NOT NULL),
    {merged_sql('iv', 'evidence_id')},
    f AS (SELECT DISTINCT evidence_id, frame_ms AS start_ms, frame_ms AS end_ms FROM timed WHERE frame_ms IS NOT NULL AND evidence_id NOT IN (SELECT evidence_id FROM merged)),
    u AS (SELECT evidence_id, start_ms, end_ms FROM merged UNION ALL SELECT * FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY start_ms) AS p, count(*) OVER (PARTITION BY evidence_id) AS c FROM u)
    SELECT evidence_id, (p - 1) // {PART} AS part, string_agg(start_ms || '-' || end_ms, ' ' ORDER BY p) AS intervals FROM n WHERE c > 1 GROUP BY ALL""",
)
def _(spark, sf):
    listed = L.temporal_intervals(timed_rows(spark, sf), ["evidence_id"], part=PART)
    shown = F.transform("intervals", lambda i: F.concat_ws("-", i["start_ms"], i["end_ms"]))
    return listed.select("evidence_id", "part", F.array_join(shown, " ").alias("intervals"))


@query(
    "evidence_digest",
    f"""WITH {B.OBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY seq) AS p, count(*) OVER (PARTITION BY evidence_id) AS n FROM obs),
    d AS (SELECT evidence_id, max(n) AS n_observations, string_agg('[' || CASE WHEN seq % 5 = 0 THEN 'frame ' || printf('%.2f', time_start_s) || 's' WHEN seq % 5 = 1 OR (seq % 5 <> 2 AND time_start_s = time_end_s) THEN printf('%.2f', time_start_s) || 's'
       WHEN seq % 5 = 2 THEN printf('%.2f', time_end_s) || 's' ELSE printf('%.2f', time_start_s) || '-' || printf('%.2f', time_end_s) || 's' END
       || ' | a' || seq || ' | b] ' || predicate, chr(10) ORDER BY p) AS t, count(*) AS shown FROM r WHERE p <= 2 GROUP BY evidence_id)
    SELECT evidence_id, n_observations, substr(t, 1, 2000) || CASE WHEN n_observations > shown THEN chr(10) || '... ' || (n_observations - shown) || ' additional linked observation(s).' ELSE '' END AS digest FROM d""",
)
def _(spark, sf):
    refs = F.array(F.concat(F.lit("a"), "seq"), F.lit("b"), F.lit("c"))
    return L.evidence_digest(half_timed(B.observations(spark, sf)).withColumn("refs", refs), "evidence_id", "predicate", "refs", shown=2)


def half_timed(rows):
    """Of five rows one has only a frame time, one only a start and one only an end."""
    kind = F.col("seq") % 5
    start, end = F.col("start_ms"), F.col("end_ms")
    return rows.withColumns({"frame_ms": F.when(kind == 0, start), "start_ms": F.when(~kind.isin(0, 2), start), "end_ms": F.when(~kind.isin(0, 1), end)})


AUDIT_SQL = """audits AS (SELECT l.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' ELSE 'FAIL' END AS verdict, CASE WHEN l.doc_id % 11 = 0 THEN 1 ELSE 0 END AS missing,
   CASE l.doc_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' ELSE 'LOW' END AS severity, CASE WHEN l.doc_id % 5 = 0 THEN 'Reading_Gap' ELSE 'STYLE' END AS category, d.text AS message
   FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def audits(spark, sf):
    """Labels as audits; the labelled document is the message of the only finding."""
    d = F.col("doc_id")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").otherwise("FAIL")
    joined = B.table(spark, sf, "labels").join(B.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    finding = F.struct(
        F.when(d % 3 == 0, "HIGH").when(d % 3 == 1, "medium").otherwise("LOW").alias("severity"),
        F.when(d % 5 == 0, "Reading_Gap").otherwise("STYLE").alias("category"),
        F.col("text").alias("message"),
    )
    missing = F.when(d % 11 == 0, F.array(F.lit("when"))).otherwise(F.array().cast("array<string>"))
    return joined.select("doc_id", verdict.alias("verdict"), missing.alias("missing"), F.array(finding).alias("findings"))


BLOCK_SQL = (
    "(upper(trim(severity)) IN ('HIGH', 'MEDIUM') AND (upper(trim(category)) IN ("
    + ", ".join(f"'{c}'" for c in L.BLOCKING_CATEGORIES)
    + ") OR "
    + " OR ".join(f"contains(lower(message), '{w}')" for w in L.BLOCKING_WORDS)
    + "))"
)


@query("audit_acceptance", f"WITH {AUDIT_SQL} SELECT doc_id, upper(verdict) = 'PASS' AND missing = 0 AND NOT {BLOCK_SQL} AS accepted FROM audits")
def _(spark, sf):
    a = audits(spark, sf)
    return a.select("doc_id", L.audit_accepted(F.col("verdict"), F.col("missing"), F.col("findings")).alias("accepted"))


@query("blocking_finding_flag", f"WITH {AUDIT_SQL} SELECT doc_id, {BLOCK_SQL} AS blocking FROM audits")
def _(spark, sf):
    f = F.col("findings")[0]
    return audits(spark, sf).select("doc_id", L.blocking_finding(f["severity"], f["category"], f["message"]).alias("blocking"))


@query("status_rollup", "SELECT o_custkey, CASE WHEN bool_and(o_orderstatus IN ('O', 'F')) THEN 'ok' ELSE 'fail' END AS status FROM orders GROUP BY o_custkey")
def _(spark, sf):
    ok = F.bool_and(F.col("o_orderstatus").isin("O", "F"))
    return B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.when(ok, "ok").otherwise("fail").alias("status"))


@query(
    "round_summary",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS tool, CASE WHEN l_quantity > 25 THEN 'PASS' ELSE 'FAIL' END AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem)
    SELECT l_orderkey AS round_id, pos // {PART} AS part, string_agg(tool, ',' ORDER BY pos) AS tools, count(*) AS n_steps, any_value(verdict) AS verdict
    FROM s JOIN (SELECT l_orderkey AS k, arg_max(v, pos) AS verdict FROM s GROUP BY l_orderkey) ON k = l_orderkey GROUP BY l_orderkey, pos // {PART}""",
)
def _(spark, sf):
    return round_summary(steps_of(spark, sf))


def steps_of(spark, sf):
    """Lines as executed steps with a running number inside their order."""
    lines = B.table(spark, sf, "lineitem")
    # A hash of the whole row gives equal line numbers a fixed order.
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = lines.select(
        F.col("l_orderkey").alias("round_id"),
        F.col("l_linenumber").alias("line"),
        order.alias("order"),
        F.concat("l_returnflag", "l_linestatus").alias("tool"),
        F.when(F.col("l_quantity") > 25, "PASS").otherwise("FAIL").alias("verdict"),
    )
    return rows


@query(
    "result_item_counts",
    r"""WITH c AS (SELECT doc_id, len(string_split(text, ' ')) AS clips, len(regexp_extract_all(text, '\d+')) AS frames, len(string_split(text, chr(10))) AS reads, len(regexp_extract_all(text, '[A-Z]+')) AS segments FROM documents),
    u AS (SELECT doc_id, unnest(['clips', 'frames', 'reads', 'segments']) AS field, unnest([clips, frames, reads, segments]) AS n FROM c)
    SELECT doc_id, field, n FROM u WHERE n > 0""",
)
def _(spark, sf):
    lists = {
        "clips": F.split("text", " "),
        "frames": F.regexp_extract_all("text", F.lit(r"\d+"), 0),
        "reads": F.split("text", "\n"),
        "segments": F.regexp_extract_all("text", F.lit("[A-Z]+"), 0),
        "captions": F.lit(None).cast("array<string>"),
        "regions": F.array().cast("array<string>"),
    }
    counts = B.table(spark, sf, "documents").select("doc_id", F.explode(result_item_counts(lists)).alias("field", "n"))
    return counts.withColumn("n", F.col("n").cast("long"))


@query(
    "transcript_text",
    f"WITH {B.SEGMENTS_SQL} SELECT transcript_id, seg_idx // {PART} AS part, trim(string_agg(trim(text), ' ' ORDER BY seg_idx)) AS text, count(*) AS n_segments FROM seg GROUP BY ALL",
)
def _(spark, sf):
    return transcript_text(B.segments(spark, sf))


@query(
    "transcript_render",
    rf"""WITH {B.SEGMENTS_SQL}, l AS (SELECT transcript_id, seg_idx, '[' || {SECONDS_SQL.format('(start_ms / 1000.0::DOUBLE)')} || '-' || {SECONDS_SQL.format('(end_ms / 1000.0::DOUBLE)')} || '] '
      || CASE WHEN transcript_id % 4 = 0 THEN '' ELSE speaker_id || ': ' END || regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS line FROM seg WHERE regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') <> ''),
    b AS (SELECT transcript_id, seg_idx // {PART} AS part, string_agg(line, chr(10) ORDER BY seg_idx) AS body FROM l GROUP BY ALL)
    SELECT transcript_id, part, 'Transcript ' || transcript_id || ':' || chr(10) || body AS block FROM b""",
)
def _(spark, sf):
    speaker = F.when(F.col("transcript_id") % 4 == 0, F.lit("Unknown_Speaker")).otherwise(F.col("speaker_id"))
    return transcript_render(B.segments(spark, sf).withColumn("speaker_id", speaker))


@query(
    "captions_summary",
    rf"""WITH c AS (SELECT conv_id, turn, text, role FROM conversations)
    SELECT conv_id AS video_id, turn // {PART} AS part, string_agg(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') || '; actions: ' || role || '; objects: turn' || turn || ', x', ' ' ORDER BY turn) AS summary FROM c GROUP BY ALL""",
)
def _(spark, sf):
    captions = B.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("idx"),
        F.col("text").alias("visual"),
        F.lit("--").alias("audio"),
        F.lit("").alias("on_screen_text"),
        F.array("role", F.upper("role")).alias("actions"),
        F.array(F.concat(F.lit("turn"), "turn"), F.lit("x"), F.lit("X"), F.lit("?!")).alias("objects"),
        F.array().cast("array<string>").alias("attributes"),
    )
    return captions_summary(captions)


@query(
    "frame_sequence_context",
    f"""WITH {B.FRAMES_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t_ms, seq) AS p FROM fr),
    h AS (SELECT video_id, min(t_ms) AS a FROM fr GROUP BY video_id)
    SELECT t.video_id, 'Frames in time order around ' || {SECONDS_SQL.format('(max(a) / 1000.0::DOUBLE)')} || '. Radius 2s. Times: ' || string_agg({SECONDS_SQL.format('(t_ms / 1000.0::DOUBLE)')}, ', ' ORDER BY p) || '.' AS context
    FROM t JOIN h ON t.video_id = h.video_id WHERE p <= 12 GROUP BY t.video_id""",
)
def _(spark, sf):
    frames = B.scored_frames(spark, sf).withColumns({"anchor_ms": F.col("t_ms"), "radius_ms": F.lit(2000)})
    return frame_sequence_context(frames, ["video_id"])


@query(
    "final_result_rollup",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS tool, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem),
    p AS (SELECT l_orderkey, pos // {PART} AS part, string_agg(tool, ',' ORDER BY pos) AS tools, count(*) AS n_steps FROM r GROUP BY ALL)
    SELECT o_orderkey AS run_id, o_orderpriority AS answer, CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'FAIL' END AS verdict, coalesce(part, 0) AS part, coalesce(tools, '') AS tools, coalesce(n_steps, 0) AS n_steps FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""",
)
def _(spark, sf):
    runs = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("answer"),
        F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL").alias("verdict"),
    )
    steps = round_summary(steps_of(spark, sf)).select(F.col("round_id").alias("run_id"), "part", "tools", "n_steps")
    return result_parts(runs, steps)


@query(
    "merge_group_outputs",
    rf"""WITH s AS (SELECT conv_id, turn, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text, role = 'assistant' AS has FROM conversations)
    SELECT conv_id AS request_id, turn // 3 AS part, coalesce(string_agg(CASE WHEN text <> '' THEN text END, chr(10) || chr(10) ORDER BY turn), '') AS text,
      coalesce(string_agg(CASE WHEN has THEN 'clip' || turn END, ',' ORDER BY turn), '') AS clips, count(*) AS groups, any_value(absent) AS query_absent
    FROM s JOIN (SELECT conv_id AS c, NOT bool_or(has) AS absent FROM s GROUP BY conv_id) ON c = conv_id GROUP BY conv_id, turn // 3""",
)
def _(spark, sf):
    clip = F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("clip"), "turn"))).otherwise(F.array().cast("array<string>"))
    groups = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("idx"), "text", clip.alias("clips"))
    merged = merge_group_outputs(groups, 3)
    return merged.select("request_id", "part", "text", F.array_join("clips", ",").alias("clips"), "groups", "query_absent")


@query(
    "label_memory",
    f"""WITH {B.OBS_SQL}, {merged_sql('obs', 'predicate')}, c AS (SELECT predicate, count(*) AS mentions, string_agg(DISTINCT CASE WHEN seq % 2 = 0 THEN 'visual' ELSE 'audio' END, ',' ORDER BY CASE WHEN seq % 2 = 0 THEN 'visual' ELSE 'audio' END) AS modalities FROM obs GROUP BY predicate)
    SELECT m.predicate AS label, start_ms, end_ms, n, mentions, modalities FROM merged m JOIN c ON m.predicate = c.predicate""",
)
def _(spark, sf):
    modality = F.when(F.col("seq") % 2 == 0, "visual").otherwise("audio")
    return label_memory(B.observations(spark, sf).withColumn("modality", modality).withColumn("label", F.col("predicate")))


@query(
    "timing_rollup",
    f"""WITH {B.OBS_SQL} SELECT predicate AS tool, count(*) AS n, round(sum(round(numeric_value * 100)::BIGINT) / count(*)::DOUBLE, 4) AS mean_cs, median(round(numeric_value * 100)::BIGINT) AS median_cs,
      min(round(numeric_value * 100)::BIGINT) AS min_cs, max(round(numeric_value * 100)::BIGINT) AS max_cs FROM obs GROUP BY predicate""",
)
def _(spark, sf):
    rows = B.observations(spark, sf).select(F.col("predicate").alias("tool"), F.round(F.col("numeric_value") * 100).cast("long").alias("cs"))
    return timing_rollup(rows, "cs")


@query(
    "ledger_by_subject",
    f"""WITH {B.OBS_SQL} SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY start_ms, seq) AS line_no,
      '- [' || {SECONDS_SQL.format('time_start_s')} || CASE WHEN time_start_s = time_end_s THEN '' ELSE ' to ' || {SECONDS_SQL.format('time_end_s')} END || '] ' || predicate AS line FROM obs""",
)
def _(spark, sf):
    return ledger_by_subject(B.observations(spark, sf))

