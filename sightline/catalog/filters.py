"""Filters, predicates and compact projections as table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import tables as B
from sightline.catalog.aggregates import AUDIT_SQL, audits
from sightline.catalog.columns import page_files
from sightline.catalog.registry import query
from sightline.operators.runs import evidence_summary
from sightline.functions import markers, text, vectors
from sightline.functions.text import WS
from sightline.operators import filters as P
from sightline.operators import intervals as I
from sightline.operators import ledger as L


@query(
    "task_validity_filter",
    "SELECT item_id, item_id % 7 <> 0 AND item_id % 5 <> 0 AND trim(text) <> '' AS valid FROM benchmark",
)
def _(spark, sf):
    tasks = B.table(spark, sf, "benchmark").select(
        "item_id",
        F.lit("quiz").alias("benchmark"),
        F.when(F.col("item_id") % 7 != 0, F.concat(F.lit("k"), "item_id")).alias("sample_key"),
        F.when(F.col("item_id") % 5 == 0, F.lit(" \t")).otherwise(F.lit("v.mp4")).alias("video_path"),
        F.col("text").alias("question"),
    )
    return P.require_text(tasks, ["benchmark", "sample_key", "video_path", "question"]).flagged.select("item_id", "valid")


@query(
    "interval_validity_filter",
    f"WITH {B.OBS_SQL} SELECT seq, CASE WHEN seq % 4 = 0 THEN FALSE WHEN seq % 7 = 0 THEN start_ms >= end_ms ELSE TRUE END AS valid FROM obs",
)
def _(spark, sf):
    q = F.col("seq")
    start = F.when(q % 7 == 0, F.col("end_ms")).otherwise(F.col("start_ms"))
    end = F.when(q % 4 == 0, F.lit(None)).when(q % 7 == 0, F.col("start_ms")).otherwise(F.col("end_ms"))
    rows = B.observations(spark, sf).select("seq", start.alias("start_ms"), end.alias("end_ms"))
    return I.valid_intervals(rows).flagged.select("seq", "valid")


@query(
    "bbox_validity",
    f"""WITH {B.BOXES_SQL} SELECT seq, CASE WHEN seq % 4 = 0 OR seq % 5 = 1 THEN NULL ELSE b1 END AS x1, CASE WHEN seq % 4 = 0 OR seq % 5 = 1 THEN NULL ELSE b4 END AS y2 FROM bx""",
)
def _(spark, sf):
    words = F.transform("bbox", lambda v: v.cast("string"))
    raw = (
        F.when(F.col("seq") % 4 == 0, F.slice(words, 1, 3))
        .when(F.col("seq") % 5 == 1, F.concat(F.slice(words, 1, 3), F.array(F.lit("wide"))))
        .otherwise(words)
    )
    rows = B.boxes(spark, sf).select("seq", vectors.valid_box(raw).alias("b"))
    return rows.select("seq", F.col("b")[0].alias("x1"), F.col("b")[3].alias("y2"))


@query(
    "evidence_status_check",
    """WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' Validated ' WHEN 1 THEN '' WHEN 2 THEN 'provisional' WHEN 3 THEN NULL ELSE event_type END AS status FROM events),
    n AS (SELECT event_id, CASE WHEN trim(coalesce(status, '')) = '' THEN 'candidate' ELSE lower(trim(status)) END AS status FROM s)
    SELECT event_id, status, status IN ('candidate','validated','refuted','irrelevant','superseded','stale','unknown') AS valid FROM n""",
)
def _(spark, sf):
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, F.lit(" Validated ")).when(e % 5 == 1, F.lit("")).when(e % 5 == 2, F.lit("provisional")).when(e % 5 == 4, F.col("event_type"))
    rows = B.table(spark, sf, "events").select("event_id", raw.alias("status"))
    return L.check_status(rows).flagged


@query(
    "request_context_filter",
    """WITH r AS (SELECT doc_id, doc_id % 5 AS k FROM documents)
    SELECT doc_id, CASE WHEN k IN (0, 3) THEN 2 ELSE 0 END AS n_clips, CASE WHEN k = 2 THEN 1 ELSE 0 END AS n_hints, k <> 4 AS valid FROM r""",
)
def _(spark, sf):
    k = F.col("doc_id") % 5
    none = F.array().cast("array<string>")
    two = F.array(F.lit("a"), F.lit("b"))
    requests = B.table(spark, sf, "documents").select(
        "doc_id",
        F.when(k.isin(0, 1, 3), two).otherwise(none).alias("clips"),
        F.when(k == 1, two).otherwise(none).alias("frames"),
        none.alias("regions"),
        F.when(k == 2, F.array(F.lit(" "), F.lit("6s"))).otherwise(F.array(F.lit(" "))).alias("time_hints"),
    )
    out = P.request_context(requests).flagged
    return out.select("doc_id", F.size("clips").alias("n_clips"), F.size("time_hints").alias("n_hints"), "valid")


@query(
    "observation_filter",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL} SELECT o.seq, ev.status FROM obs o LEFT JOIN ev ON o.evidence_id = ev.evidence_id
    WHERE contains(subject, 'user_1') AND predicate = 'click' AND ev.status = 'validated' AND (o.seq % 3 = 0 OR o.end_ms >= 100000000) AND o.start_ms <= 2000000000""",
)
def _(spark, sf):
    obs = B.observations(spark, sf).withColumnRenamed("predicate", "source_tool")
    obs = obs.withColumn("end_ms", F.when(F.col("seq") % 3 != 0, F.col("end_ms")))
    joined = obs.join(B.evidence(spark, sf).select("evidence_id", "status"), "evidence_id", "left")
    return P.observation_filter(joined, "USER_1", "click", "Validated", 100_000_000, 2_000_000_000).select("seq", "status")


def low_sql(column: str) -> str:
    v = f"regexp_replace({column}, '{WS}+', '', 'g')"
    a = rf"lower(regexp_replace({v}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
    one = "(length({0}) >= 8 AND replace({0}, left({0}, 1), '') = '')"
    return f"({a} = '' OR {one.format(v)} OR {one.format(a)})"


LINES_SQL = "ln AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


def lines(spark, sf):
    docs = B.table(spark, sf, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("low_signal_filter", f"WITH {LINES_SQL} SELECT doc_id, pos, line FROM ln WHERE NOT {low_sql('line')}")
def _(spark, sf):
    return lines(spark, sf).filter(~text.is_low_signal(F.col("line")))


@query(
    "meaningful_text_filter",
    rf"""WITH w AS (SELECT doc_id, unnest(range(len(string_split(text, '. ')))) AS pos, unnest(string_split(text, '. ')) AS piece FROM documents)
    SELECT doc_id, pos, piece FROM w WHERE NOT {low_sql('piece')} AND (length(regexp_replace(piece, '[^A-Za-z0-9]+', '', 'g')) >= 6 OR len(regexp_extract_all(piece, '[A-Za-z0-9]+')) >= 2)""",
)
def _(spark, sf):
    rows = B.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "piece"))
    return rows.filter(text.is_meaningful(F.col("piece"))).withColumn("pos", F.col("pos").cast("long"))


@query(
    "drop_low_signal_answers",
    f"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '!!!!!!!!!!' ELSE text END AS answer, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS analysis, CASE WHEN turn % 6 = 3 THEN ['--', 'zzzzzzzzz'] WHEN turn % 6 = 0 THEN ['ok then'] ELSE [] END AS points FROM conversations),
    f AS (SELECT *, {low_sql('answer')} AND {low_sql('analysis')} AND turn % 6 <> 0 AS low FROM a)
    SELECT conv_id, turn, low AS low_signal, CASE WHEN low THEN '' ELSE answer END AS answer, CASE WHEN low THEN 0 ELSE len(points) END AS n_points FROM f""",
)
def _(spark, sf):
    t = F.col("turn")
    rows = B.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(t % 3 == 0, F.lit("!" * 10)).otherwise(F.col("text")).alias("answer"),
        F.when(t % 3 == 0, F.lit("")).otherwise(F.col("role")).alias("analysis"),
        F.when(t % 6 == 3, F.array(F.lit("--"), F.lit("z" * 9)))
        .when(t % 6 == 0, F.array(F.lit("ok then")))
        .otherwise(F.array().cast("array<string>"))
        .alias("points"),
    )
    out = P.blank_low_signal_answers(rows, ["answer", "analysis"], ["points"])
    return out.select("conv_id", "turn", "low_signal", "answer", F.size("points").cast("long").alias("n_points"))


def trunc_sql(column: str, limit: int) -> str:
    s = f"trim(regexp_replace({column}, '{WS}+', ' ', 'g'))"
    return f"CASE WHEN length({s}) <= {limit} THEN {s} ELSE rtrim(substr({s}, 1, {limit - 3})) || '...' END"


@query(
    "compact_request_projection",
    f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
    SELECT doc_id, CASE WHEN {trunc_sql('text', 180)} <> '' THEN {trunc_sql('text', 180)} END AS query, array_to_string(list_transform(l[1:4], lambda x: {trunc_sql('x', 80)}), '|') AS hints,
      array_to_string(list_transform(l[1:3], lambda x: {trunc_sql('x', 120)}), '|') AS contexts, array_to_string(list_transform(range(least(doc_id % 9, 6)), lambda i: 'ev_' || i), '|') AS ids, least(doc_id % 5, 3) AS n_clips FROM d""",
)
def _(spark, sf):
    parts = F.split("text", "\n")
    many = lambda n: F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    ids = F.transform(many(F.col("doc_id") % 9), lambda i: F.concat(F.lit("ev_"), i))
    clips = F.transform(many(F.col("doc_id") % 5), lambda i: F.struct(i.alias("start_s"), (i + 1).alias("end_s")))
    rows = B.table(spark, sf, "documents").select("doc_id", P.compact_request(F.col("text"), parts, parts, ids, clips).alias("r"))
    return rows.select(
        "doc_id",
        "r.query",
        F.array_join("r.time_hints", "|").alias("hints"),
        F.array_join("r.text_contexts", "|").alias("contexts"),
        F.array_join("r.evidence_ids", "|").alias("ids"),
        F.size("r.clips").cast("long").alias("n_clips"),
    )


@query(
    "compact_result_projection",
    f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {trunc_sql('text', 220)} WHEN 1 THEN 'found in ' || source ELSE lang END AS summary, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 4 END AS observation_count,
      len(string_split(text, chr(10))) AS clip_count, least(3, len(string_split(text, chr(10)))) AS n_returned FROM documents""",
)
def _(spark, sf):
    d = F.col("doc_id")
    sources = [F.when(d % 3 == 0, F.col("text")), F.when(d % 3 == 1, F.concat(F.lit("found in "), "source")).otherwise(""), F.lit(""), F.col("lang")]
    none = F.array().cast("array<string>")
    rows = B.table(spark, sf, "documents").select("doc_id", P.compact_result(sources, F.split("text", "\n"), none, d % 4).alias("r"))
    return rows.select(
        "doc_id",
        "r.summary",
        "r.observation_count",
        F.col("r.clip_count").cast("long").alias("clip_count"),
        F.size("r.returned_clips").cast("long").alias("n_returned"),
    )


@query(
    "evidence_summary_projection",
    f"""WITH {B.OBS_SQL}, {B.EVIDENCE_SQL}, e AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY seq DESC) <= 10),
    o AS (SELECT evidence_id, observation_id, row_number() OVER (PARTITION BY evidence_id ORDER BY seq) AS p FROM obs)
    SELECT e.video_id, e.evidence_id, e.tool_name, CASE WHEN e.status = 'provisional' THEN 'candidate' ELSE e.status END AS status, string_agg(observation_id, ',' ORDER BY p) AS observation_ids
    FROM e JOIN o ON e.evidence_id = o.evidence_id AND p <= 12 GROUP BY ALL""",
)
def _(spark, sf):
    return evidence_summary(B.evidence(spark, sf), B.observations(spark, sf))


@query(
    "audit_feedback_projection",
    f"""WITH {AUDIT_SQL} SELECT doc_id, upper(verdict) AS verdict, upper(severity) || '/' || category || '/' || trim(regexp_replace(message, '{WS}+', ' ', 'g')) || '/a,b' AS finding, missing = 1 AS has_missing FROM audits""",
)
def _(spark, sf):
    rows = audits(spark, sf)
    ids = F.array(F.lit("b"), F.lit(" "), F.lit("a"), F.lit("b"))
    findings = F.transform("findings", lambda f: F.struct(f["severity"].alias("severity"), f["category"].alias("category"), f["message"].alias("message"), ids.alias("evidence_ids")))
    blank = F.struct(F.lit("HIGH").alias("severity"), F.lit(" ").alias("category"), F.lit("").alias("message"), ids.alias("evidence_ids"))
    missing = F.concat("missing", F.array(F.lit(" ")), "missing")
    fb = rows.select("doc_id", P.audit_feedback(F.col("verdict"), F.concat(findings, F.array(blank)), missing).alias("f"))
    first = F.col("f.findings")[0]
    return fb.select(
        "doc_id",
        "f.verdict",
        F.concat_ws("/", first["severity"], first["category"], first["message"], F.array_join(first["evidence_ids"], ",")).alias("finding"),
        (F.size("f.missing_information") == 1).alias("has_missing"),
    )


def any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


NORM_SQL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query("structured_context_flag", f"SELECT doc_id, {any_sql(NORM_SQL.format('text'), markers.STRUCTURED_WORDS)} AS structured FROM documents")
def _(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", markers.structured_query(F.col("text")).alias("structured"))


@query(
    "audio_query_mode",
    f"""WITH q AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Which, sounds? ' || text WHEN doc_id % 9 = 0 THEN ' ?! ' ELSE text END AS q FROM documents)
    SELECT doc_id, CASE WHEN {NORM_SQL.format('q')} = '' OR {any_sql(NORM_SQL.format('q'), markers.INVENTORY_PHRASES)} THEN 'inventory' ELSE 'targeted' END AS mode FROM q""",
)
def _(spark, sf):
    d = F.col("doc_id")
    q = F.when(d % 4 == 0, F.concat(F.lit("Which, sounds? "), "text")).when(d % 9 == 0, F.lit(" ?! ")).otherwise(F.col("text"))
    return B.table(spark, sf, "documents").select("doc_id", markers.audio_mode(q).alias("mode"))


QUESTION_SQL = """q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'What happens FIRST, and after that? ' WHEN 1 THEN 'Name the relationship  between the last two. ' ELSE '' END || text AS q FROM documents)"""


def questions(spark, sf):
    d = F.col("doc_id")
    lead = F.when(d % 4 == 0, "What happens FIRST, and after that? ").when(d % 4 == 1, "Name the relationship  between the last two. ").otherwise("")
    return B.table(spark, sf, "documents").select("doc_id", F.concat(lead, "text").alias("q"))


@query(
    "question_structure_tags",
    rf"""WITH {QUESTION_SQL}, l AS (SELECT doc_id, lower(trim(regexp_replace(q, '{WS}+', ' ', 'g'))) AS q FROM q),
    f AS (SELECT doc_id, len(regexp_extract_all(q, '{markers.ORDER_WORDS}')) >= 2 AS a, contains(q, 'relation between') OR contains(q, 'relationship between') AS b, regexp_matches(q, '{markers.ORDINAL_SLOT}') AS c FROM l)
    SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'several_order_words' END, CASE WHEN b THEN 'relation' END, CASE WHEN (a OR b) AND c THEN 'ordinal_slot' END) AS tags FROM f""",
)
def _(spark, sf):
    return questions(spark, sf).select("doc_id", F.array_join(markers.question_tags(F.col("q")), ",").alias("tags"))


@query(
    "conditioned_audio_flag",
    rf"""WITH q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Which noise is heard while ' || text || ' someone is pouring' ELSE text || ' music when playing' END AS q FROM documents),
    l AS (SELECT doc_id, lower(trim(regexp_replace(q, '{WS}+', ' ', 'g'))) AS q FROM q)
    SELECT doc_id, regexp_matches(q, '{markers.SOUND_WORDS}') AND regexp_matches(q, '{markers.MEANWHILE_ACTION}') AS conditioned FROM l""",
)
def _(spark, sf):
    q = F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit("Which noise is heard while "), F.col("text"), F.lit(" someone is pouring"))
    ).otherwise(F.concat("text", F.lit(" music when playing")))
    return B.table(spark, sf, "documents").select("doc_id", markers.conditioned_audio(q).alias("conditioned"))


@query(
    "time_hint_flags",
    rf"""WITH {B.HINTS_SQL} SELECT doc_id, regexp_matches(hint, '{markers.EXACT_TIME}') AS exact, regexp_matches(hint, '{markers.EXACT_TIME + markers.ANCHOR_WORDS}') AS anchorable,
      regexp_matches(hint, '{markers.PLACEHOLDER_TIME}') AS placeholder, regexp_matches(hint, '{markers.SPEECH_WORDS}') AS speech FROM hints""",
)
def _(spark, sf):
    flags = markers.hint_flags(F.col("hint"))
    return B.hints(spark, sf).select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "image_artifact_filter",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[^?#]*') || CASE page_id % 7 WHEN 0 THEN '.PNG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.flac' WHEN 3 THEN '.json' WHEN 4 THEN '.md' WHEN 5 THEN '.zip' ELSE '' END AS path FROM pages)
    SELECT page_id, path FROM u WHERE page_id % 7 = 0 OR page_id % 11 = 0 OR page_id % 13 = 0""",
)
def _(spark, sf):
    p = F.col("page_id")
    files = page_files(spark, sf).select(
        "page_id", "path", F.when(p % 11 == 0, " Frame ").alias("kind"), F.when(p % 13 == 0, "image/x").otherwise("text").alias("media_type")
    )
    return files.filter(markers.is_image_artifact(F.col("kind"), F.col("media_type"), F.col("path"))).select("page_id", "path")
