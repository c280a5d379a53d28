"""Column functions as table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import tables as B
from sightline.catalog.registry import query
from sightline.functions.text import WS, band, letter_options, verdict
from sightline.functions.timing import intervals_sentence
from sightline.operators.frames import frame_rows
from sightline.operators import lookups as J
from sightline.operators.lines import evidence_line, media_line
from sightline.operators.observe import atomic_chunks
from sightline.functions import ids, jsons, text, timing, vectors

# ---------------------------------------------------------------- text


@query("normalize_phrase", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS phrase FROM documents")
def _(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", text.normalize_phrase(F.col("text")).alias("phrase"))


@query(
    "truncate_text",
    rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS s,
                    regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS p FROM documents)
    SELECT doc_id, CASE WHEN length(s) <= 220 THEN s ELSE rtrim(substr(s, 1, 217)) || '...' END AS short_dots,
      CASE WHEN length(p) <= 220 THEN p ELSE regexp_replace(substr(p, 1, 219), '{WS}+$', '') || '…' END AS short_mark,
      CASE WHEN length(s) <= 900 THEN s ELSE rtrim(substr(s, 1, 899)) || '.' END AS short_stop FROM d""",
)
def _(spark, sf):
    c = F.col("text")
    return B.table(spark, sf, "documents").select(
        "doc_id",
        text.truncate_text(c, 220, "...").alias("short_dots"),
        text.truncate_text(c, 220, "…", squeezed=False).alias("short_mark"),
        text.truncate_text(c, 900, ".").alias("short_stop"),
    )


SENTENCES_SQL = rf"""list_filter(list_transform(
    regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '[;\n]+'),
    lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '')"""


@query(
    "sentence_chunks",
    f"""WITH d AS (SELECT doc_id, {SENTENCES_SQL} AS l FROM documents)
    SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM d""",
)
def _(spark, sf):
    docs = B.table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(text.sentence_chunks(F.col("text"))).alias("pos", "sentence")).withColumn(
        "pos", F.col("pos").cast("long")
    )


PIECES_SQL = rf"""flatten(list_transform(flatten(list_transform({SENTENCES_SQL},
    lambda s: list_filter(list_transform(string_split(regexp_replace(
        trim(trim(regexp_replace(s, '{WS}+', ' ', 'g')), ' ,;'), ',\s+([A-Za-z0-9])', chr(1) || '\1', 'g'), chr(1)),
        lambda x: trim(x, ' ,;')), lambda x: x <> ''))),
    lambda p: CASE WHEN len(list_filter(list_transform(regexp_split_to_array(p, '\s+(?:and|but)\s+'), lambda x: trim(x, ' ,;')), lambda x: x <> '')) > 1
      THEN list_filter(list_transform(regexp_split_to_array(p, '\s+(?:and|but)\s+'), lambda x: trim(x, ' ,;')), lambda x: x <> '')
      ELSE [p] END))"""


@query(
    "atomic_chunks",
    f"""WITH d AS (SELECT doc_id, {PIECES_SQL} AS l FROM documents),
    x AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS chunk FROM d)
    SELECT doc_id, min(pos) AS pos, arg_min(chunk, pos) AS chunk FROM x GROUP BY doc_id, lower(chunk)""",
)
def _(spark, sf):
    return atomic_chunks(B.table(spark, sf, "documents"), "doc_id", "text")


def strip_sql(text_sql: str) -> str:
    return f"regexp_replace({text_sql}, '^{WS}+|{WS}+$', '', 'g')"


QUOTED_SQL = strip_sql("replace(s, chr(1), '''')")


@query(
    "quoted_phrases",
    # Without look-ahead: quotes that a letter or digit follows are marked first, so only the others can close.
    rf"""WITH d AS (SELECT doc_id, concat_ws(' ', 'the line "', regexp_split_to_array(text, '\s+')[1], regexp_extract(text, '(\S+)\s*$', 1), '" and ''it''s one phrase'' in', text) AS said FROM documents),
    q AS (SELECT doc_id, list_concat(list_filter(list_transform(regexp_extract_all(said, '"([^"\n]{{3,}})"', 1), lambda s: {strip_sql('s')}), lambda s: s <> ''),
      list_filter(list_transform(regexp_extract_all(regexp_replace(said, '''([\p{{L}}\p{{N}}])', chr(1) || '\1', 'g'), '(?s)[\x01''](.*?)''', 1), lambda s: {QUOTED_SQL}), lambda s: length(s) >= 3)) AS l FROM d),
    x AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS phrase FROM q),
    f AS (SELECT *, trim(regexp_replace(lower(phrase), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS form FROM x)
    SELECT doc_id, min(pos) AS pos, arg_min(phrase, pos) AS phrase FROM f WHERE form <> '' GROUP BY doc_id, form""",
)
def _(spark, sf):
    docs = B.table(spark, sf, "documents")
    said = F.concat_ws(
        " ",
        F.lit('the line "'),
        F.element_at(F.split("text", r"\s+"), 1),
        F.regexp_extract("text", r"(\S+)\s*$", 1),
        F.lit("\" and 'it's one phrase' in"),
        "text",
    )
    return J.quoted_phrases(docs.select("doc_id", said.alias("said")), ["doc_id"], "said")


@query(
    "numeric_from_text",
    rf"""WITH {B.HINTS_SQL}
    SELECT doc_id, TRY_CAST(replace(regexp_extract(hint, '[-+]?\$?\s*(\d+(?:,\d{{3}})*(?:\.\d+)?|\.\d+)\s*%?', 1), ',', '') AS DOUBLE) AS number
    FROM hints""",
)
def _(spark, sf):
    return B.hints(spark, sf).select("doc_id", text.numeric_from_text(F.col("hint")).alias("number"))


STEP_SQL = r"TRY_CAST(list_extract(regexp_extract_all({0}, '\d+'), -1) AS BIGINT)"


@query(
    "normalize_step_id",
    f"""WITH s AS (SELECT doc_id, 'step_' || doc_id AS a, text AS b FROM documents),
    n AS (SELECT doc_id, {STEP_SQL.format('a')} AS x, {STEP_SQL.format('b')} AS y FROM s)
    SELECT doc_id, CASE WHEN x > 0 THEN x END AS step_no, CASE WHEN y > 0 THEN y END AS text_no FROM n""",
)
def _(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id",
        text.step_number(F.concat(F.lit("step_"), "doc_id")).alias("step_no"),
        text.step_number(F.col("text")).alias("text_no"),
    )


@query(
    "coerce_confidence",
    """WITH r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN (event_id % 120) || '%' WHEN 1 THEN 'High'
        WHEN 2 THEN ' very low ' WHEN 3 THEN 'n/a' WHEN 4 THEN ((event_id % 130) / 100.0::DOUBLE)::VARCHAR
        WHEN 5 THEN event_type ELSE NULL END AS raw FROM events),
    n AS (SELECT event_id, CASE lower(trim(raw)) WHEN 'very low' THEN 0.1::DOUBLE WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5
        WHEN 'moderate' THEN 0.5 WHEN 'high' THEN 0.85 WHEN 'very high' THEN 0.95
        ELSE CASE WHEN trim(raw) LIKE '%\\%' ESCAPE '\\' THEN TRY_CAST(replace(trim(raw), '%', '') AS DOUBLE) / 100
             ELSE TRY_CAST(trim(raw) AS DOUBLE) END END AS c FROM r)
    SELECT event_id, CASE WHEN c BETWEEN 0 AND 1 THEN c END AS confidence FROM n""".replace("\\\\", "\\"),
)
def _(spark, sf):
    e = F.col("event_id")
    raw = (
        F.when(e % 7 == 0, F.concat(e % 120, F.lit("%")))
        .when(e % 7 == 1, F.lit("High"))
        .when(e % 7 == 2, F.lit(" very low "))
        .when(e % 7 == 3, F.lit("n/a"))
        .when(e % 7 == 4, ((e % 130) / F.lit(100.0)).cast("string"))
        .when(e % 7 == 5, F.col("event_type"))
    )
    return B.table(spark, sf, "events").select("event_id", text.coerce_confidence(raw).alias("confidence"))


@query(
    "band_scores",
    """WITH s AS (SELECT event_id, value / 20 AS a, (event_id % 11) / 2.0::DOUBLE AS b FROM events)
    SELECT event_id, greatest(1, least(5, round_even(a, 0)::INTEGER)) AS grounding,
           greatest(1, least(5, round_even(b, 0)::INTEGER)) AS clarity, 2 AS n_scores FROM s""",
)
def _(spark, sf):
    ev = B.table(spark, sf, "events")
    scores = F.create_map(
        F.lit("grounding"), (F.col("value") / 20).cast("string"),
        F.lit("clarity"), ((F.col("event_id") % 11) / F.lit(2.0)).cast("string"),
        F.lit("note"), F.col("event_type"),
    )
    return ev.withColumn("m", band(scores)).select(
        "event_id", F.col("m")["grounding"].alias("grounding"), F.col("m")["clarity"].alias("clarity"),
        F.size("m").alias("n_scores"),
    )


@query(
    "normalize_verdict",
    """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' pass ' WHEN 1 THEN 'Fail' ELSE event_type END AS raw FROM events)
    SELECT event_id, CASE WHEN upper(trim(raw)) IN ('PASS', 'FAIL') THEN upper(trim(raw)) ELSE 'FAIL' END AS verdict FROM r""",
)
def _(spark, sf):
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, F.lit(" pass ")).when(e % 3 == 1, F.lit("Fail")).otherwise(F.col("event_type"))
    return B.table(spark, sf, "events").select("event_id", verdict(raw).alias("verdict"))


@query(
    "media_type_of",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[^?#]*') ||
         CASE page_id % 7 WHEN 0 THEN '.PNG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.flac' WHEN 3 THEN '.json' WHEN 4 THEN '.md' WHEN 5 THEN '.zip' ELSE '' END AS path FROM pages),
    s AS (SELECT page_id, path, regexp_extract(lower(path), '[^/.]\.([^./]+)$', 1) AS x FROM u)
    SELECT page_id, path, CASE WHEN x IN ('png','jpg','jpeg','bmp','webp') THEN 'image' WHEN x IN ('mp4','mkv','mov','webm') THEN 'video'
      WHEN x IN ('wav','mp3','flac') THEN 'audio' WHEN x = 'json' THEN 'application/json' WHEN x IN ('txt','md','jsonl') THEN 'text/plain' END AS media_type FROM s""",
)
def _(spark, sf):
    return page_files(spark, sf).select("page_id", "path", text.media_type_of(F.col("path")).alias("media_type"))


def page_files(spark, sf):
    """Pages as files: the url without its query, with a suffix by page id."""
    tail = F.array(*[F.lit(s) for s in [".PNG", ".mp4", ".flac", ".json", ".md", ".zip", ""]])
    path = F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.element_at(tail, (F.col("page_id") % 7 + 1).cast("int")))
    return B.table(spark, sf, "pages").withColumn("path", path)


SANITIZE_SQL = r"""substr(CASE WHEN {0} = '' THEN 'item' ELSE {0} END, 1, 120)"""


@query(
    "sanitize_component",
    r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS a,
        regexp_replace(regexp_replace(html, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS b FROM pages)
    SELECT page_id, """
    + SANITIZE_SQL.format("a") + " AS url_name, " + SANITIZE_SQL.format("b") + " AS html_name FROM s",
)
def _(spark, sf):
    return B.table(spark, sf, "pages").select(
        "page_id",
        text.sanitize_component(F.col("url")).alias("url_name"),
        text.sanitize_component(F.col("html")).alias("html_name"),
    )


REDACT_SQL = r"""CASE WHEN {0} LIKE '/%' THEN '<redacted-path>' ELSE
    regexp_replace({0}, '(^|[^A-Za-z0-9._-])/[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*', '\1<redacted-path>', 'g') END"""


@query(
    "redact_paths",
    "WITH t AS (SELECT doc_id, text, 'see /data/' || source || '/file_' || doc_id || '.png, then /srv/app/run/' || doc_id || ' or /srv/app' AS note FROM documents), "
    r"u AS (SELECT doc_id, text, regexp_replace(note, '/srv/app/([A-Za-z0-9._-])', '\1', 'g') AS note FROM t) "
    f"SELECT doc_id, {REDACT_SQL.format('text')} AS text, {REDACT_SQL.format('note')} AS note, "
    """'{"list":[{"k":1},"a <redacted-path> b"],"meta":{"keep":' || doc_id || ',"note":"<redacted-path>"}}' AS record FROM u""",
)
def _(spark, sf):
    note = F.concat(
        F.lit("see /data/"), "source", F.lit("/file_"), "doc_id", F.lit(".png, then /srv/app/run/"), "doc_id", F.lit(" or /srv/app")
    )
    record = F.format_string(
        '{"path": "/x/y", "meta": {"frame_path": "f", "note": "/data/%d and more", "keep": %d}, "list": [{"video_path": ["v"], "k": 1}, "a /data/b b"], "source_path": null}',
        F.col("doc_id"), F.col("doc_id"),
    )
    return B.table(spark, sf, "documents").select(
        "doc_id",
        text.redact_paths(F.col("text")).alias("text"),
        text.redact_paths(note, root="/srv/app").alias("note"),
        text.redact_record(record).alias("record"),
    )


@query(
    "parse_list_field",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents),
    a AS (SELECT doc_id, w, doc_id % 4 AS k FROM w)
    SELECT doc_id, CASE WHEN len(w) > 0 THEN CASE WHEN k = 3 THEN array_to_string(w, ' ') ELSE array_to_string(w, chr(31)) END END AS items,
           CASE WHEN len(w) = 0 THEN -1 WHEN k = 3 THEN 1 ELSE len(w) END AS n_items FROM a""",
)
def _(spark, sf):
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    docs = B.table(spark, sf, "documents").withColumn("w", w)
    k = F.col("doc_id") % 4
    # Keys of one width, written from the last word to the first.
    keyed = F.map_from_entries(F.reverse(F.transform("w", lambda x, i: F.struct(F.lpad(i.cast("string"), 9, "0"), x))))
    raw = (
        F.when(k == 0, F.to_json(F.concat(F.slice("w", 1, 1), F.array(F.lit(" ")), F.expr("slice(w, 2, greatest(size(w) - 1, 0))"))))
        .when(k == 1, F.to_json(keyed))
        .when(k == 2, F.concat(F.array_join("w", "||"), F.lit("|| ")))
        .otherwise(F.array_join("w", " "))
    )
    parsed = docs.select("doc_id", text.parse_list_field(raw).alias("l"))
    return parsed.select("doc_id", F.array_join("l", "\x1f").alias("items"), F.coalesce(F.size("l"), F.lit(-1)).alias("n_items"))


# ---------------------------------------------------------------- time


COLON_SQL = r"(?:^|[^\d])(\d{1,3})((?::\d{1,2}){1,2})(\.\d+)?(?:[^\d]|$)"
TIMECODE_SQL = rf"""
tc0 AS (SELECT *, TRY_CAST(regexp_extract(lower(hint), '{COLON_SQL}', 1) AS DOUBLE) AS h0,
   string_split(regexp_extract(lower(hint), '{COLON_SQL}', 2), ':') AS p,
   coalesce(TRY_CAST(regexp_extract(lower(hint), '{COLON_SQL}', 3) AS DOUBLE), 0) AS f,
   coalesce(TRY_CAST(regexp_extract(lower(hint), '(?:frame|timestamp|time|at|around|near|second|sec|s)\s*(?:=|:)?\s*(\d+(?:\.\d+)?)\s*(?:seconds?|secs?|s)\b', 1) AS DOUBLE),
      TRY_CAST(regexp_extract(lower(hint), '(\d+(?:\.\d+)?)\s*(?:seconds?|secs?|s)\b', 1) AS DOUBLE)) AS plain FROM hints),
tc AS (SELECT *, coalesce(CASE WHEN p[3] IS NOT NULL THEN h0 * 3600.0::DOUBLE + p[2]::DOUBLE * 60.0::DOUBLE + p[3]::DOUBLE
   ELSE h0 * 60.0::DOUBLE + TRY_CAST(p[2] AS DOUBLE) END + f, plain) AS sec FROM tc0)"""


@query("parse_timecode", f"WITH {B.HINTS_SQL}, {TIMECODE_SQL} SELECT doc_id, sec FROM tc")
def _(spark, sf):
    return B.hints(spark, sf).select("doc_id", timing.parse_timecode(F.col("hint")).alias("sec"))


def _any_sql(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


ANCHOR_SQL = rf"""
an0 AS (SELECT *, trim(regexp_replace(lower(hint), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS w, 10.0::DOUBLE AS s, 10.0 + duration_s AS e, duration_s AS span,
   TRY_CAST(regexp_extract(hint, '(\d+(?:\.\d+)?)\s*%', 1) AS DOUBLE) AS pct FROM tc),
an AS (SELECT *, CASE WHEN w = '' THEN NULL WHEN pct IS NOT NULL THEN s + span * least(1.0::DOUBLE, pct / 100)
   WHEN sec IS NOT NULL AND {_any_sql('w', timing.HINT_AFTER)} THEN least(e, s + sec)
   WHEN sec IS NOT NULL AND {_any_sql('w', timing.HINT_BEFORE_END)} THEN greatest(s, e - sec)
   WHEN sec >= s AND sec <= e THEN sec
   WHEN sec <= span AND {_any_sql('w', timing.HINT_LOCAL)} THEN least(e, s + sec)
   WHEN {_any_sql('w', timing.HINT_START)} THEN s
   WHEN {_any_sql('w', timing.HINT_END)} THEN e
   WHEN {_any_sql('w', timing.HINT_MIDDLE)} THEN s + span / 2 END AS anchor_s FROM an0)"""


@query("time_hint_anchor", f"WITH {B.HINTS_SQL}, {TIMECODE_SQL}, {ANCHOR_SQL} SELECT doc_id, anchor_s FROM an")
def _(spark, sf):
    start = F.lit(10.0)
    end = start + F.col("duration_s")
    return B.hints(spark, sf).select("doc_id", timing.hint_anchor(F.col("hint"), start, end).alias("anchor_s"))


@query(
    "clip_from_time_hint",
    rf"""WITH {B.HINTS_SQL},
    h AS (SELECT doc_id, lower(hint) AS h, duration_s AS d,
       {_any_sql('lower(hint)', ['last', 'final', 'end'])} AS e, {_any_sql('lower(hint)', ['first', 'opening', 'start', 'beginning'])} AS s,
       contains(lower(hint), 'mid') AS m,
       TRY_CAST(regexp_extract(lower(hint), '(\d+(?:\.\d+)?)\s*%', 1) AS DOUBLE) AS pct,
       TRY_CAST(regexp_extract(lower(hint), '(\d+(?:\.\d+)?)\s*(?:seconds?|secs?|s)\b', 1) AS DOUBLE) AS sec FROM hints),
    w AS (SELECT *, greatest(1.0::DOUBLE, least(d, coalesce(CASE WHEN pct IS NOT NULL THEN d * greatest(0.01::DOUBLE, least(1.0::DOUBLE, pct / 100)) END, sec, d * 0.2::DOUBLE))) AS win FROM h)
    SELECT doc_id, CASE WHEN e THEN greatest(0, d - win) WHEN s THEN 0 WHEN m THEN greatest(0, d / 2 - win / 2) ELSE greatest(0, d - win) END AS start_s,
      CASE WHEN e THEN d WHEN s THEN least(d, win) WHEN m THEN least(d, greatest(0, d / 2 - win / 2) + win) ELSE d END AS end_s FROM w""",
)
def _(spark, sf):
    clips = B.hints(spark, sf).withColumn("clip", timing.hint_clip(F.col("hint"), F.col("duration_s")))
    return clips.select("doc_id", "clip.start_s", "clip.end_s")


@query(
    "anchor_scope_clip",
    f"""WITH {B.OBS_SQL}, a AS (SELECT seq, time_start_s AS s, time_end_s AS e, CASE seq % 4 WHEN 0 THEN time_start_s + seq % 40 WHEN 1 THEN seq % 60 + (seq % 3) * 60 WHEN 2 THEN time_start_s + seq % 40 END AS a,
        CASE seq % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 3 ELSE 2 END::DOUBLE AS r FROM obs),
    c AS (SELECT *, greatest(s, a - r) AS lo, least(e, a + r) AS hi FROM a)
    SELECT seq, CASE WHEN a IS NOT NULL AND hi > lo THEN lo ELSE s END AS start_s,
                CASE WHEN a IS NOT NULL AND hi > lo THEN hi ELSE e END AS end_s FROM c""",
)
def _(spark, sf):
    obs, n = B.observations(spark, sf), F.col("seq")
    # A time in the video, a timecode, a time from the clip's start, or no anchor; an own radius, the scope's, or neither.
    time_s = F.when(n % 4 == 0, F.col("time_start_s") + n % 40).when(n % 4 == 2, (n % 40).cast("double"))
    timecode = F.when(n % 4 == 1, F.format_string("at %d:%02d", n % 3, n % 60))
    reference = F.when(n % 4 == 2, F.when(n % 8 == 2, "Clip").otherwise("scope")).otherwise("")
    at = timing.anchor_time(time_s, timecode, reference, F.col("time_start_s"))
    radius = timing.anchor_radius(F.when(n % 3 == 0, F.lit(0.5)), F.when(n % 3 == 1, F.lit(3.0)).otherwise(F.lit(0.0)))
    clip = timing.anchor_scope(at, radius, F.col("time_start_s"), F.col("time_end_s"))
    return obs.withColumn("clip", clip).select("seq", "clip.start_s", "clip.end_s")


@query(
    "clamp_clip_bounds",
    f"""WITH {B.OBS_SQL}, r AS (SELECT seq, time_start_s - 5000 AS s, CASE WHEN seq % 3 = 0 THEN NULL ELSE time_end_s END AS e,
        2000000.0::DOUBLE AS d FROM obs)
    SELECT seq, greatest(0, s) AS start_s, greatest(greatest(0, s), least(d, coalesce(e, d))) AS end_s FROM r""",
)
def _(spark, sf):
    end = F.when(F.col("seq") % 3 != 0, F.col("time_end_s"))
    clip = timing.clamp_clip(F.col("time_start_s") - 5000, end, F.lit(2_000_000.0))
    return B.observations(spark, sf).withColumn("clip", clip).select("seq", "clip.start_s", "clip.end_s")


@query(
    "relative_to_absolute_time",
    f"""WITH {B.OBS_SQL}, r AS (SELECT seq, CASE WHEN seq % 4 = 0 THEN NULL WHEN seq % 4 = 1 THEN start_ms + 500 ELSE start_ms % 70000 END AS rs,
        CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 4 = 1 THEN start_ms + 900 ELSE start_ms % 70000 + 20000 END AS re, start_ms AS cs, end_ms AS ce FROM obs),
    n AS (SELECT *, coalesce(rs, 0) AS lo, greatest(coalesce(rs, 0), coalesce(re, CASE WHEN ce > cs THEN ce - cs ELSE coalesce(rs, 0) END)) AS hi FROM r),
    m AS (SELECT *, CASE WHEN (ce <= cs OR (lo >= 0 AND hi <= ce - cs + 1)) AND NOT (lo >= cs - 1 AND hi <= ce + 1) THEN cs ELSE 0 END AS sh FROM n),
    k AS (SELECT *, greatest(cs, least(ce, lo + sh)) AS a FROM m)
    SELECT seq, CASE WHEN rs IS NULL AND re IS NULL THEN cs ELSE a END AS start_ms,
           CASE WHEN rs IS NULL AND re IS NULL THEN ce ELSE greatest(a, least(ce, hi + sh)) END AS end_ms FROM k""",
)
def _(spark, sf):
    q, s = F.col("seq"), F.col("start_ms")
    raw_start = F.when(q % 4 == 0, F.lit(None)).when(q % 4 == 1, s + 500).otherwise(s % 70_000)
    raw_end = F.when(q % 5 == 0, F.lit(None)).when(q % 4 == 1, s + 900).otherwise(s % 70_000 + 20_000)
    span = timing.absolute_ms(raw_start, raw_end, s, F.col("end_ms"))
    return B.observations(spark, sf).select("seq", span.alias("t")).select("seq", "t.start_ms", "t.end_ms")


@query(
    "sample_times",
    f"""WITH {B.OBS_SQL}, r AS (SELECT seq, time_start_s AS s, CASE WHEN seq % 6 = 0 THEN time_start_s ELSE time_end_s END AS e, (seq % 5 + 1)::INTEGER AS n FROM obs),
    a AS (SELECT seq, 'even' AS kind, CASE WHEN e <= s THEN [s] WHEN n = 1 THEN [(s + e) / 2]
        ELSE list_transform(range(n), lambda i: s + i * ((e - s) / (n - 1))) END AS l FROM r
      UNION ALL SELECT seq, 'middle', CASE WHEN e <= s OR n = 1 THEN [(s + e) / 2] ELSE list_transform(range(n), lambda i: s + i * ((e - s) / (n - 1))) END FROM r
      UNION ALL SELECT seq, 'clip', CASE WHEN e <= s THEN [s] WHEN ceil((e - s) / 64) <= 1 THEN [(s + e) / 2] ELSE list_transform(range(ceil((e - s) / 64)::INTEGER), lambda i: s + i * ((e - s) / (ceil((e - s) / 64)::INTEGER - 1))) END FROM r
      UNION ALL SELECT seq, 'dense', list_transform(range(greatest(1, floor((hi - lo) / 128)::INTEGER)), lambda i: lo + i * 128.0::DOUBLE) FROM (
        SELECT seq, CASE WHEN e - s < 1 THEN greatest(0, s - 0.5) ELSE s END AS lo, CASE WHEN e - s < 1 THEN e + 0.5 ELSE e END AS hi FROM r))
    SELECT seq, kind, unnest(range(len(l))) AS idx, unnest(l) AS t FROM a""",
)
def _(spark, sf):
    s = F.col("time_start_s")
    e = F.when(F.col("seq") % 6 == 0, s).otherwise(F.col("time_end_s"))
    n = (F.col("seq") % 5 + 1).cast("int")
    kinds = F.array(
        F.struct(F.lit("even").alias("kind"), timing.sample_times(s, e, n).alias("l")),
        F.struct(F.lit("middle").alias("kind"), timing.sample_times(s, e, n, "middle").alias("l")),
        F.struct(F.lit("clip").alias("kind"), timing.sample_times(s, e, timing.clip_sample_count(s, e, F.lit(1 / 64))).alias("l")),
        F.struct(
            F.lit("dense").alias("kind"),
            timing.dense_times(s, e, 1 / 128).alias("l"),
        ),
    )
    rows = B.observations(spark, sf).select("seq", F.explode(kinds).alias("k"))
    return rows.select("seq", "k.kind", F.posexplode("k.l").alias("idx", "t")).withColumn("idx", F.col("idx").cast("long"))


SECONDS_SQL = r"regexp_replace(regexp_replace(printf('%.3f', {0}), '0+$', ''), '\.$', '') || 's'"


@query(
    "render_time_anchor",
    f"""WITH {B.OBS_SQL} SELECT seq, CASE seq % 4
       WHEN 0 THEN CASE WHEN time_start_s = time_end_s THEN {SECONDS_SQL.format('time_start_s')} ELSE {SECONDS_SQL.format('time_start_s')} || ' to ' || {SECONDS_SQL.format('time_end_s')} END || '; ' || {SECONDS_SQL.format('time_end_s')}
       WHEN 1 THEN CASE WHEN time_start_s = time_end_s THEN {SECONDS_SQL.format('time_start_s')} ELSE {SECONDS_SQL.format('time_start_s')} || ' to ' || {SECONDS_SQL.format('time_end_s')} END
       WHEN 2 THEN {SECONDS_SQL.format('time_start_s')} ELSE '' END AS anchor FROM obs""",
)
def _(spark, sf):
    q, s, e = F.col("seq"), F.col("time_start_s"), F.col("time_end_s")
    pair = F.struct(s.alias("start_s"), e.alias("end_s"))
    point = F.struct(e.alias("start_s"), e.alias("end_s"))
    intervals = F.when(q % 4 == 0, F.array(pair, point))
    anchor = timing.anchor_text(intervals, F.when(q % 4 == 1, s), F.when(q % 4 == 1, e), F.when(q % 4 == 2, s))
    return B.observations(spark, sf).select("seq", anchor.alias("anchor"))


@query(
    "extract_text_intervals",
    rf"""WITH d AS (SELECT doc_id, n_chars, doc_id % 4 AS k, text FROM documents),
    j AS (SELECT doc_id, 0 AS idx, 100 + n_chars / 8.0::DOUBLE AS start_s, 100 + (n_chars / 8.0::DOUBLE + 2) AS end_s FROM d WHERE k < 2
      UNION ALL SELECT doc_id, 1, 100 + (n_chars + 1000)::DOUBLE, 100 + (n_chars + 1500)::DOUBLE FROM d WHERE k < 2),
    t AS (SELECT doc_id, text || ' from ' || n_chars || 's to ' || (n_chars + 3) || '.5s' AS raw FROM d WHERE k >= 2),
    p AS (SELECT doc_id, regexp_extract_all(raw, '(?i)(-?\d+(?:\.\d+)?)\s*(?:s|sec|secs|seconds)?\s*(?:-|to|until|through)\s*(-?\d+(?:\.\d+)?)', 1) AS a,
             regexp_extract_all(raw, '(?i)(-?\d+(?:\.\d+)?)\s*(?:s|sec|secs|seconds)?\s*(?:-|to|until|through)\s*(-?\d+(?:\.\d+)?)', 2) AS b FROM t),
    u AS (SELECT doc_id, unnest(range(len(a))) AS idx, unnest(a)::DOUBLE AS x, unnest(b)::DOUBLE AS y FROM p)
    SELECT doc_id, idx::BIGINT AS idx, start_s, end_s FROM j UNION ALL SELECT doc_id, idx, 100 + x, 100 + y FROM u""",
)
def _(spark, sf):
    n = F.col("n_chars")
    lo = n / F.lit(8.0)
    objects = F.format_string('{"clips": [{"start": %s, "end": %s}, {"start_s": %d, "end_s": %d}]}', lo, lo + 2, n + 1000, n + 1500)
    pairs = F.format_string("[[%s, %s], [%d, %d], [null, 1]]", lo, lo + 2, n + 1000, n + 1500)
    prose = F.concat("text", F.lit(" from "), n, F.lit("s to "), n + 3, F.lit(".5s"))
    k = F.col("doc_id") % 4
    fenced = F.concat("text", F.lit("\n```json\n"), objects, F.lit("\n``` 7 - 8"))
    # Other braces stand before and behind the object.
    braced = F.concat(F.lit("{note} "), "text", F.lit(" {x: {y}} "), objects, F.lit(" {end}"))
    raw = F.when(F.col("doc_id") % 8 == 4, braced).when(k == 0, fenced).when(k == 1, F.concat("text", F.lit(" so "), pairs, F.lit(" is it"))).otherwise(prose)
    found = B.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(jsons.text_intervals(raw, F.lit(100.0))).alias("idx", "i")
    )
    return found.select("doc_id", F.col("idx").cast("long").alias("idx"), "i.start_s", "i.end_s")


@query(
    "intervals_summary",
    f"""WITH {B.OBS_SQL}, r AS (SELECT seq, seq % 7 AS n, list_transform(range(seq % 7), lambda i: start_ms + i * 5000) AS l FROM obs)
    SELECT seq, CASE WHEN n = 0 THEN 'The queried event is absent.' ELSE 'Found at: ' ||
      array_to_string(list_transform(l[1:4], lambda x: printf('%.3f', x / 1000.0::DOUBLE) || '-' || printf('%.3f', (x + 1500) / 1000.0::DOUBLE) || 's'), ', ')
      || CASE WHEN n > 4 THEN ' (' || n || ' total)' ELSE '' END || '.' END AS summary FROM r""",
)
def _(spark, sf):
    n = (F.col("seq") % 7).cast("int")
    steps = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    intervals = F.transform(
        steps,
        lambda i: F.struct(
            timing.to_s(F.col("start_ms") + i * 5000).alias("start_s"),
            timing.to_s(F.col("start_ms") + i * 5000 + 1500).alias("end_s"),
        ),
    )
    return B.observations(spark, sf).select("seq", intervals_sentence(intervals).alias("summary"))


@query(
    "run_id_time",
    """SELECT event_id, date_trunc('second', ts) AS started_at, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events""",
)
def _(spark, sf):
    stamp = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("T"), F.date_format("ts", "HHmmss"), F.lit("Z"))
    runs = B.table(spark, sf, "events").withColumn("stamp", stamp)
    run_id = F.concat("stamp", F.lit("_"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8))
    return runs.select("event_id", timing.run_id_time(run_id).alias("started_at"), "stamp")


@query(
    "duration_from_iso",
    """SELECT event_id, round(value * 100)::BIGINT / 100.0::DOUBLE AS duration_s FROM events""",
)
def _(spark, sf):
    ev = B.table(spark, sf, "events")
    us = F.round(F.col("value") * 100).cast("long") * 10_000
    finished = F.timestamp_add("MICROSECOND", us, F.col("ts"))
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return ev.select("event_id", timing.elapsed_s(F.date_format("ts", iso), F.date_format(finished, iso)).alias("duration_s"))


# ---------------------------------------------------------------- boxes and vectors


@query(
    "bbox_normalize",
    f"""WITH {B.BOXES_SQL} SELECT seq, least(b1, b3) AS x1, least(b2, b4) AS y1, greatest(b1, b3) AS x2, greatest(b2, b4) AS y2,
      least(b1, b3, b4) AS px1, least(b2, b4, b1) AS py1, greatest(b1, b3, b4) AS px2, greatest(b2, b4, b1) AS py2 FROM bx""",
)
def _(spark, sf):
    b = F.col("bbox")
    points = F.array(F.array(b[0], b[1]), F.array(b[2], b[3]), F.array(b[3], b[0]), F.array(b[0]))
    rows = B.boxes(spark, sf).select("seq", vectors.sort_corners(b).alias("c"), vectors.polygon_box(points).alias("p"))
    names = ["x1", "y1", "x2", "y2"]
    return rows.select(
        "seq", *[F.col("c")[i].alias(n) for i, n in enumerate(names)], *[F.col("p")[i].alias("p" + n) for i, n in enumerate(names)]
    )


CANVAS_SQL = ", ".join(f"({w}, {h})" for w, h in vectors.CANVASES)


@query(
    "bbox_fit",
    f"""WITH {B.BOXES_SQL}, r AS (SELECT seq, abs(b1) * 4 AS a, abs(b2) * 2 AS b, abs(b1) * 4 + abs(b3) AS c, abs(b2) * 2 + abs(b4) AS d,
        CASE WHEN seq % 2 = 0 THEN 640 ELSE 400 END AS w, CASE WHEN seq % 2 = 0 THEN 360 ELSE 300 END AS h FROM bx),
    canvas(cw, ch) AS (VALUES {CANVAS_SQL}),
    s AS (SELECT seq, min((cw::DOUBLE / w + ch::DOUBLE / h) / 2) AS k FROM r, canvas
      WHERE cw >= w AND ch >= h AND abs(cw::DOUBLE / w - ch::DOUBLE / h) <= 0.05 AND abs(cw::DOUBLE / ch - w::DOUBLE / h) <= 0.05
        AND c <= cw AND d <= ch AND (cw::DOUBLE / w + ch::DOUBLE / h) / 2 > 1 AND greatest(c / w, d / h) >= 1.2
        AND c / ((cw::DOUBLE / w + ch::DOUBLE / h) / 2) <= w AND d / ((cw::DOUBLE / w + ch::DOUBLE / h) / 2) <= h GROUP BY seq)
    SELECT r.seq, CASE WHEN c <= w AND d <= h THEN a WHEN k IS NOT NULL THEN a / k ELSE least(w, a) END AS x1,
      CASE WHEN c <= w AND d <= h THEN b WHEN k IS NOT NULL THEN b / k ELSE least(h, b) END AS y1,
      CASE WHEN c <= w AND d <= h THEN c WHEN k IS NOT NULL THEN c / k ELSE least(w, c) END AS x2,
      CASE WHEN c <= w AND d <= h THEN d WHEN k IS NOT NULL THEN d / k ELSE least(h, d) END AS y2,
      NOT (c <= w AND d <= h) AS changed FROM r LEFT JOIN s ON r.seq = s.seq""",
)
def _(spark, sf):
    b = F.transform("bbox", F.abs)
    raw = F.array(b[0] * 4, b[1] * 2, b[0] * 4 + b[2], b[1] * 2 + b[3])
    even = F.col("seq") % 2 == 0
    w, h = F.when(even, 640).otherwise(400), F.when(even, 360).otherwise(300)
    rows = B.boxes(spark, sf).withColumn("raw", raw).withColumn("fit", vectors.fit_box(F.col("raw"), w, h))
    cols = [F.col("fit")[i].alias(n) for i, n in enumerate(["x1", "y1", "x2", "y2"])]
    return rows.select("seq", *cols, (F.col("fit") != F.col("raw")).alias("changed"))


def query_vector(spark, sf, vec_id: int) -> list[float]:
    """One stored vector, used as the question (a single row is read)."""
    row = B.table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


@query(
    "vector_normalize_dot",
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-8), 6) AS unit_dot,
      round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[])) + 1e-8), 6) AS cosine
    FROM embeddings, q""",
)
def _(spark, sf):
    q = F.array(*[F.lit(x) for x in query_vector(spark, sf, 0)])
    e = F.col("embedding")
    return B.table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(vectors.dot(vectors.unit(e), q), 6).alias("unit_dot"),
        F.round(vectors.cosine(e, q), 6).alias("cosine"),
    )


# ---------------------------------------------------------------- identity and JSON


@query(
    "canonical_hash",
    f"""WITH {B.OBS_SQL}, j AS (SELECT seq, '{{"atomic_text":"' || subject || ' did ' || predicate || '","frame_ts_s":null,"object_text":"","predicate":"' || predicate
      || '","subject":"' || subject || '","time_end_s":' || time_end_s || ',"time_start_s":' || time_start_s || ',"tool_name":"log"}}' AS j FROM obs)
    SELECT seq, 'obs_' || left(sha256(j), 16) AS observation_id FROM j""",
)
def _(spark, sf):
    obs = B.observations(spark, sf)
    fact = F.concat_ws(" did ", "subject", "predicate")
    oid = ids.observation_id(
        F.lit("log"), F.col("subject"), F.col("predicate"), fact, F.lit(""),
        F.col("time_start_s"), F.col("time_end_s"), F.lit(None).cast("double"),
    )
    return obs.select("seq", oid.alias("observation_id"))


@query(
    "make_sample_key",
    """SELECT item_id, 'clip_' || item_id || '__' || CASE WHEN item_id % 2 = 0 THEN 'qid' || item_id ELSE left(sha256(text), 12) END AS sample_key FROM benchmark""",
)
def _(spark, sf):
    video = F.concat(F.lit("/videos/clip "), "item_id", F.lit(".mp4"))
    qid = F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("string"))
    return B.table(spark, sf, "benchmark").select("item_id", ids.sample_key(video, F.col("text"), qid).alias("sample_key"))


@query(
    "letter_options",
    """WITH c AS (SELECT p_partkey, list_filter(['A. ' || p_name, CASE WHEN p_partkey % 3 <> 0 THEN 'B. ' || p_brand END, 'C. ' || p_type, 'D. ' || p_size], lambda x: x IS NOT NULL) AS k, (p_partkey % 4)::INTEGER AS g FROM part)
    SELECT p_partkey, array_to_string(k, '|') AS options, k[g + 1] AS gold FROM c""",
)
def _(spark, sf):
    part = B.table(spark, sf, "part")
    choices = F.array("p_name", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_brand")), "p_type", F.col("p_size").cast("string"))
    rows = part.select("p_partkey", letter_options(choices, F.col("p_partkey") % 4).alias("o"))
    return rows.select("p_partkey", F.array_join("o.options", "|").alias("options"), "o.gold")


@query(
    "json_path_get",
    """SELECT event_id, (props::JSON ->> '$.k') AS k, '[' || event_id || ',' || (event_id + 1) || ']' AS ids,
       CASE WHEN event_id % 2 = 0 THEN (event_id + 1)::VARCHAR ELSE event_id::VARCHAR END AS by_label, (event_id + 1)::VARCHAR AS second, NULL::VARCHAR AS missing,
       NULL::VARCHAR AS none, '[[' || event_id || ',' || (event_id + 1) || '],[7]]' AS nested, event_id::VARCHAR AS by_name FROM events""",
)
def _(spark, sf):
    e = F.col("event_id")
    doc = F.format_string(
        '{"props": %s, "regions": [{"label": "Big %s area", "id": %d}, {"label": "%s", "id": %d}, {"other": 1}, {"id": null}, {"label": "", "name": "Spare", "id": %d}],'
        ' "none": null, "a": [{"b": [%d, %d, null]}, {"c": 1}, {"b": [7]}, {"b": []}]}',
        "props", "event_type", e, F.when(e % 2 == 0, F.col("event_type")).otherwise(F.lit("rest")), e + 1, e, e, e + 1,
    )
    rows = B.table(spark, sf, "events").withColumn("v", F.try_parse_json(doc))
    v = F.col("v")
    # The label token differs per row, so each event type gets its own static path.
    kinds = ["click", "purchase", "view", "signup", "error"]
    by_label = F.coalesce(*[F.when(F.col("event_type") == k, jsons.json_path(v, f"regions.{k}.id")) for k in kinds])
    return rows.select(
        "event_id",
        jsons.json_path(v, "props.k").alias("k"),
        F.regexp_replace(jsons.json_path(v, "regions[].id"), r",\d+\]$", "]").alias("ids"),
        by_label.alias("by_label"),
        jsons.json_path(v, "regions[1].id").alias("second"),
        jsons.json_path(v, "regions.9.id").alias("missing"),
        jsons.json_path(v, "none").alias("none"),
        jsons.json_path(v, "a[].b[]").alias("nested"),
        jsons.json_path(v, "regions.spare.id").alias("by_name"),
    )


@query(
    "json_path_set",
    """SELECT event_id, '{"info":{"kind":"' || event_type || '","when":{"seq":' || event_id || '}}}' AS doc FROM events""",
)
def _(spark, sf):
    rows = B.table(spark, sf, "events").withColumn("doc", F.struct(F.struct(F.lit("x").alias("kind")).alias("info")))
    rows = jsons.assign_path(rows, "doc", "info.kind", F.col("event_type"))
    rows = jsons.assign_path(rows, "doc", "info.when.seq", F.col("event_id"))
    return rows.select("event_id", F.to_json("doc").alias("doc"))


# ---------------------------------------------------------------- rows


@query(
    "offset_segments",
    rf"""WITH {B.SEGMENTS_SQL} SELECT transcript_id, seg_idx, (start_ms + (transcript_id % 10) * 1000) / 1000.0::DOUBLE AS start_s,
      (CASE WHEN seg_idx % 3 = 2 THEN start_ms ELSE end_ms END + (transcript_id % 10) * 1000) / 1000.0::DOUBLE AS end_s,
      regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text FROM seg WHERE regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') <> ''""",
)
def _(spark, sf):
    seg = B.segments(spark, sf)
    clip_start = (F.col("transcript_id") % 10) * 1000
    end = F.when(F.col("seg_idx") % 3 != 2, F.col("end_ms"))
    return seg.select(
        "transcript_id",
        "seg_idx",
        timing.to_s(F.col("start_ms") + clip_start).alias("start_s"),
        timing.to_s(F.coalesce(end, F.col("start_ms")) + clip_start).alias("end_s"),
        text.strip(F.col("text")).alias("text"),
    ).filter(F.col("text") != "")


ID2_SQL = "lpad(printf('%.2f', {0}), greatest(6, length(printf('%.2f', {0})))::INTEGER, '0')"


@query(
    "clip_artifact_rows",
    f"""WITH {B.OBS_SQL} SELECT seq, 'clip_' || replace({ID2_SQL.format('time_start_s')}, '.', '_') || '_' || replace({ID2_SQL.format('time_end_s')}, '.', '_') AS artifact_id,
      'clip' AS kind, 'video' AS media_type, video_id FROM obs""",
)
def _(spark, sf):
    return B.observations(spark, sf).select(
        "seq",
        timing.clip_artifact_id(F.col("time_start_s"), F.col("time_end_s")).alias("artifact_id"),
        F.lit("clip").alias("kind"),
        F.lit("video").alias("media_type"),
        "video_id",
    )


@query(
    "evidence_lines",
    f"""WITH {B.OBS_SQL} SELECT seq, CASE WHEN seq % 4 = 0 THEN predicate ELSE '[' || concat_ws(' | ', CASE WHEN seq % 4 <> 1 THEN evidence_id END,
        CASE WHEN seq % 4 <> 2 THEN {SECONDS_SQL.format('time_start_s')} END) || '] ' || predicate END AS line,
      'Image ' || seq || ' | artifact_id=' || observation_id || ' | timestamp=' || {SECONDS_SQL.format('time_start_s')} || CASE WHEN seq % 2 = 0 THEN ' | relpath=f/' || seq || '.png' ELSE '' END
      || ' | video_id=' || video_id || ' | source_clip=[' || {SECONDS_SQL.format('time_start_s')} || '-' || {SECONDS_SQL.format('time_end_s')} || ']' AS media FROM obs""",
)
def _(spark, sf):
    q, s = F.col("seq"), F.col("time_start_s")
    eid = F.when(~(q % 4).isin(0, 1), F.col("evidence_id"))
    anchor = F.when(~(q % 4).isin(0, 2), timing.seconds_text(s))
    path = F.when(q % 2 == 0, F.concat(F.lit("f/"), q, F.lit(".png")))
    return B.observations(spark, sf).select(
        "seq",
        evidence_line(eid, anchor, F.col("predicate")).alias("line"),
        media_line(q, F.col("observation_id"), s, path, F.col("video_id"), s, F.col("time_end_s")).alias("media"),
    )


@query(
    "frame_rows",
    """SELECT 'video_' || label AS video_id, vec_id::DOUBLE AS timestamp_s, 'frames/frame_' || vec_id || '.png' AS relpath,
       CASE WHEN vec_id % 2 = 0 THEN label * 100.0::DOUBLE END AS clip_start_s, CASE WHEN vec_id % 2 = 0 THEN 'best match' ELSE 'retrieved' END AS rationale,
       round(embedding[1]::DOUBLE, 6) AS relevance_score FROM embeddings""",
)
def _(spark, sf):
    even = F.col("vec_id") % 2 == 0
    raw = B.table(spark, sf, "embeddings").select(
        F.concat(F.lit("video_"), "label").alias("video_id"),
        F.when(even, F.col("vec_id").cast("double")).alias("timestamp_s"),
        F.when(~even, F.col("vec_id").cast("double")).alias("timestamp"),
        F.concat(F.lit("frames/frame_"), "vec_id", F.lit(".png")).alias("frame_path"),
        F.when(even, F.struct((F.col("label") * F.lit(100.0)).alias("start_s"))).alias("clip"),
        F.when(even, F.lit("best match")).alias("rationale"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("score"),
    )
    return frame_rows(raw)

