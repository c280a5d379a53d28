"""Window functions and interval algebra as table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import tables as B
from sightline.catalog.registry import query
from sightline.operators.frames import stability, temporal_rerank
from sightline.operators.intervals import clips_from_intervals, interval_distinct, seconds
from sightline.operators.transcripts import distinct_ngrams, ordinal_ids
from sightline.functions import timing
from sightline.operators import intervals as I
from sightline.operators.core import keep_last, rank_rows, top_n


def merged_sql(source: str, keys: str, tol: int = 0, extra: str = "") -> str:
    """CTEs that merge ``source(keys, start_ms, end_ms)`` into ``merged``."""
    return f"""
m1 AS (SELECT *, max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + {tol} THEN 1 ELSE 0 END)
         OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms, seq ROWS UNBOUNDED PRECEDING) AS grp FROM m1),
merged AS (SELECT {keys}, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n {extra} FROM m2 GROUP BY {keys}, grp)"""


def raw_intervals(spark, sf):
    """Observations with some ends missing and some inverted."""
    q = F.col("seq")
    obs = B.observations(spark, sf)
    start = F.when(q % 7 == 0, F.col("end_ms")).otherwise(F.col("start_ms"))
    end = F.when(q % 7 == 0, F.col("start_ms")).when(q % 5 != 0, F.col("end_ms"))
    return obs.select("seq", "video_id", "evidence_id", "predicate", "confidence", start.alias("start_ms"), end.alias("end_ms"))


RAW_SQL = f"""{B.OBS_SQL},
raw AS (SELECT seq, video_id, evidence_id, predicate, confidence,
   CASE WHEN seq % 7 = 0 THEN end_ms ELSE start_ms END AS start_ms,
   CASE WHEN seq % 7 = 0 THEN start_ms WHEN seq % 5 <> 0 THEN end_ms END AS end_ms FROM obs),
tidy AS (SELECT seq, video_id, evidence_id, predicate, confidence, least(start_ms, coalesce(end_ms, start_ms)) AS start_ms, greatest(start_ms, coalesce(end_ms, start_ms)) AS end_ms FROM raw)"""


@query("merge_intervals_touching", f"WITH {RAW_SQL}, {merged_sql('tidy', 'video_id')} SELECT video_id, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, n FROM merged")
def _(spark, sf):
    merged = I.merge_intervals(I.tidy_intervals(raw_intervals(spark, sf)), ["video_id"])
    return seconds(merged)


@query(
    "merge_intervals_tolerance",
    f"WITH {RAW_SQL}, good AS (SELECT * FROM raw WHERE end_ms >= start_ms), {merged_sql('good', 'video_id', 750000)} SELECT video_id, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, n FROM merged",
)
def _(spark, sf):
    good, _rejected = I.valid_intervals(raw_intervals(spark, sf))
    return seconds(I.merge_intervals(good, ["video_id"], 750_000))


@query(
    "merge_labelled_events",
    f"WITH {B.OBS_SQL}, {merged_sql('obs', 'video_id, predicate', 0, ', max(confidence) AS confidence')} SELECT video_id, predicate, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, n, confidence FROM merged",
)
def _(spark, sf):
    events = B.observations(spark, sf)
    return seconds(I.merge_intervals(events, ["video_id", "predicate"], 0, {"confidence": ("confidence", "max")}))


@query(
    "clips_from_intervals",
    f"""WITH {RAW_SQL}, {merged_sql('tidy', 'video_id')} SELECT video_id, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s,
      'visual' AS source, 'video_' || video_id AS label FROM merged""",
)
def _(spark, sf):
    return clips_from_intervals(I.tidy_intervals(raw_intervals(spark, sf)), {"source": F.lit("visual"), "label": F.concat(F.lit("video_"), "video_id")})


@query(
    "interval_distinct",
    f"""WITH {B.OBS_SQL}, l AS (SELECT seq, list_transform(range(seq % 6), lambda i: [start_ms + (i % 3) * 1000, CASE WHEN i = 4 THEN start_ms + 1000 - 500 ELSE start_ms + (i % 3) * 1000 + 500 END]) AS l FROM obs),
    u AS (SELECT seq, unnest(range(len(l))) AS i, unnest(l) AS p FROM l),
    d AS (SELECT seq, min(i) AS i, least(p[1], p[2]) AS a, greatest(p[1], p[2]) AS b FROM u GROUP BY seq, a, b)
    SELECT seq, string_agg(a || '-' || b, ' ' ORDER BY i) AS spans FROM d GROUP BY seq""",
)
def _(spark, sf):
    n = (F.col("seq") % 6).cast("int")
    idx = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    s = F.col("start_ms")
    pairs = F.transform(
        idx,
        lambda i: F.struct(
            (s + (i % 3) * 1000).alias("start_ms"),
            F.when(i == 4, s + 500).otherwise(s + (i % 3) * 1000 + 500).alias("end_ms"),
        ),
    )
    rows = B.observations(spark, sf).select("seq", interval_distinct(pairs).alias("l")).filter(F.size("l") > 0)
    return rows.select("seq", F.array_join(F.transform("l", lambda p: F.concat_ws("-", p["start_ms"], p["end_ms"])), " ").alias("spans"))


@query(
    "last_n_per_run",
    f"""WITH {B.OBS_SQL} SELECT video_id, seq, row_number() OVER (PARTITION BY video_id ORDER BY seq DESC) AS back FROM obs
        QUALIFY back <= 20""",
)
def _(spark, sf):
    return top_n(B.observations(spark, sf), ["video_id"], [F.desc("seq")], 20, "back").select("video_id", "seq", F.col("back").cast("long").alias("back"))


@query(
    "latest_step_record",
    f"""WITH {B.OBS_SQL} SELECT video_id, predicate AS step_id, max(seq) AS seq, arg_max(numeric_value, seq) AS value FROM obs GROUP BY ALL""",
)
def _(spark, sf):
    rows = B.observations(spark, sf).select("video_id", F.col("predicate").alias("step_id"), "seq", F.col("numeric_value").alias("value"))
    return keep_last(rows, ["video_id", "step_id"], ["seq"])


SCORED_FRAMES = "scored AS (SELECT * FROM fr)"
NEIGHBOUR_SQL = """
nb AS (SELECT a.seq, sum(b.score_u) AS s, count(b.seq) AS n FROM fr a LEFT JOIN fr b
   ON a.video_id = b.video_id AND abs(a.t_ms - b.t_ms) <= {0} AND a.seq <> b.seq GROUP BY a.seq)"""


@query(
    "neighbour_stability",
    f"""WITH {B.FRAMES_SQL}, {NEIGHBOUR_SQL.format(20000)} SELECT f.seq, f.video_id, n AS others,
       coalesce(0.08::DOUBLE * (s::DOUBLE / n), 0) AS bonus_u FROM fr f JOIN nb ON f.seq = nb.seq""",
)
def _(spark, sf):
    rows = I.neighbour_sums(B.scored_frames(spark, sf), ["video_id"], "t_ms", "score_u", 20_000)
    return rows.select("seq", "video_id", F.col("others_n").alias("others"), stability(0.08).alias("bonus_u"))


@query(
    "temporal_rerank",
    f"""WITH {B.FRAMES_SQL}, {NEIGHBOUR_SQL.format(2000)},
    cl AS (SELECT video_id, min(t_ms) AS lo, max(t_ms) AS hi FROM fr GROUP BY video_id),
    r AS (SELECT f.*, lo, hi, CASE WHEN n > 0 THEN 0.18::DOUBLE * (s::DOUBLE / n) ELSE 0.0::DOUBLE END AS bonus,
       least(abs(t_ms - 30000), abs(t_ms - 200000)) AS d, greatest(1000.0::DOUBLE, least(2500.0::DOUBLE, CASE WHEN hi > lo THEN (hi - lo) * 0.2::DOUBLE ELSE 1000.0 END)) AS w
       FROM fr f JOIN nb ON f.seq = nb.seq JOIN cl ON f.video_id = cl.video_id),
    a AS (SELECT *, bool_or(d <= w) OVER (PARTITION BY video_id) AS alive FROM r),
    p AS (SELECT *, 0.25::DOUBLE * greatest(0.0::DOUBLE, 1.0 - d / w) AS pull FROM a)
    SELECT seq, video_id, t_ms, score_u, d AS distance_ms,
      round(score_u + bonus + (CASE WHEN alive AND d > w THEN pull * 0.5::DOUBLE ELSE pull END) * 1000000.0::DOUBLE
        + (CASE WHEN hi > lo THEN 0.04::DOUBLE * ((t_ms - lo)::DOUBLE / (hi - lo)) ELSE 0.0 END) * 1000000.0::DOUBLE)::BIGINT AS temporal_u FROM p""",
)
def _(spark, sf):
    frames = B.scored_frames(spark, sf)
    clips = frames.groupBy("video_id").agg(F.min("t_ms").alias("clip_start_ms"), F.max("t_ms").alias("clip_end_ms"))
    return temporal_rerank(frames, clips, True, [30_000, 200_000])


@query(
    "plateau_groups",
    f"""WITH {B.FRAMES_SQL}, wide AS (SELECT seq, video_id, t_ms // 10 AS t_ms, score_u // 1000 + 500000 AS score_u FROM fr),
    pk AS (SELECT video_id, max(score_u) AS pk FROM wide GROUP BY video_id),
    hi AS (SELECT w.* FROM wide w JOIN pk USING (video_id) WHERE pk - score_u <= greatest(20000::DOUBLE, pk * 0.03::DOUBLE)),
    g1 AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY t_ms) <= 1250 THEN 0 ELSE 1 END AS brk FROM hi),
    g2 AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS g FROM g1),
    gr AS (SELECT video_id, g, sum(score_u) / count(*)::DOUBLE AS mean, count(*) AS n, max(score_u) AS top, min(t_ms) AS t0, median(t_ms) AS mid FROM g2 GROUP BY video_id, g),
    best AS (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY mean DESC, n DESC, top DESC, t0) = 1)
    SELECT video_id, seq, t_ms, score_u, n AS group_size, mid AS median FROM g2 JOIN best USING (video_id, g)
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY abs(t_ms - mid), score_u DESC, t_ms, seq) = 1""",
)
def _(spark, sf):
    wide = B.scored_frames(spark, sf).select(
        "seq", "video_id", F.floor(F.col("t_ms") / 10).alias("t_ms"), (F.floor(F.col("score_u") / 1000) + 500_000).alias("score_u")
    )
    return I.best_plateau(wide, ["video_id"], "score_u")


@query(
    "segment_ngrams",
    rf"""WITH {B.SEGMENTS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY seg_idx) AS pos FROM seg WHERE trim(text) <> ''),
    k AS (SELECT unnest([1, 2, 3, 4]) AS k),
    r AS (SELECT a.transcript_id, a.pos, k.k, string_agg(trim(b.text), ' ' ORDER BY b.pos) AS text, min(b.start_ms) AS start_ms, max(b.end_ms) AS end_ms, count(*) AS n
      FROM s a, k, s b WHERE a.transcript_id = b.transcript_id AND b.pos BETWEEN a.pos AND a.pos + k.k - 1 GROUP BY ALL HAVING count(*) = k.k)
    SELECT transcript_id, text, start_ms, end_ms, k AS n_segments FROM r
    QUALIFY row_number() OVER (PARTITION BY transcript_id, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), start_ms, end_ms ORDER BY k, pos) = 1""",
)
def _(spark, sf):
    return distinct_ngrams(B.segments(spark, sf))


@query(
    "sequence_index",
    f"WITH {B.FRAMES_SQL} SELECT seq, video_id, row_number() OVER (PARTITION BY video_id ORDER BY t_ms, seq) - 1 AS sequence_index FROM fr",
)
def _(spark, sf):
    rows = rank_rows(B.scored_frames(spark, sf), ["video_id"], "t_ms", "seq", I.SLAB_MS)
    return rows.select("seq", "video_id", (F.col("rank") - 1).alias("sequence_index"))


@query(
    "ordinal_ids",
    f"""WITH {B.SEGMENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY seg_idx) AS n FROM seg WHERE seg_idx % 3 <> 1)
    SELECT transcript_id, seg_idx, printf('asr_%02d_%03d', transcript_id, n) AS segment_id, printf('visual_seg_%03d', n) AS visual_id, printf('audio_seg_%03d', n) AS audio_id, printf('caption_%03d', n) AS caption_id FROM r""",
)
def _(spark, sf):
    kept = B.segments(spark, sf).filter(F.col("seg_idx") % 3 != 1)
    rows = rank_rows(kept, ["transcript_id"], "seg_idx", "seg_idx", 100_000, out="n")
    return rows.select("transcript_id", "seg_idx", *ordinal_ids(F.col("transcript_id"), F.col("n")))


DURATIONS_SQL = "du AS (SELECT video_id, CASE WHEN video_id % 10 = 0 THEN 0 ELSE max(start_ms) - 3600000 END AS duration_ms FROM obs GROUP BY video_id)"


def durations(spark, sf):
    """Length per video, an hour short of its last event; every tenth video has none."""
    last = F.when(F.col("video_id") % 10 == 0, 0).otherwise(F.max("start_ms") - 3_600_000).cast("long")
    return B.observations(spark, sf).groupBy("video_id").agg(last.alias("duration_ms"))


@query(
    "fixed_windows",
    f"""WITH {B.OBS_SQL}, {DURATIONS_SQL}, w AS (SELECT video_id, duration_ms, unnest(range(greatest(1, ceil(duration_ms / 3600000.0::DOUBLE)::BIGINT))) AS idx FROM du)
    SELECT video_id, idx, idx * 3600 AS start_s, CASE WHEN duration_ms > 0 THEN least(duration_ms, idx * 3600000 + 3600000) ELSE 3600000 END / 1000.0::DOUBLE AS end_s FROM w""",
)
def _(spark, sf):
    w = I.fixed_windows(durations(spark, sf), 3_600_000)
    return w.select("video_id", "idx", (F.col("idx") * 3600).alias("start_s"), timing.to_s(F.col("end_ms")).alias("end_s"))


@query(
    "hop_window_scan",
    f"""WITH {B.OBS_SQL}, {DURATIONS_SQL},
    h AS (SELECT video_id, unnest(CASE WHEN start_ms // 1000 = 0 THEN [0] ELSE [start_ms // 1000 - 1, start_ms // 1000] END) * 1000 AS start_ms, confidence FROM obs),
    s AS (SELECT h.video_id, start_ms, start_ms + 2000 AS end_ms, max(confidence) AS confidence, start_ms AS seq FROM h JOIN du ON h.video_id = du.video_id
       WHERE start_ms + 2000 <= duration_ms GROUP BY ALL HAVING max(confidence) >= 0.25::DOUBLE),
    {merged_sql('s', 'video_id', 0, ', max(confidence) AS confidence')} SELECT video_id, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, n, confidence FROM merged""",
)
def _(spark, sf):
    points = B.observations(spark, sf).select("video_id", F.col("start_ms").alias("t_ms"), "confidence")
    return seconds(I.hop_scan(points, durations(spark, sf), ["video_id"], "confidence", 0.25))
