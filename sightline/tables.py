"""Bindings: the star-schema tables seen as evidence tables.

Times count from 2024-01-01 in whole milliseconds, so sums and comparisons stay exact.
The ``*_SQL`` texts are the same bindings for a SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.timing import to_s

EPOCH = "2024-01-01 00:00:00"
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_us():
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("ts"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: one subject per user, one evidence entry per user and day."""
    start = F.floor(event_us() / 1000).cast("long")
    length = F.round(F.col("value") * 100).cast("long") * 1000
    base = table(spark, sf_dir, "events").withColumn("start_ms", start)
    return base.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("obs_"), F.col("event_id")).alias("observation_id"),
        F.concat_ws("_", F.col("user_id"), F.floor(F.col("start_ms") / DAY_MS)).alias("evidence_id"),
        F.col("user_id").alias("video_id"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.col("value").alias("numeric_value"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        "start_ms",
        (F.col("start_ms") + length).alias("end_ms"),
        F.col("props").alias("metadata"),
    ).withColumns({"time_start_s": to_s(F.col("start_ms")), "time_end_s": to_s(F.col("end_ms"))})


OBS_SQL = f"""
obs0 AS (
  SELECT *, (epoch_us(ts) - 1704067200000000) // 1000 AS start_ms FROM events
),
obs AS (
  SELECT event_id AS seq, 'obs_' || event_id AS observation_id,
         user_id || '_' || (start_ms // {DAY_MS}) AS evidence_id,
         user_id AS video_id, 'user_' || user_id AS subject, event_type AS predicate,
         value AS numeric_value, least(value / 500, 1.0::DOUBLE) AS confidence,
         start_ms, start_ms + round(value * 100)::BIGINT * 1000 AS end_ms, props AS metadata,
         start_ms / 1000.0::DOUBLE AS time_start_s,
         (start_ms + round(value * 100)::BIGINT * 1000) / 1000.0::DOUBLE AS time_end_s
  FROM obs0
)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence entry per user and day; its first event gives the tool and the stored status."""
    words = F.array(*[F.lit(w) for w in ["provisional", "validated", "candidate", "irrelevant"]])
    return (
        observations(spark, sf_dir)
        .groupBy("evidence_id")
        .agg(
            F.min("seq").alias("seq"),
            F.min_by("video_id", "seq").alias("video_id"),
            F.min_by("predicate", "seq").alias("tool_name"),
            F.count(F.lit(1)).alias("n_observations"),
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
        )
        .withColumn("status", F.element_at(words, (F.col("seq") % 4 + 1).cast("int")))
    )


EVIDENCE_SQL = """
ev AS (
  SELECT evidence_id, min(seq) AS seq, arg_min(video_id, seq) AS video_id, arg_min(predicate, seq) AS tool_name,
         count(*) AS n_observations, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
         CASE min(seq) % 4 WHEN 0 THEN 'provisional' WHEN 1 THEN 'validated'
              WHEN 2 THEN 'candidate' ELSE 'irrelevant' END AS status
  FROM obs GROUP BY evidence_id
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames: label = video, vector id = second."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq"),
        F.col("label").alias("video_id"),
        F.concat(F.lit("frame_"), F.col("vec_id")).alias("frame_path"),
        (F.col("vec_id") * 1000).alias("t_ms"),
        F.col("vec_id").cast("double").alias("timestamp_s"),
        "embedding",
    )


def scored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a relevance score in whole millionths, taken from the first vector component."""
    score = F.round(F.abs(F.col("embedding")[0].cast("double")) * 1_000_000).cast("long")
    return frames(spark, sf_dir).withColumn("score_u", score).drop("embedding")


FRAMES_SQL = """
fr AS (
  SELECT vec_id AS seq, label AS video_id, 'frame_' || vec_id AS frame_path, vec_id * 1000 AS t_ms,
         vec_id::DOUBLE AS timestamp_s, round(abs(embedding[1]::DOUBLE) * 1000000)::BIGINT AS score_u
  FROM embeddings
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four vector components times 1000, cut to whole numbers, as a box."""
    numbers = F.transform(
        F.slice("embedding", 1, 4), lambda v: F.round(v.cast("double") * 1000).cast("long").cast("double")
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq"), F.col("label").alias("video_id"), numbers.alias("bbox")
    )


BOXES_SQL = """
bx AS (
  SELECT vec_id AS seq, label AS video_id,
         round(embedding[1]::DOUBLE * 1000)::BIGINT::DOUBLE AS b1, round(embedding[2]::DOUBLE * 1000)::BIGINT::DOUBLE AS b2,
         round(embedding[3]::DOUBLE * 1000)::BIGINT::DOUBLE AS b3, round(embedding[4]::DOUBLE * 1000)::BIGINT::DOUBLE AS b4
  FROM embeddings
)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as five-second transcript segments."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("transcript_id"),
        F.col("turn").alias("seg_idx"),
        (F.col("turn") * 5000).alias("start_ms"),
        (F.col("turn") * 5000 + 5000).alias("end_ms"),
        F.col("role").alias("speaker_id"),
        "text",
    )


SEGMENTS_SQL = """
seg AS (
  SELECT conv_id AS transcript_id, turn AS seg_idx, turn * 5000 AS start_ms, turn * 5000 + 5000 AS end_ms,
         role AS speaker_id, text
  FROM conversations
)"""


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as time hints: every text keeps its words and most get a time phrase in front."""
    n = F.col("n_chars") % 60
    lead = (
        F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("at "), F.col("doc_id") % 5, F.lit(":"), F.lpad(n.cast("string"), 2, "0")))
        .when(F.col("doc_id") % 8 == 1, F.concat(n, F.lit(" seconds after the start")))
        .when(F.col("doc_id") % 8 == 2, F.concat(n, F.lit("s before end")))
        .when(F.col("doc_id") % 8 == 3, F.concat(n, F.lit("% of the video")))
        .when(F.col("doc_id") % 8 == 4, F.concat(F.lit("wait 3s then look at "), n, F.lit(".25 sec")))
        .when(F.col("doc_id") % 8 == 5, F.lit("opening part"))
        .when(F.col("doc_id") % 8 == 6, F.lit("mid scene"))
        .otherwise(F.lit(""))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(lead, F.lit(" "), F.col("text")).alias("hint"), (n + 30).cast("double").alias("duration_s")
    )


HINTS_SQL = """
hints AS (
  SELECT doc_id, CASE doc_id % 8
      WHEN 0 THEN 'at ' || (doc_id % 5) || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0')
      WHEN 1 THEN (n_chars % 60) || ' seconds after the start'
      WHEN 2 THEN (n_chars % 60) || 's before end'
      WHEN 3 THEN (n_chars % 60) || '% of the video'
      WHEN 4 THEN 'wait 3s then look at ' || (n_chars % 60) || '.25 sec'
      WHEN 5 THEN 'opening part'
      WHEN 6 THEN 'mid scene'
      ELSE '' END || ' ' || text AS hint, (n_chars % 60 + 30)::DOUBLE AS duration_s
  FROM documents
)"""
