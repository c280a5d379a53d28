"""Streaming jobs run over whole tables to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import tables as B
from sightline.catalog.registry import query
from sightline.session import work_path
from sightline.sources.snapshots import Ledger
from sightline.sources.writers import append_jsonl
from sightline.streaming import jobs as S


def events(spark, sf):
    path = f"{sf}/events.parquet"
    return S.event_stream(spark, path, B.table(spark, sf, "events").schema)


@query(
    "stream_ledger_ingest",
    "SELECT user_id || '_' || event_type AS evidence_id, max(event_id) AS version, arg_max(value, event_id) AS value, user_id % 4 AS bucket FROM events GROUP BY user_id, event_type",
)
def _(spark, sf):
    path, table = work_path(spark, "log"), work_path(spark, "ledger")
    log = B.table(spark, sf, "events").select(
        F.concat_ws("_", "user_id", "event_type").alias("evidence_id"), F.col("event_id").alias("version"), "value", (F.col("user_id") % 4).alias("bucket")
    )
    for part in range(2):
        append_jsonl(log.filter(F.col("version") % 2 == part), path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).json(path)
    ledger = Ledger(spark, table, "evidence_id", "version", "bucket")
    S.ingest_ledger(stream, ledger)
    return ledger.read().select("evidence_id", "version", "value", F.col("bucket").cast("long").alias("bucket"))


@query(
    "stream_dedupe",
    """SELECT user_id || ':' || event_type AS observation_id, arg_min(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_min(value, {'t': ts, 'e': event_id}) AS value
    FROM events GROUP BY user_id, event_type, epoch_us(ts) // 259200000000""",
)
def _(spark, sf):
    # Windows of three days in thirty days of events: a fact repeats inside a window and again in the next ones.
    rows = events(spark, sf).select("ts", "event_id", "value", F.concat_ws(":", "user_id", "event_type").alias("observation_id"))
    job = lambda both: S.first_copies(both, ["observation_id"], "ts", "3 days", "10 minutes", ["event_id"])
    return S.run_to_end(rows, "ts", job, "dedupe").select("observation_id", "event_id", "value")


@query("stream_tumbling_counts", "SELECT epoch_us(ts) // 60000000 * 60 AS start_epoch, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    job = lambda both: S.window_counts(both, "ts", "10 minutes", "60 seconds", ["event_type"])
    out = S.run_to_end(events(spark, sf), "ts", job, "tumbling")
    return out.select(F.unix_seconds("window_start").alias("start_epoch"), "event_type", "n")


@query(
    "stream_hop_scan",
    """WITH p AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, value FROM events), h AS (SELECT user_id, unnest([s - 1, s]) AS s, value FROM p),
    w AS (SELECT user_id, s, count(*) AS n, max(value) AS value FROM h GROUP BY ALL)
    SELECT s AS start_epoch, user_id, n, value FROM w WHERE value >= 50""",
)
def _(spark, sf):
    job = lambda both: S.window_counts(both, "ts", "10 minutes", "2 seconds", ["user_id"], slide="1 second", score="value").filter(F.col("value") >= 50)
    out = S.run_to_end(events(spark, sf), "ts", job, "hop")
    return out.select(F.unix_seconds("window_start").alias("start_epoch"), "user_id", "n", "value")


@query(
    "stream_session_groups",
    """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS brk FROM events),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(t) AS start_us, max(t) + 3600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(spark, sf):
    job = lambda both: S.session_groups(both, "ts", "10 minutes", "1 hour", ["user_id"])
    out = S.run_to_end(events(spark, sf), "ts", job, "sessions")
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query(
    "stream_status_machine",
    """WITH a AS (SELECT user_id || '/' || (event_id % 20) AS evidence_id, event_id AS r, event_type IN ('click', 'purchase') AS acc, event_type IN ('click', 'purchase') AND event_id % 3 = 0 AS cit, event_id % 3 = 0 OR event_id % 7 < 4 AS cites,
        CASE event_id % 4 WHEN 0 THEN 'provisional' WHEN 1 THEN 'validated' WHEN 2 THEN 'irrelevant' ELSE '' END AS status FROM events),
    s AS (SELECT evidence_id, arg_min(status, r) AS f, max(CASE WHEN cit THEN r END) AS c, max(CASE WHEN acc AND cites THEN r END) AS a FROM a GROUP BY evidence_id)
    SELECT evidence_id, CASE WHEN c IS NOT NULL AND a > c THEN 'superseded' WHEN c IS NOT NULL THEN 'validated' WHEN f = 'validated' AND a IS NOT NULL THEN 'superseded' WHEN f IN ('validated', 'irrelevant') THEN f ELSE 'candidate' END AS status FROM s""",
)
def _(spark, sf):
    e = F.col("event_id")
    accepted = F.col("event_type").isin("click", "purchase")
    status = F.when(e % 4 == 0, "provisional").when(e % 4 == 1, "validated").when(e % 4 == 2, "irrelevant").otherwise("")
    audits = events(spark, sf).select(
        F.concat_ws("/", "user_id", e % 20).alias("evidence_id"), e.alias("round"), status.alias("status"), accepted.alias("accepted"), (e % 3 == 0).alias("cited"), ((e % 3 == 0) | (e % 7 < 4)).alias("cites_any")
    )
    return S.status_machine(audits, work_path(spark, "status"))


LATE_SQL = """f AS (SELECT event_id, ts, CASE WHEN event_id % 10 = 3 THEN 2 WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS part FROM events),
w AS (SELECT part, max(ts) AS m FROM f GROUP BY part)"""


@query(
    "stream_late_rows",
    f"""WITH {LATE_SQL} SELECT event_id, coalesce(epoch_us(ts) < (SELECT epoch_us(max(m)) - 3600000000 FROM w WHERE w.part < f.part), FALSE) AS late FROM f""",
)
def _(spark, sf):
    source, check = work_path(spark, "arrivals"), work_path(spark, "late-check")
    sinks = [work_path(spark, n) for n in ("ontime", "late", "marks")]
    ev = B.table(spark, sf, "events").select("event_id", "ts")
    ts = F.col("ts")
    day = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    part = F.when(F.col("event_id") % 10 == 3, 2).when(ts < day(11), 0).when(ts < day(21), 1).otherwise(2)
    # Three arrivals; the job is stopped between them and goes on from its checkpoint.
    for n in range(3):
        ev.filter(part == n).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ev.schema).parquet(source)
        S.split_late(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", 3600, *sinks, checkpoint=check)
    on_time = spark.read.parquet(sinks[0]).select("event_id", F.lit(False).alias("late"))
    return on_time.unionByName(spark.read.parquet(sinks[1]).select("event_id", F.lit(True).alias("late")))
