"""Streaming versions of the ledger jobs. Each takes a stream and returns a stream, or runs one to its sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.core import keep_last
from sightline.operators.ledger import SETTLED, clean_status
from sightline.session import work_path
from sightline.sources.readers import path_exists
from sightline.sources.snapshots import Ledger


def event_stream(spark: SparkSession, path: str, schema, time: str = "ts") -> DataFrame:
    """Parquet files as a stream; a time without zone becomes a timestamp, which watermarks need."""
    # The bracket makes the path a glob, so it may name one file or a folder of files.
    rows = spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]")
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def run_to_parquet(stream: DataFrame, name: str) -> DataFrame:
    """Run everything available through an append-mode stream into Parquet and read the result."""
    spark = stream.sparkSession
    out = work_path(spark, name)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", out)
    query = writer.option("checkpointLocation", work_path(spark, name + "-check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Event time of the mark that ends a stream: later than any window of real rows.
END_OF_STREAM = "9999-01-01 00:00:00"


def run_to_end(stream: DataFrame, time: str, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run ``job`` over everything available and then close what is still open; the result holds every window.

    A second source beside the stream stays empty in the first run. Then one mark with a time past all others is put
    there and the query goes on from its checkpoint: the watermark passes every open window or session and the engine's
    own state gives them out. The mark's own window never closes, so it is in no result.
    """
    spark = stream.sparkSession
    marks, out, check = work_path(spark, f"{name}-marks"), work_path(spark, name), work_path(spark, f"{name}-check")
    mark = spark.createDataFrame([], stream.schema)
    mark.write.parquet(marks)
    both = job(stream.unionByName(spark.readStream.schema(stream.schema).parquet(marks)))

    def run() -> None:
        writer = both.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", check)
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    end = spark.range(1).select(*[F.lit(END_OF_STREAM if f.name == time else None).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    end.write.mode("append").parquet(marks)
    run()
    return spark.read.schema(both.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, step, mode: str = "append", checkpoint: str | None = None) -> None:
    """Run everything available through ``step(batch, batch_id)``; a given checkpoint is continued."""
    place = checkpoint or work_path(stream.sparkSession, name + "-check")
    writer = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", place)
    writer.trigger(availableNow=True).start().awaitTermination()


def ingest_ledger(log: DataFrame, table: Ledger) -> None:
    """Append-only log into the current ledger: last version per id, a snapshot per batch.

    Replaying a batch changes nothing, because a row only yields to a higher version.
    """
    run_batches(log, "ingest", lambda batch, _batch_id: table.upsert(batch))


def dedupe_within(stream: DataFrame, key: str, time: str, delay: str, salts: int = 16) -> DataFrame:
    """First copy of a repeated fact inside the watermark.

    Two stages: copies of one hot fact are spread over ``salts`` tasks and thinned there before they meet.
    """
    marked = stream.withWatermark(time, delay).withColumn("_salt", F.pmod(F.xxhash64(*stream.columns), F.lit(salts)))
    thinned = marked.dropDuplicatesWithinWatermark([key, "_salt"]).drop("_salt")
    return thinned.dropDuplicatesWithinWatermark([key])


def first_copies(stream: DataFrame, key: list[str], time: str, width: str, delay: str, order: list[str]) -> DataFrame:
    """The first copy (by time, then ``order``) of a repeated fact in every event-time window of ``width``.

    Copies are combined on the map side before they meet, so a hot fact costs no more than any other; state is kept for
    open windows only, and the copy that stays does not depend on how rows arrive, as long as none is later than ``delay``.
    """
    rest = [c for c in stream.columns if c not in key]
    place = F.struct(time, *order)
    first = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *key).agg(F.min_by(F.struct(*rest), place).alias("_row"))
    return first.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def window_counts(stream: DataFrame, time: str, delay: str, width: str, by: list[str], slide: str | None = None, score: str | None = None) -> DataFrame:
    """Counts (and the best score) per event-time window once the watermark has closed it.

    Windows still open at the end of the data are given under ``run_to_end`` only; the same call on a static table gives all of them.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.max(score).alias(score)] if score else [])
    out = stream.withWatermark(time, delay).groupBy(window.alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", *([score] if score else []))


def session_groups(stream: DataFrame, time: str, delay: str, gap: str, by: list[str]) -> DataFrame:
    """Runs of rows without a pause of ``gap``; sessions are merged on the map side before the shuffle.

    Sessions still open at the end of the data are given under ``run_to_end`` only; the same call on a static table gives all of them.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    out = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("s"), *by)
    out = out.agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def status_of(first: Column, last_cited: Column, last_accepted: Column) -> Column:
    """State of an entry after all audit rounds.

    Accepted and cited validates; a later accepted round that does not cite supersedes a validated entry.
    """
    start = clean_status(first)
    return (
        F.when(last_cited.isNotNull() & (last_accepted > last_cited), "superseded")
        .when(last_cited.isNotNull(), "validated")
        .when((start == "validated") & last_accepted.isNotNull(), "superseded")
        .when(start.isin(SETTLED), start)
        .otherwise("candidate")
    )


def status_machine(audits: DataFrame, table: str, key: str = "evidence_id") -> DataFrame:
    """Entry states across audit rounds (key, round, status, accepted, cited, cites_any).

    ``cites_any`` says that the round cites an entry at all; an accepted round that cites none changes nothing.

    The keyed state is two maxima and the first status, so rounds are combined on the map side and one busy
    entry costs no more than any other. Updates are appended per batch; the last one per key counts.
    """
    accepted = F.when(F.col("accepted") & F.col("cites_any"), F.col("round"))
    cited = F.when(F.col("accepted") & F.col("cited"), F.col("round"))
    state = audits.groupBy(key).agg(
        F.min_by("status", "round").alias("first"), F.max(cited).alias("last_cited"), F.max(accepted).alias("last_accepted")
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(table)

    run_batches(state, "status", step, mode="update")
    latest = keep_last(audits.sparkSession.read.parquet(table), [key], ["batch"])
    return latest.withColumn("status", status_of(F.col("first"), F.col("last_cited"), F.col("last_accepted"))).select(key, "status")


def split_late(stream: DataFrame, time: str, delay_s: int, on_time: str, late: str, marks: str, checkpoint: str) -> None:
    """Rows behind the watermark go to a side table instead of being lost.

    The watermark is the highest time of the earlier batches less the delay. It is kept per batch in the
    ``marks`` table, so a restart or a replayed batch sees the same value.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        highest = None
        if path_exists(spark, f"{marks}/_SUCCESS"):
            earlier = spark.read.parquet(marks).filter(F.col("batch") < batch_id)
            highest = earlier.agg((F.max("highest") - F.expr(f"INTERVAL {delay_s} SECONDS")).alias("w"))
        behind = F.lit(False)
        if highest is not None:
            mark = highest.first()["w"]
            behind = F.coalesce(F.col(time) < F.lit(mark), F.lit(False)) if mark else behind
        tagged = batch.withColumns({"batch": F.lit(batch_id), "_late": behind})
        for path, flag in ((on_time, False), (late, True)):
            part = tagged.filter(F.col("_late") == flag).drop("_late")
            writer = part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            # One folder per batch: a replayed batch overwrites its own rows.
            writer.partitionBy("batch").parquet(path)
        batch.agg(F.max(time).alias("highest")).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(marks)

    run_batches(stream, "late", step, checkpoint=checkpoint)
