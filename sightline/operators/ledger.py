"""Evidence ledger operators: dedupe, roll-ups, digests and status steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.ids import canonical_json
from sightline.functions.text import blank_to_null, contains_any, is_low_signal, strip
from sightline.functions.timing import anchor_text, fixed, to_s
from sightline.operators.core import Split, keep_first, ordered_list, ordered_text, rank_rows, split_by, top_n
from sightline.operators.intervals import SLAB_MS, merge_intervals, tidy_intervals

# States of an evidence entry.
STATUSES = ["candidate", "validated", "refuted", "irrelevant", "superseded", "stale", "unknown"]
SETTLED = ["validated", "superseded", "refuted", "irrelevant", "stale", "unknown"]

# Finding categories and message words that block acceptance.
BLOCKING_CATEGORIES = [
    "ANSWER_ERROR",
    "ATTRIBUTION_GAP",
    "COUNTING_GAP",
    "INCOMPLETE_TRACE",
    "INFERENCE_ERROR",
    "READING_GAP",
    "TEMPORAL_GAP",
]
BLOCKING_WORDS = [
    "ambiguous",
    "attribute",
    "count",
    "earliest",
    "entity",
    "handed",
    "label",
    "missing",
    "not grounded",
    "speaker",
    "temporal",
    "timestamp",
    "unsupported",
    "unresolved",
]


def clean_status(c: Column) -> Column:
    """Stored status in canonical form; the legacy word ``provisional`` means candidate."""
    word = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(word.isin("", "provisional"), F.lit("candidate")).otherwise(word)


def check_status(df: DataFrame, column: str = "status") -> Split:
    """(kept, rejected) by status; a blank one becomes candidate, an unknown word is rejected."""
    word = F.lower(strip(F.coalesce(F.col(column), F.lit(""))))
    named = df.withColumn(column, F.when(word == "", F.lit("candidate")).otherwise(word))
    return split_by(named, F.col(column).isin(STATUSES))


def dedupe_last(df: DataFrame, key: str, seq: str = "seq", position: str = "last") -> DataFrame:
    """One row per id with its last payload; ``position`` says whether it sits at its first or last place."""
    rest = [c for c in df.columns if c != key]
    place = F.max(seq) if position == "last" else F.min(seq)
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r"), place.alias("position"))
    return last.select(key, *[F.col("_r")[c].alias(c) for c in rest], "position")


def dedupe_first(df: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    """First row per identity; ``key`` may be any expression."""
    return keep_first(df.withColumn("_key", key), ["_key"], [seq]).drop("_key")


def evidence_key(df: DataFrame, id_column: str, seq: str = "seq") -> Column:
    """Identity of an entry: its id, else its whole content."""
    content = canonical_json({c: F.col(c) for c in df.columns if c != seq})
    return F.coalesce(blank_to_null(F.col(id_column)), F.sha2(content, 256))


def observation_key(observation_id: Column, evidence_id: Column, body: Column) -> Column:
    pair = F.to_json(F.struct(F.trim(F.coalesce(evidence_id, F.lit(""))), F.trim(F.coalesce(body, F.lit("")))))
    return F.coalesce(blank_to_null(observation_id), pair)


def distinct_texts(df: DataFrame, keys: Sequence[str], column: str, seq: str) -> DataFrame:
    """Texts with content, once per key whatever their case; the first spelling stays."""
    named = df.filter(~is_low_signal(F.col(column))).withColumn(column, strip(F.col(column)))
    named = named.withColumn("_low", F.lower(column))
    return keep_first(named, [*keys, "_low"], [seq]).drop("_low")


def rollup(observations: DataFrame, evidence: DataFrame, top: int = 15) -> DataFrame:
    """Ledger summary as rows (section, name, n, rank): totals, status counts, top subjects and predicates."""

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("section"), F.lit(name).alias("name"), "n")

    def ranked(column: str, section: str) -> DataFrame:
        named = observations.withColumn("name", blank_to_null(F.col(column))).filter("name IS NOT NULL")
        counts = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit(section))
        return top_n(counts, ["section"], [F.desc("n"), F.asc("name")], top)

    statuses = evidence.groupBy(clean_status(F.col("status")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    plain = total(evidence, "evidence").unionByName(total(observations, "observations"))
    plain = plain.unionByName(statuses.withColumn("section", F.lit("status"))).withColumn("rank", F.lit(None).cast("int"))
    return plain.unionByName(ranked("subject", "subject")).unionByName(ranked("predicate", "predicate"))


def _time_spans(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged intervals and distinct frame points of each group."""
    timed = F.col("start_ms").isNotNull() | F.col("end_ms").isNotNull()
    ends = tidy_intervals(rows.filter(timed))
    merged = merge_intervals(ends, keys).select(*keys, "start_ms", "end_ms", F.lit(True).alias("is_interval"))
    frames = rows.filter(~timed & F.col("frame_ms").isNotNull())
    points = frames.select(*keys, F.col("frame_ms").alias("start_ms"), F.col("frame_ms").alias("end_ms")).distinct()
    return merged.unionByName(points.withColumn("is_interval", F.lit(False)))


def _time_shape(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    interval = F.col("is_interval")
    return spans.groupBy(*keys).agg(
        F.count(F.when(interval, 1)).alias("_ni"),
        F.count(F.when(~interval, 1)).alias("_nf"),
        F.min(F.when(interval, F.col("start_ms"))).alias("_s"),
        F.max(F.when(interval, F.col("end_ms"))).alias("_e"),
        F.min(F.when(~interval, F.col("start_ms"))).alias("_f"),
    )


def temporal_bounds(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Time of a group of rows (start_ms, end_ms, frame_ms).

    Any interval silences the frame times. One merged interval gives start and end, one lone frame a point;
    in the other cases ``n_listed`` intervals stand in ``temporal_intervals``.
    """
    shape = _time_shape(_time_spans(rows, keys), keys)
    one, framed = F.col("_ni") == 1, (F.col("_ni") == 0) & (F.col("_nf") == 1)
    listed = F.when(one | framed, 0).when(F.col("_ni") > 0, F.col("_ni")).otherwise(F.col("_nf"))
    return shape.select(
        *keys,
        F.when(one, F.col("_s")).alias("start_ms"),
        F.when(one, F.col("_e")).alias("end_ms"),
        F.when(framed, F.col("_f")).alias("frame_ms"),
        listed.cast("long").alias("n_listed"),
    )


def temporal_intervals(rows: DataFrame, keys: Sequence[str], part: int = 1000) -> DataFrame:
    """Interval lists of the groups that ``temporal_bounds`` cannot name by one time.

    ``part`` neighbours in time per row, so no array grows without bound.
    """
    spans = _time_spans(rows, keys)
    shape = _time_shape(spans, keys)
    several = shape.filter((F.col("_ni") > 1) | ((F.col("_ni") == 0) & (F.col("_nf") > 1)))
    several = several.select(*keys, (F.col("_ni") > 0).alias("is_interval"))
    listed = spans.join(several, [*keys, "is_interval"])
    placed = rank_rows(listed, keys, "start_ms", "start_ms", SLAB_MS, out="_n")
    placed = placed.withColumn("part", F.floor((F.col("_n") - 1) / F.lit(part)))
    pair = F.struct("start_ms", "end_ms")
    return placed.groupBy(*keys, "part").agg(ordered_list(pair, F.col("start_ms")).alias("intervals"))


def evidence_digest(observations: DataFrame, key: str, text: str, refs: str | None = None, shown: int = 8, limit: int = 2000) -> DataFrame:
    """First observations of an entry as ``[time | refs] text`` lines with a note on how many more exist.

    A range with one end stands for both; a row with neither shows its ``frame_ms`` where the column exists.
    """
    counts = observations.groupBy(key).agg(F.count(F.lit(1)).alias("n_observations"))
    head = top_n(observations, [key], [F.col("seq")], shown, "_pos").filter(F.trim(text) != "")
    start, end = to_s(F.coalesce("start_ms", "end_ms")), to_s(F.coalesce("end_ms", "start_ms"))
    span = F.when(start == end, F.concat(fixed(start, 2), F.lit("s"))).when(
        start.isNotNull(), F.concat(fixed(start, 2), F.lit("-"), fixed(end, 2), F.lit("s"))
    )
    if "frame_ms" in observations.columns:
        span = F.coalesce(span, F.concat(F.lit("frame "), fixed(to_s(F.col("frame_ms")), 2), F.lit("s")))
    cited = F.array_join(F.filter(F.slice(F.col(refs), 1, 2), lambda r: F.trim(r) != ""), " | ") if refs else F.lit("")
    anchor = F.concat_ws(" | ", span, blank_to_null(cited))
    line = F.concat(F.when(anchor != "", F.concat(F.lit("["), anchor, F.lit("] "))).otherwise(""), F.trim(text))
    lines = head.groupBy(key).agg(ordered_text(line, "\n", F.col("_pos")).alias("_text"), F.count(F.lit(1)).alias("_shown"))
    more = F.col("n_observations") - F.col("_shown")
    note = F.when(more > 0, F.format_string("\n... %d additional linked observation(s).", more)).otherwise("")
    digest = F.concat(F.substring("_text", 1, limit), note)
    return counts.join(lines, key, "left").select(key, "n_observations", digest.alias("digest"))


def confidence_stats(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Highest, mean and count of the values that are numbers; a group without any gives no row."""
    numbers = df.withColumn("_v", value.try_cast("double")).filter("_v IS NOT NULL")
    return numbers.groupBy(*keys).agg(
        F.round(F.max("_v"), 4).alias("confidence"),
        F.round(F.avg("_v"), 4).alias("confidence_avg"),
        F.count(F.lit(1)).alias("confidence_count"),
    )


def blocking_finding(severity: Column, category: Column, message: Column) -> Column:
    serious = F.upper(F.trim(severity)).isin("HIGH", "MEDIUM")
    named = F.upper(F.trim(category)).isin(BLOCKING_CATEGORIES)
    return F.coalesce(serious & (named | contains_any(F.lower(message), BLOCKING_WORDS)), F.lit(False))


def audit_accepted(verdict: Column, missing: Column, findings: Column) -> Column:
    """PASS, nothing missing and no blocking finding."""
    blocked = F.exists(findings, lambda f: blocking_finding(f["severity"], f["category"], f["message"]))
    nothing_missing = F.coalesce(F.size(missing), F.lit(0)) == 0
    return (F.upper(F.trim(verdict)) == "PASS") & nothing_missing & ~F.coalesce(blocked, F.lit(False))


def status_step(entries: DataFrame, links: DataFrame, cited: DataFrame, accepted: DataFrame) -> DataFrame:
    """Status changes of one audit round, changed entries only.

    ``entries``(run_id, evidence_id, status), ``links``(run_id, evidence_id, observation_id),
    ``cited``(run_id, observation_id), ``accepted``(run_id, accepted).
    """
    cites = cited.select("run_id", "observation_id").distinct()
    hit = links.join(cites, ["run_id", "observation_id"], "left_semi").select("run_id", "evidence_id").distinct()
    any_cite = cites.select("run_id").distinct().withColumn("_cites", F.lit(True))
    state = (
        entries.join(accepted, "run_id")
        .join(any_cite, "run_id", "left")
        .join(hit.withColumn("_hit", F.lit(True)), ["run_id", "evidence_id"], "left")
        .filter(~F.col("accepted") | F.col("_cites"))
        .withColumn("_prior", F.lower(F.trim(F.coalesce(blank_to_null(F.col("status")), F.lit("candidate")))))
    )
    following = (
        F.when(F.col("accepted") & F.col("_hit"), F.lit("validated"))
        .when(F.col("accepted") & (F.col("_prior") == "validated"), F.lit("superseded"))
        .when(~F.col("_prior").isin(SETTLED), F.lit("candidate"))
        .otherwise(F.col("_prior"))
    )
    changed = state.withColumn("new_status", following).filter(F.col("new_status") != F.col("_prior"))
    return changed.select("run_id", "evidence_id", F.col("_prior").alias("status"), "new_status")


def apply_status(entries: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = changes.select(*keys, F.col("new_status").alias("_new"))
    joined = entries.join(renamed, list(keys), "left")
    return joined.withColumn("status", F.coalesce("_new", "status")).drop("_new")


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Insert or replace by id: the row with the highest version wins."""
    return dedupe_last(current.unionByName(incoming, allowMissingColumns=True), key, version).drop("position")


def anchors_of(rows: DataFrame) -> Column:
    return anchor_text(None, to_s(F.col("start_ms")), to_s(F.col("end_ms")), F.lit(None).cast("double"))
