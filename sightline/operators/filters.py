"""Filters and compact projections. A check returns (kept, rejected), so nothing is lost silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import is_low_signal, squeeze, strip, truncate_text
from sightline.operators.core import Split, split_by


def require_text(df: DataFrame, columns: list[str]) -> Split:
    """Every named column must hold text."""
    good = F.lit(True)
    for name in columns:
        good = good & (strip(F.col(name)) != "")
    return split_by(df, good)


def request_context(df: DataFrame) -> Split:
    """A request needs regions, frames, clips or time hints; regions or frames make clips unnecessary."""

    def filled(name: str) -> Column:
        return F.coalesce(F.size(name), F.lit(0)) > 0

    hints = F.filter(F.transform("time_hints", strip), lambda h: h != "")
    empty = F.array().cast("array<string>")
    tidy = df.withColumns({"time_hints": hints, "clips": F.when(filled("regions") | filled("frames"), empty).otherwise(F.col("clips"))})
    return split_by(tidy, filled("regions") | filled("frames") | filled("clips") | filled("time_hints"))


def observation_filter(
    df: DataFrame,
    subject: str | None = None,
    tool: str | None = None,
    status: str | None = None,
    lo: int | None = None,
    hi: int | None = None,
) -> DataFrame:
    """Optional filters on observations; a missing start or end counts as open."""
    out = df
    if subject:
        out = out.filter(F.contains(F.lower("subject"), F.lit(subject.lower())))
    if tool:
        out = out.filter(F.col("source_tool") == tool)
    if status:
        out = out.filter(F.lower("status") == status.lower())
    if lo is not None:
        out = out.filter(F.col("end_ms").isNull() | (F.col("end_ms") >= lo))
    if hi is not None:
        out = out.filter(F.col("start_ms").isNull() | (F.col("start_ms") <= hi))
    return out


def blank_low_signal_answers(df: DataFrame, texts: list[str], lists: list[str]) -> DataFrame:
    """Blank the whole answer when every text in it says nothing, and flag the row."""
    pieces = F.concat(F.array(*[F.coalesce(c, F.lit("")) for c in map(F.col, texts)]), *[F.col(c) for c in lists])
    useless = F.forall(pieces, is_low_signal)
    out = df.withColumn("low_signal", useless)
    blanks = {c: F.when(F.col("low_signal"), F.lit("")).otherwise(F.col(c)) for c in texts}
    empties = {c: F.when(F.col("low_signal"), F.array().cast("array<string>")).otherwise(F.col(c)) for c in lists}
    return out.withColumns({**blanks, **empties})


def compact_request(query: Column, hints: Column, contexts: Column, evidence_ids: Column, clips: Column) -> Column:
    """Short form of a request: texts cut, only the first items of every list."""
    return F.struct(
        F.nullif(truncate_text(query, 180), F.lit("")).alias("query"),
        F.transform(F.slice(hints, 1, 4), lambda h: truncate_text(h, 80)).alias("time_hints"),
        F.transform(F.slice(contexts, 1, 3), lambda c: truncate_text(c, 120)).alias("text_contexts"),
        F.slice(evidence_ids, 1, 6).alias("evidence_ids"),
        F.slice(clips, 1, 3).alias("clips"),
    )


def compact_result(summaries: list[Column], clips: Column, frames: Column, n_observations: Column) -> Column:
    """Short form of a result: the first summary that says anything, counts and the first three items."""
    first = F.coalesce(*[F.nullif(s, F.lit("")) for s in summaries])
    return F.struct(
        truncate_text(first, 220).alias("summary"),
        F.nullif(n_observations, F.lit(0)).alias("observation_count"),
        F.nullif(F.size(clips), F.lit(0)).alias("clip_count"),
        F.nullif(F.size(frames), F.lit(0)).alias("frame_count"),
        F.slice(clips, 1, 3).alias("returned_clips"),
        F.slice(frames, 1, 3).alias("returned_frames"),
    )


def severity_rank(severity: Column) -> Column:
    word = F.upper(squeeze(severity))
    return F.when(word == "HIGH", 0).when(word == "MEDIUM", 1).when(word == "LOW", 2).otherwise(99)


def ordered_findings(findings: Column) -> Column:
    """Findings with content, severity defaulting to MEDIUM, by severity, category, message and ids."""

    def tidy(f: Column) -> Column:
        severity = F.coalesce(F.nullif(F.upper(squeeze(f["severity"])), F.lit("")), F.lit("MEDIUM"))
        ids = F.array_sort(F.array_distinct(F.filter(F.transform(f["evidence_ids"], squeeze), lambda e: e != "")))
        return F.struct(
            severity_rank(severity).alias("rank"),
            squeeze(F.coalesce(f["category"], F.lit(""))).alias("category"),
            squeeze(F.coalesce(f["message"], F.lit(""))).alias("message"),
            ids.alias("evidence_ids"),
            severity.alias("severity"),
        )

    kept = F.filter(F.transform(findings, tidy), lambda f: (f["category"] != "") | (f["message"] != ""))
    return F.array_sort(kept)


def audit_feedback(verdict: Column, findings: Column, missing: Column) -> Column:
    """Canonical audit feedback: upper-case verdict, ordered findings, distinct missing items in given order."""
    items = F.array_distinct(F.filter(F.transform(missing, squeeze), lambda m: m != ""))
    return F.struct(
        F.nullif(F.upper(squeeze(verdict)), F.lit("")).alias("verdict"),
        F.transform(
            ordered_findings(findings),
            lambda f: F.struct(f["severity"].alias("severity"), f["category"].alias("category"), f["message"].alias("message"), f["evidence_ids"].alias("evidence_ids")),
        ).alias("findings"),
        items.alias("missing_information"),
    )
