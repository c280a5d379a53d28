"""Trace exports. A trace row holds its steps as array<struct<text, start_s, end_s, frame_s>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import strip
from sightline.functions.timing import anchor_text


def step_lines(steps: Column) -> Column:
    """``[time] text`` per step; a step without a time is its text alone."""

    def line(s: Column) -> Column:
        anchor = anchor_text(None, s["start_s"], s["end_s"], s["frame_s"])
        body = strip(F.coalesce(s["text"], F.lit("")))
        return F.when(anchor != "", F.concat(F.lit("["), anchor, F.lit("] "), body)).otherwise(body)

    return F.transform(steps, line)


def numbered(steps: Column) -> Column:
    return F.transform(step_lines(steps), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))


def joined(steps: Column) -> Column:
    return F.array_join(step_lines(steps), "\n")


def triples(evidence: Column, steps: Column) -> Column:
    """Evidence and inference texts side by side; the shorter list is filled with empty texts."""
    pairs = F.arrays_zip(evidence.alias("evidence"), step_lines(steps).alias("inference"))
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.lit("mixed").alias("modality"),
            F.coalesce(p["evidence"], F.lit("")).alias("evidence"),
            F.coalesce(p["inference"], F.lit("")).alias("inference"),
        ),
    )


def generic(sample_key: Column, steps: Column, evidence: Column, answer: Column) -> Column:
    trace = F.struct(step_lines(steps).alias("inference_steps"), evidence.alias("evidence"))
    return F.struct(sample_key.alias("sample_key"), trace.alias("trace"), answer.alias("answer"))


def markdown(df: DataFrame, answer: str, steps: str, evidence: str) -> Column:
    """Markdown of a trace: answer, numbered steps with their time, evidence entries.

    ``evidence`` is array<struct<evidence_id, status, anchor, text, observation_ids>>.
    """

    def step(s: Column, i: Column) -> Column:
        anchor = anchor_text(None, s["start_s"], s["end_s"], s["frame_s"])
        line = F.concat((i + 1).cast("string"), F.lit(". "), s["text"])
        return F.when(anchor != "", F.concat(line, F.lit(" ["), anchor, F.lit("]"))).otherwise(line)

    def entry(e: Column) -> Column:
        listed = F.array_join(e["observation_ids"], ", ")
        return F.concat_ws(
            "\n",
            F.concat(F.lit("### "), e["evidence_id"]),
            F.lit(""),
            F.when(e["status"] != "", F.concat(F.lit("- Status: "), e["status"])),
            F.when(e["anchor"] != "", F.concat(F.lit("- Time: "), e["anchor"])),
            F.concat(F.lit("- Text: "), F.coalesce(e["text"], F.lit(""))),
            F.when(listed != "", F.concat(F.lit("- Observations: "), listed)),
            F.lit(""),
        )

    body = F.concat_ws(
        "\n",
        F.lit("# Trace\n\n## Final Answer\n"),
        F.col(answer),
        F.lit("\n## Inference\n"),
        F.nullif(F.array_join(F.transform(steps, step), "\n"), F.lit("")),
        F.lit("\n## Evidence\n"),
        F.nullif(F.array_join(F.transform(evidence, entry), "\n"), F.lit("")),
    )
    return F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n"))


def initial_steps(texts: Column) -> Column:
    """Given step texts as numbered steps; blank ones are skipped but keep their number."""
    rows = F.transform(texts, lambda t, i: F.struct((i + 1).alias("step_id"), t.alias("text"), F.lit("medium").alias("answer_relevance")))
    return F.filter(rows, lambda r: strip(F.coalesce(r["text"], F.lit(""))) != "")
