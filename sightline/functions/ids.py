"""Identity: canonical JSON and its hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import sanitize_component


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls are written, as the ids need them."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def text_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def canonical_hash(fields: dict[str, Column], length: int = 24) -> Column:
    return text_hash(canonical_json(fields), length)


def observation_id(
    tool: Column,
    subject: Column,
    predicate: Column,
    atomic_text: Column,
    object_text: Column,
    start_s: Column,
    end_s: Column,
    frame_s: Column,
) -> Column:
    """Same fact, same id: sources, box and confidence are left out on purpose."""
    fields = {
        "tool_name": tool,
        "subject": subject,
        "predicate": predicate,
        "atomic_text": atomic_text,
        "object_text": object_text,
        "time_start_s": start_s,
        "time_end_s": end_s,
        "frame_ts_s": frame_s,
    }
    return F.concat(F.lit("obs_"), canonical_hash(fields, 16))


def sample_key(video: Column, question: Column, question_id: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(video, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    tail = F.when(
        F.coalesce(question_id, F.lit("")) != "", F.concat(F.lit("qid"), sanitize_component(question_id))
    ).otherwise(text_hash(question, 12))
    return F.concat(sanitize_component(stem), F.lit("__"), tail)
