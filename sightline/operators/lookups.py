"""Key joins over the ledger: look-ups by id, semi and anti joins, references between steps, zips."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.jsons import json_items, json_walk
from sightline.functions.text import let, normalize_phrase, quotes, strip
from sightline.functions.timing import fixed, to_s
from sightline.operators.core import keep_first, keep_last, ordered_list, ordered_text, top_n
from sightline.operators.intervals import segment_ngrams


def with_status(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every observation with the state of its entry (null when the entry is unknown)."""
    return observations.join(evidence.select("evidence_id", "status"), "evidence_id", "left")


def lookup_records(requests: DataFrame, evidence: DataFrame, observations: DataFrame) -> DataFrame:
    """Resolve asked ids (request_id, pos, id).

    An evidence id gives its entry and then its observations, any other id an observation; unknown ids
    vanish. Repeats inside a request keep their first place (pos, sub).
    """
    asked = requests.select("request_id", "pos", F.col("id").alias("_id"))
    entries = asked.join(evidence.select(F.col("evidence_id").alias("_id"), F.col("tool_name").alias("text")), "_id")
    entry_rows = entries.select("request_id", "pos", F.lit(-1).cast("long").alias("sub"), F.col("_id").alias("evidence_id"), F.lit("").alias("observation_id"), "text")
    obs = observations.select("evidence_id", "observation_id", "seq", F.col("predicate").alias("text"))
    members = entries.select("request_id", "pos", F.col("_id").alias("evidence_id")).join(obs, "evidence_id")
    cols = ["request_id", "pos", F.col("seq").alias("sub"), "evidence_id", "observation_id", "text"]
    single = asked.join(obs, F.col("_id") == F.col("observation_id"))
    found = entry_rows.unionByName(members.select(*cols)).unionByName(single.select(*cols))
    return keep_first(found, ["request_id", "evidence_id", "observation_id", "text"], ["pos", "sub"])


def listed_only(observations: DataFrame, links: DataFrame) -> DataFrame:
    """Observations listed by their entry; an entry that lists none keeps all of its observations."""
    named = links.select("evidence_id", "observation_id").distinct()
    listing = named.select("evidence_id").distinct()
    kept = observations.join(named, ["evidence_id", "observation_id"], "left_semi")
    return kept.unionByName(observations.join(listing, "evidence_id", "left_anti"))


def missing_ids(asked: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Asked ids that are not available, once each."""
    return asked.select(key).distinct().join(available.select(key), key, "left_anti")


def cited_entries(links: DataFrame, cited: DataFrame, keys: list[str]) -> DataFrame:
    """Entries sharing at least one observation with any cited one."""
    return links.join(cited.select("observation_id").distinct(), "observation_id", "left_semi").select(*keys).distinct()


def step_anchors(cites: DataFrame, links: DataFrame, anchors: DataFrame, shown: int = 2) -> DataFrame:
    """Per trace step the first distinct time anchors of the entries it cites, in ledger order.

    ``cites``(trace_id, step_id, observation_id), ``links``(evidence_id, observation_id),
    ``anchors``(evidence_id, seq, anchor).
    """
    hits = cites.join(links, "observation_id").select("trace_id", "step_id", "evidence_id").distinct()
    named = hits.join(anchors.filter(F.col("anchor") != ""), "evidence_id")
    first = named.groupBy("trace_id", "step_id", "anchor").agg(F.min("seq").alias("seq"))
    best = top_n(first, ["trace_id", "step_id"], [F.col("seq")], shown, "_n")
    return best.groupBy("trace_id", "step_id").agg(ordered_text(F.col("anchor"), " | ", F.col("_n")).alias("anchor"))


# Fields that take a list, to which every reference adds.
LIST_FIELDS = ["clips", "frames", "regions", "transcripts", "text_contexts", "evidence_ids", "time_hints"]


def latest_outputs(outputs: DataFrame) -> DataFrame:
    """The last output of every step that references may name as their source: plan_id, source_step_id, _v (variant)."""
    latest = keep_last(outputs, ["plan_id", "step_id"], ["seq"])
    return latest.select("plan_id", F.col("step_id").alias("source_step_id"), F.try_parse_json("output").alias("_v"))


def resolved_refs(refs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Fill step fields from the latest output of an earlier step: every reference with its value or its error.

    ``refs``(plan_id, step_id, target_field, source_step_id, field_path), ``outputs``(plan_id, step_id, seq, output as
    JSON). Field paths are data: one join and one expression serve any number of them. A missing source, a path that
    leads nowhere and JSON null are errors.
    """
    joined = refs.join(latest_outputs(outputs), ["plan_id", "source_step_id"], "left").withColumn("value", json_walk(F.col("_v"), F.col("field_path"))).drop("_v")
    return joined.withColumn("error", F.when(F.col("value").isNull(), F.lit("unresolved_dependency")))


def resolve_refs(refs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``resolved_refs`` as two tables: (resolved, failed)."""
    rows = resolved_refs(refs, outputs)
    return rows.filter("value IS NOT NULL").drop("error"), rows.filter("value IS NULL").drop("value")


def merged_refs(refs: DataFrame, outputs: DataFrame, inputs: DataFrame | None = None, part: int = 1000) -> DataFrame:
    """One value per step field from all references into it: plan_id, step_id, target_field, value, n_refs, error.

    ``refs`` as for ``resolved_refs`` with ``pos``, the order within a field; ``inputs``(plan_id, step_id, target_field,
    value as JSON) is what fields hold before. References come in order. A list field takes every value, lists item by
    item. Any other field takes the last single value until a list arrives; from then on items are added, after the
    single value if there was one. A reference without a value leaves its whole step without values: error names the
    step's first one. What a step asks of one source goes through the join and on to the step as one row for `part`
    places of its fields, without the values where one is missing; all that follows happens there, in runs of `part`
    references, of which only values that can still show are kept.
    """
    step, key = ["plan_id", "step_id"], ["plan_id", "step_id", "target_field"]
    place = F.col("pos").cast("long")
    each = F.struct("target_field", place.alias("pos"), "field_path")
    asked = refs.groupBy(*step, "source_step_id", F.floor(place / part).alias("_part")).agg(F.collect_list(each).alias("_refs"))
    asked = asked.join(latest_outputs(outputs), ["plan_id", "source_step_id"], "left")
    found = F.transform("_refs", lambda r: F.struct(r["target_field"], r["pos"], json_walk(F.col("_v"), r["field_path"]).alias("value"), r["field_path"]))

    def told(b: Column) -> Column:
        missed = lambda r: F.when(r["value"].isNull(), F.coalesce(r["field_path"], F.lit(""))).alias("missed")
        return F.transform(b["refs"], lambda r: F.struct(r["target_field"], r["pos"], F.when(b["whole"], r["value"]).alias("value"), missed(r)))

    # Held by `let`, as a column would be put in where it is used and walked again for every reference.
    sent = let({"refs": found}, lambda b: let({"refs": b["refs"], "whole": ~F.exists(b["refs"], lambda r: r["value"].isNull())}, told))
    rows = asked.select(*step, "_part", F.lit(1).alias("_n"), sent.alias("_refs"))
    if inputs is not None:
        held = F.struct("target_field", F.lit(-1).cast("long").alias("pos"), "value", F.lit(None).cast("string").alias("missed"))
        given = inputs.filter("value IS NOT NULL").select(*step, F.lit(-1).cast("long").alias("_part"), F.lit(0).alias("_n"), F.array(held).alias("_refs"))
        rows = rows.unionByName(given)
    rows = rows.repartition(*step).select(*step, "_part", "_n", F.inline("_refs"))
    why = F.when(F.col("missed").isNotNull(), F.struct("target_field", "pos", F.concat(F.lit("unresolved_dependency: "), "missed").alias("text")))
    rows = rows.withColumn("_why", why)
    runs = rows.groupBy(*key, "_part").agg(ordered_list(F.col("value"), F.col("pos")).alias("_v"), F.sum("_n").alias("_n"), F.min("_why").alias("_why"))
    always = F.lower(strip(F.element_at(F.split("target_field", r"\."), -1))).isin(LIST_FIELDS)
    # Where the first list stands that a field of single values takes (0: nowhere), and the last single value before it.
    opens = F.array_position(F.transform("_v", lambda v: F.coalesce(F.startswith(v, F.lit("[")), F.lit(False))), True)
    runs = runs.withColumns({"_at": F.when(always, F.lit(1)).otherwise(opens)})
    runs = runs.withColumn("_first", F.min(F.when(F.col("_at") > 0, F.col("_part"))).over(Window.partitionBy(*key)))
    begun, begins = F.col("_part") > F.col("_first"), F.col("_part") == F.col("_first")
    since = F.when(always | begun, F.col("_v")).when(begins, F.slice("_v", F.col("_at").cast("int"), F.size("_v")))
    lone = F.when(always | begun, None).when(begins, F.get("_v", F.col("_at").cast("int") - 2)).otherwise(F.element_at("_v", -1))
    runs = runs.select(*key, "_part", "_n", "_why", F.flatten(F.transform(since, json_items)).alias("_items"), lone.alias("_lone"))
    single = F.max(F.when(F.col("_lone").isNotNull(), F.struct("_part", "_lone")))["_lone"]
    # Runs before the first list have no items at all (null), so a field without a list has an empty list of runs.
    listed = ordered_list(F.col("_items"), F.col("_part"))
    fields = runs.groupBy(*key).agg(single.alias("_single"), F.filter(listed, lambda x: x.isNotNull()).alias("_runs"), F.sum("_n").alias("n_refs"), F.min("_why").alias("_why"))
    fields = fields.filter("n_refs > 0").withColumn("error", F.min("_why").over(Window.partitionBy(*step))["text"])
    led = F.concat(F.when(F.col("_single").isNotNull(), F.array("_single")).otherwise(F.array().cast("array<string>")), F.flatten("_runs"))
    value = F.when(F.size("_runs") == 0, F.col("_single")).otherwise(F.concat(F.lit("["), F.array_join(led, ","), F.lit("]")))
    return fields.select(*key, F.when(F.col("error").isNull(), value).alias("value"), "n_refs", "error")


def zip_rows(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pad-zip two ordered row lists by position; the shorter side gives empty texts."""
    both = left.select(*keys, a).join(right.select(*keys, b), keys, "full")
    return both.withColumns({a: F.coalesce(a, F.lit("")), b: F.coalesce(b, F.lit(""))})


def zip_lines(texts: Column, boxes: Column, scores: Column) -> Column:
    """Texts with the box and score at their index; short lists give nulls, blank texts are dropped."""
    size = F.size(texts)
    zipped = F.slice(F.arrays_zip(texts.alias("text"), boxes.alias("bbox"), scores.alias("confidence")), 1, size)
    return F.filter(zipped, lambda z: F.trim(F.coalesce(z["text"], F.lit(""))) != "")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def similarity(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Matching-blocks ratio of two normal forms; a phrase inside the text counts 0.99 at least."""
    ratio = F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(_ratio(F.col(a), F.col(b)))
    inside = F.contains(F.col(b), F.col(a))
    return pairs.withColumn(out, F.when(inside, F.greatest(ratio, F.lit(0.99))).otherwise(ratio))


def quoted_phrases(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Quoted phrases of a text, once per normal form (the first spelling stays): keys, pos (place among the text's quotes), phrase."""
    rows = df.select(*keys, F.posexplode(quotes(F.col(column))).alias("pos", "phrase")).withColumn("_form", normalize_phrase(F.col("phrase")))
    rows = rows.filter("_form <> ''").withColumn("pos", F.col("pos").cast("long"))
    return keep_first(rows, [*keys, "_form"], ["pos"]).drop("_form")


def phrase_matches(questions: DataFrame, segments: DataFrame) -> DataFrame:
    """Best run of one to four segments for every quoted phrase of the question on its transcript.

    Higher similarity wins, then the shorter time span, then the earlier run. Runs whose lengths alone keep
    them below a containing run (0.99) never reach the similarity step.
    """
    phrases = quoted_phrases(questions, ["transcript_id"], "question").withColumnRenamed("pos", "phrase_no")
    phrases = phrases.withColumn("_p", normalize_phrase(F.col("phrase")))
    runs = segment_ngrams(segments).withColumn("_t", normalize_phrase(F.col("text"))).filter("_t <> ''")
    pairs = phrases.join(runs, "transcript_id")
    lengths = F.length("_p") + F.length("_t")
    bound = 2.0 * F.least(F.length("_p"), F.length("_t")) / lengths
    pairs = pairs.withColumns({"_in": F.contains(F.col("_t"), F.col("_p")), "_bound": bound})
    floor = pairs.groupBy("transcript_id", "phrase_no").agg(F.bool_or("_in").alias("_any"))
    hopeful = pairs.join(floor, ["transcript_id", "phrase_no"]).filter(~F.col("_any") | F.col("_in") | (F.col("_bound") >= 0.99))
    scored = similarity(hopeful, "_p", "_t", "score")
    order = [-F.round("score", 9), F.col("end_ms") - F.col("start_ms"), F.col("n_segments"), F.col("first_pos")]
    best = keep_first(scored, ["transcript_id", "phrase_no"], order)
    middle = to_s(F.col("start_ms")) + to_s(F.col("end_ms") - F.col("start_ms")) / 2.0
    return best.select(
        "transcript_id",
        "phrase_no",
        "phrase",
        F.col("text").alias("matched_text"),
        F.round("score", 4).alias("similarity"),
        to_s(F.col("start_ms")).alias("start_s"),
        to_s(F.col("end_ms")).alias("end_s"),
        F.concat(fixed(middle, 3), F.lit("s")).alias("time_hint"),
    )


def cached_embeddings(frames: DataFrame, cache: DataFrame, model, dim: int, batch: int = 256) -> DataFrame:
    """Vector per frame path: from the cache, else from ``model`` in batches, else (failure) a zero vector."""
    hits = frames.join(cache, "frame_path").withColumn("source", F.lit("cache"))
    misses = frames.join(cache.select("frame_path"), "frame_path", "left_anti")

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                vectors, states = [], []
                try:
                    vectors = [list(v) for v in model(list(part["frame_path"]))]
                    states = ["computed"] * len(part)
                except Exception:
                    for path in part["frame_path"]:
                        try:
                            vectors.append(list(model([path])[0]))
                            states.append("computed")
                        except Exception:
                            vectors.append([0.0] * dim)
                            states.append("failed")
                yield part.assign(embedding=vectors, source=states)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in misses.schema.fields)
    computed = misses.mapInPandas(compute, f"{fields}, embedding array<float>, source string")
    return hits.select(*computed.columns).unionByName(computed)
