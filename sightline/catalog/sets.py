"""Set operations on tables and list columns."""

from __future__ import annotations


from pyspark.sql import functions as F

from sightline import tables as B
from sightline.catalog.columns import SENTENCES_SQL
from sightline.catalog.registry import query
from sightline.operators.unions import concat_lists, context_texts, distinct_list, id_sets, union_observations
from sightline.functions import text
from sightline.functions.text import WS


@query(
    "union_observations",
    f"""WITH {B.OBS_SQL} SELECT seq, predicate, CASE WHEN predicate IN ('click', 'view') THEN start_ms END AS start_ms, CASE WHEN predicate IN ('signup', 'error') THEN confidence END AS confidence, subject FROM obs WHERE predicate <> 'purchase'
    UNION ALL SELECT seq, predicate, NULL, NULL, NULL FROM obs WHERE predicate = 'purchase'""",
)
def _(spark, sf):
    obs = B.observations(spark, sf)
    clips = obs.filter(F.col("predicate").isin("click", "view")).select("seq", "predicate", "subject", "start_ms")
    scores = obs.filter(F.col("predicate").isin("signup", "error")).select("confidence", "subject", "seq", "predicate")
    bare = obs.filter("predicate = 'purchase'").select("predicate", "seq")
    return union_observations([clips, scores, bare])


@query(
    "concat_list_fields",
    rf"""SELECT doc_id, array_to_string(list_concat(list_concat(string_split(text, chr(10)), CASE WHEN doc_id % 2 = 0 THEN [source] ELSE [] END), [lang, lang]), '|') AS items FROM documents""",
)
def _(spark, sf):
    rows = B.table(spark, sf, "documents").select(
        "doc_id",
        concat_lists([F.split("text", "\n"), F.when(F.col("doc_id") % 2 == 0, F.array("source")), F.array("lang", "lang")]).alias("l"),
    )
    return rows.select("doc_id", F.array_join("l", "|").alias("items"))


@query(
    "union_distinct_lists",
    rf"""WITH u AS (SELECT doc_id, unnest(list_concat(string_split(text, ' '), [lang, lang])) AS w, unnest(range(len(string_split(text, ' ')) + 2)) AS i FROM documents),
    d AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY doc_id, w) SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS first_order, count(*) AS n FROM d GROUP BY doc_id""",
)
def _(spark, sf):
    words = F.concat(F.split("text", " "), F.array("lang", "lang"))
    rows = B.table(spark, sf, "documents").select("doc_id", distinct_list(words).alias("a"), distinct_list(words, ordered=True).alias("b"))
    return rows.select("doc_id", F.array_join("a", " ").alias("first_order"), F.size("b").cast("long").alias("n"))


@query(
    "id_sets",
    """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0)
    SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS in_left, b.id IS NOT NULL AS in_right FROM a FULL JOIN b ON a.id = b.id""",
)
def _(spark, sf):
    asked = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    known = B.table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("id"))
    return id_sets(asked, known, "id")


@query(
    "context_texts_union",
    rf"""WITH {B.SEGMENTS_SQL}, t AS (SELECT transcript_id, 0 AS kind, seg_idx AS pos, 0 AS sub, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text FROM seg
      UNION ALL SELECT transcript_id, 1, seg_idx, 0, speaker_id FROM seg UNION ALL SELECT transcript_id, 2, seg_idx, i, s FROM (SELECT transcript_id, seg_idx, unnest(range(len({SENTENCES_SQL}))) AS i, unnest({SENTENCES_SQL}) AS s FROM seg))
    SELECT transcript_id, text, array_to_string(min([kind, pos, sub]), '/') AS place FROM t WHERE text <> '' GROUP BY ALL""",
)
def _(spark, sf):
    seg = B.segments(spark, sf)
    sentences = seg.select("transcript_id", "seg_idx", F.posexplode(text.sentence_chunks(F.col("text"))).alias("i", "text"))
    lists = [
        seg.select("transcript_id", F.col("seg_idx").alias("pos"), "text"),
        seg.select("transcript_id", F.col("seg_idx").alias("pos"), F.col("speaker_id").alias("text")),
        sentences.select("transcript_id", F.col("seg_idx").alias("pos"), F.col("i").alias("sub"), "text"),
    ]
    return context_texts(lists, "transcript_id").withColumn("place", F.concat_ws("/", "place.list", "place.pos", "place.sub"))

