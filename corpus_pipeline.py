"""A corpus pipeline of five stages, each an operator for training data applied to all that the stage before kept.

language ID -> exact dedup -> near dedup -> mixing sources to target weights -> best-fit packing. Every stage but the
last returns the columns of documents; each result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import exact_dedup, langid, lsh_forest, mixing, packing
from sightline.llm.common import without
from sightline.session import materialize

#: Stages with a trained model cannot be said in SQL; the stages' tests hold them against brute force instead.
ORACLE_SQL = None
#: Of documents like those held out, language ID gives up one in so many at most, and none with a score over the second value.
LOST, SURE = 1000, 0.5
#: Chunks the encoder keeps, and bytes it encodes at a time: Python workers of five stages stand beside each other here.
KEPT, SLICE = 60_000, 1 << 21


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell.

    Rejected are documents without a letter and those whose pooled probability is lower than nearly all of the rows that
    the network did not learn from have: one in LOST of these is given up, none of them over a score of SURE. Rows that
    repeat an id stay when one of them can be told. Without any row to learn from only letterless documents go.
    """
    model = langid.train(docs)
    if not model.labels:
        lettered = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
        return without(docs, docs.groupBy("doc_id").agg(F.max(lettered).alias("lettered")).filter("NOT lettered"))
    found = materialize(langid.identify(docs, model), "languages")
    told = F.col("lang_pred") != langid.UNKNOWN
    usual = found.filter(told & F.col("held_out")).agg(F.percentile_approx("score", 1 / LOST, F.lit(100 * LOST))).first()[0]
    rejected = ~told | (F.col("score") < min(SURE, SURE if usual is None else usual))
    return without(docs, found.groupBy("doc_id").agg(F.min(rejected).alias("rejected")).filter("rejected"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the one with the smallest id."""
    found = materialize(lsh_forest.near_duplicates(docs, width=5), "near")
    return without(docs, found.filter("NOT kept"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; a document that it does not take goes."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place there."""
    return packing.pack_documents(docs, kept=KEPT, slice_bytes=SLICE)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
