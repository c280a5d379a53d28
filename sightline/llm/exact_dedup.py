"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Each round leaves a bitmap of the groups that still hold several rows. A bitmap has a fixed number of bits, so it may
be broadcast whatever the size of the input; a full bitmap only means that more texts are hashed whole, never a wrong
group. Texts never leave the scan that reads them: only ids, lengths and hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import all_salts, bitmap, documents, id_key, marked, one_of_each, salted
from sightline.session import materialize

#: Bits of the bitmap of lengths (128 KB) and of the bitmap of lengths with prefix hashes (512 KB).
LENGTH_BITS = 1 << 20
PREFIX_BITS = 1 << 22


def shared(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows have."""
    return rows.groupBy(*key).count().filter("count > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digest_all: bool = False, salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (null counts as empty) the row with the largest id stays; a null id is the smallest of all, and of
    rows that repeat an id and its text one stays. `text_sha256` is null for texts that an earlier round proved unique,
    unless `digest_all` asks for every digest. An empty table gives no rows.
    """
    return _groups(docs, id_col, text_col, prefix, digest_all, salts).drop("text_hash")


def _groups(docs: DataFrame, id_col: str, text_col: str, prefix: int = 256, digest_all: bool = False, salts: int = 16) -> DataFrame:
    """`exact_groups` with text_hash, which tells a repeated id's rows apart."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(docs, id_col, text_col).select("doc_id", text.alias("text"))
    rows = rows.withColumn("_len", F.octet_length("text").cast("long")).withColumn("_prefix", F.xxhash64(F.substring("text", 1, prefix)))
    rows = marked(rows, bitmap(shared(rows, "_len"), LENGTH_BITS, "_len"), LENGTH_BITS, "_same_length", "_len")
    several = rows.filter("_same_length")
    rows = marked(rows, bitmap(shared(several, "_len", "_prefix"), PREFIX_BITS, "_len", "_prefix"), PREFIX_BITS, "_same_prefix", "_len", "_prefix")
    whole = F.unhex(F.sha2("text", 256))
    digest = whole if digest_all else F.when(F.col("_same_length") & F.col("_same_prefix"), whole)
    key = ["_len", "_prefix", "_sha"]
    rows = rows.select("doc_id", "_len", "_prefix", digest.alias("_sha"), F.xxhash64("text").alias("_hash")).groupBy("doc_id", "_hash", *key).agg(F.count("*").alias("_n"))
    rows = materialize(rows, "exact-rows")
    groups = rows.groupBy(*key).agg(F.sum("_n").alias("_size"), F.max("doc_id").alias("_keep")).filter("_size > 1")
    left, right = salted(rows, F.xxhash64("doc_id"), salts).alias("l"), all_salts(groups, salts).alias("r")
    on = F.col("l._salt") == F.col("r._salt")
    for name in key:
        on = on & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    size = F.coalesce("_size", F.lit(1).cast("long"))
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    out = left.join(right, on, "left").select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), F.lower(F.hex("l._sha")).alias("text_sha256"), F.col("_hash").alias("text_hash"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_nth")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "text_hash")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that `exact_groups` keeps, with all their columns. Of rows that repeat an id and its text the one whose columns sort last stays."""
    key = ["_id_key", "_text_hash"]
    groups = _groups(docs, id_col, text_col, **options).filter("group_size > 1")
    groups = materialize(groups.select(id_key(F.col("doc_id")).alias("_id_key"), F.col("text_hash").alias("_text_hash"), "kept"), "copies")
    rows = docs.withColumn("_id_key", id_key(F.col(id_col))).withColumn("_text_hash", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    rows = marked(rows, bitmap(groups, PREFIX_BITS, *key), PREFIX_BITS, "_maybe", *key)
    # Only texts that may have copies are shuffled; a bit set by chance sends a row through the join, which lets it pass.
    checked = rows.filter("_maybe")
    others = checked.join(groups.select(*key).distinct(), key, "left_anti")
    stay = one_of_each(checked.join(groups.filter("kept").select(*key).distinct(), key, "left_semi"), key)
    return rows.filter("NOT _maybe").select(*docs.columns).union(others.select(*docs.columns)).union(stay.select(*docs.columns))
