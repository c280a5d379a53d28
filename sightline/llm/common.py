"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of all contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """Only the columns an operator needs, under its own names; other columns, whatever their names, stay out of its way."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(a) for a, c in more.items()])


def words_in(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_key(doc_id: Column) -> Column:
    """An id as a text that is never null, so that joins and windows by it share one partitioning and null meets null."""
    return F.when(doc_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), doc_id.cast("string")))


def salted(rows: DataFrame, row_key: Column, salts: int) -> DataFrame:
    """Deal the rows of every key to `salts` places; the other side of a join gets them all with `all_salts`."""
    return rows.withColumn("_salt", F.pmod(row_key, F.lit(salts)).cast("int"))


def all_salts(rows: DataFrame, salts: int) -> DataFrame:
    """Every row at all `salts` places. Spark sizes what `explode` gives like the rows before it and would broadcast far too much; a join's size is a product."""
    places = rows.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("_salt"))
    return rows.crossJoin(places)


def one_of_each(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of those that agree in `key`."""
    order = F.xxhash64(*[c for c in rows.columns if c not in key]).desc() if len(rows.columns) > len(key) else F.lit(1)
    return rows.withColumn("_nth_row", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_nth_row = 1").drop("_nth_row")


def _slot(bits: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits)) + 1


def bitmap(keys: DataFrame, bits: int, *key: str) -> DataFrame:
    """The slots of keys in a bitmap of `bits` bits: bits / 32768 rows of 4 KB at most, so it may be broadcast at any size of the input."""
    slots = keys.select(_slot(bits, *key).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))


def marked(rows: DataFrame, bits_of: DataFrame, bits: int, flag: str, *key: str) -> DataFrame:
    """Adds `flag`: the bit of the row's key is set. True for every key of the bitmap, and by chance for some others."""
    rows = rows.withColumn("_slot", _slot(bits, *key)).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    at = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substr(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(bits_of), "_bucket", "left").withColumn(flag, found).drop("_slot", "_bucket", "_bits")


#: Bits of a bitmap of document ids (512 KB).
ID_BITS = 1 << 22


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `docs` whose id is not among `dropped` (column doc_id; a null meets a null). Only rows that may be dropped are shuffled."""
    gone = dropped.select(id_key(F.col("doc_id")).alias("_id_key")).distinct()
    rows = marked(docs.withColumn("_id_key", id_key(F.col(id_col))), bitmap(gone, ID_BITS, "_id_key"), ID_BITS, "_maybe", "_id_key")
    passed = rows.filter("_maybe").join(gone, "_id_key", "left_anti")
    return rows.filter("NOT _maybe").select(*docs.columns).union(passed.select(*docs.columns))


def release_memory() -> None:
    """At the end of a Python task: hand freed memory back to the system, as the worker stays beside the next stage's tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)
