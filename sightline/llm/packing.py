"""Best-fit packing with certified bin counts.

Pieces are dealt to partitions of bounded size, each packed by best-fit decreasing. Dual feasible functions give every
partition a lower bound on its bins: where the count meets the bound no packing is better and the partition is done.
The others keep their full bins and exchange the documents of the rest: these are dealt anew and packed again, and the
new packing is taken when it needs fewer bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import documents
from sightline.llm.tokens import KEPT, SLICE, default_tokenizer, encoder, slices
from sightline.session import materialize

CAPACITY = 2048
END = 0
#: Pieces of one packing task.
PER_PARTITION = 4096
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT, slice_bytes: int = SLICE) -> DataFrame:
    """Documents as pieces of at most `capacity` ids (the text's ids, then the end id; null counts as empty).

    Only a longer document is cut: its first piece takes the remainder, all others are full and fill a sequence alone.
    Rows are handled alone: repeated rows repeat, an empty table gives no pieces, and columns other than the two named
    are not read. `kept` chunks and `slice_bytes` of text bound a task's memory and change no result.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = encoder(path, kept).encode
        for batch in batches:
            for some in slices(batch, size=slice_bytes):
                ids, starts = encode(some["text"])
                ids = np.insert(ids, starts[1:], END)
                starts = starts + np.arange(len(starts))
                cols: list[list] = [[], [], [], [], [], []]
                for doc_id, at, n in zip(some["doc_id"].to_pylist(), starts.tolist(), np.diff(starts).tolist(), strict=False):
                    ends = list(range((n - 1) % capacity + 1, n + 1, capacity))
                    for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                        own = ids[at + a : at + b]
                        for col, v in zip(cols, (doc_id, k, a, b - a, zlib.crc32(own), own.tobytes() if with_ids else None), strict=True):
                            col.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: 5 + with_ids])
        encoder(path, kept).forget()

    rows = documents(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECE + ", ids binary" * with_ids)


def lower_bound(lengths, capacity: int = CAPACITY) -> int:
    """The best of two families of dual feasible functions over integer lengths of 1..capacity.

    A function is dual feasible when its values over one bin's pieces never exceed 1, so their sum over all pieces is at
    most the number of bins. Family one, for a threshold t: pieces over capacity - t count 1, those under t nothing, the
    rest their share. Family two, for k: floor((k+1) x) / k, and x itself where (k+1) x is whole.
    """
    import numpy as np

    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * size)
    t = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 41):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        # Both kinds over the common denominator k * capacity.
        best = max(best, -(-int((counts * np.where(whole, size * k, scaled // capacity * capacity)).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths, capacity: int = CAPACITY):
    """Bin and offset of every piece. Open bins stand by free space; a set of the free spaces in use, held as bits, finds the tightest one."""
    import numpy as np

    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, made = 0, 0
    order = np.argsort(-np.asarray(lengths), kind="stable")
    for i, length in zip(order.tolist(), np.asarray(lengths)[order].tolist(), strict=True):
        fitting = used >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                used &= ~(1 << space)
        else:
            space, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - space
        space -= length
        if space:
            by_space[space].append(b)
            used |= 1 << space
    return bins, offsets


def _packed(rows: DataFrame, capacity: int) -> DataFrame:
    def run(own):
        own = own.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=False, kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(own["length"].to_numpy(), capacity)
        fill = own["length"].groupby(bins).transform("sum")
        return own.assign(bin=bins, offset=offsets, fill=fill, n_bins=int(bins.max()) + 1, bound=lower_bound(own["length"].to_numpy(), capacity))

    schema = "_part long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, n_bins long, bound long"
    # pandas holds integers with nulls as floats, so a null id travels as a flag beside it.
    rows = rows.withColumn("_no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    out = rows.groupBy("_part").applyInPandas(run, schema + ", _no_id boolean")
    return out.withColumn("doc_id", F.when(~F.col("_no_id"), F.col("doc_id"))).drop("_no_id")


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = 3) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of `tokenized_pieces` without ids), each row a piece of its own.

    `pieces` must be a written table: rows are dealt by their place in it, so repeated rows spread like all others. An
    empty table gives no rows.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = [pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 60)).withColumn("offset", F.lit(0).cast("long")).select(*columns, "sequence_id", "offset")]
    rest, last = pieces.filter(F.col("length") < capacity).select(*columns), None
    for round_no in range(rounds + 1):
        n = rest.count()
        if not n:
            break
        dealt = rest.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_no)), F.lit(-(-n // per_partition))))
        now = materialize(_packed(dealt, capacity), "packed")
        totals = now.groupBy("_part").agg(F.max("n_bins").alias("n"), F.max("bound").alias("b")).agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
        if last is not None and totals["n"] >= last[1]:
            break
        named = now.withColumn("sequence_id", F.lit(round_no << 52) + F.col("_part") * (1 << 20) + F.col("bin"))
        if last is not None:
            done.pop()
        certified = (F.col("n_bins") == F.col("bound")) | (F.col("fill") == capacity)
        done.append(named.filter(certified).select(*columns, "sequence_id", "offset"))
        gap = named.filter(~certified)
        done.append(gap.select(*columns, "sequence_id", "offset"))
        open_bins = gap.filter(F.col("offset") == 0).count()
        if totals["n"] == totals["b"] or not open_bins:
            break
        rest, last = gap.select(*columns), (round_no, open_bins)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, kept: int = KEPT, slice_bytes: int = SLICE, **options) -> DataFrame:
    """Every piece of every document with its sequence and place there, and its ids where asked for."""
    pieces = materialize(tokenized_pieces(docs, tokenizer, capacity, with_ids, kept=kept, slice_bytes=slice_bytes), "pieces")
    packed = pack(pieces, capacity, **options)
    if not with_ids:
        return packed
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = pieces.groupBy(*key).agg(F.first("ids").alias("ids")).select(*[F.col(c).alias(f"_{c}") for c in key], "ids")
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return packed.join(ids, on).drop(*[f"_{c}" for c in key])
