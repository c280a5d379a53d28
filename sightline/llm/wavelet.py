"""Token ids as one wavelet matrix per shard: a compressed file that gives access, counts and occurrences.

Level by level, from the highest bit of the ids, a plane holds that bit of every token in the level's order, and the
next level's order has the tokens with bit 0 first. A directory with the number of ones before every block answers
rank, and a binary search in it answers select, so no token list is ever needed beside the planes.

A shard is one binary value (magic, sizes, zeros per level, planes, document ids and lengths; Zstandard around all of
it) in a row of a Parquet table that Spark writes, one row group per shard, so it lands in any store that Spark knows
and a lost executor's shards are written again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import documents
from sightline.llm.tokens import default_tokenizer, encoder, slices
from sightline.session import work_path

MAGIC = b"WVM1"
BLOCK = 512  # bits between entries of the rank directory
END = 0  # id that ends every document
SHARD_TOKENS = 1 << 18


class WaveletMatrix:
    def __init__(self, length: int, planes: list, zeros: list[int], doc_ids, lengths):
        import numpy as np

        self.length, self.planes, self.zeros, self.doc_ids, self.lengths = length, planes, zeros, doc_ids, lengths
        self.levels = len(planes)
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype("int64")
        self._before: list = [None] * self.levels

    @classmethod
    def build(cls, tokens, bits: int, doc_ids, lengths) -> WaveletMatrix:
        import numpy as np

        seq = np.asarray(tokens, dtype=np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            one = (seq & (1 << level)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            low = seq[np.flatnonzero(~one)]  # places first: twice as fast as a mask on bits without a pattern
            zeros.append(len(low))
            seq = np.concatenate([low, seq[np.flatnonzero(one)]])
        return cls(len(seq), planes, zeros, np.asarray(doc_ids, dtype="int64"), np.asarray(lengths, dtype="int64"))

    def to_bytes(self) -> bytes:
        import zstandard

        head = struct.pack("<4sQII", MAGIC, self.length, self.levels, len(self.doc_ids))
        body = [head, struct.pack(f"<{self.levels}Q", *self.zeros), *(p.tobytes() for p in self.planes), self.doc_ids.tobytes(), self.lengths.tobytes()]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        import numpy as np
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(data)
        magic, length, levels, docs = struct.unpack_from("<4sQII", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<4sQII")
        zeros = list(struct.unpack_from(f"<{levels}Q", data, at))
        at += 8 * levels
        width = (length + 7) // 8
        planes = [np.frombuffer(data, np.uint8, width, at + i * width) for i in range(levels)]
        at += levels * width
        return cls(length, planes, zeros, np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<i8", docs, at + 8 * docs))

    def _directory(self, level: int):
        import numpy as np

        if self._before[level] is None:
            plane = self.planes[level]
            padded = np.zeros(-(-max(len(plane), 1) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(plane)] = plane
            ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
            self._before[level] = np.concatenate([[0], np.cumsum(ones)])
        return self._before[level]

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _rank(self, level: int, i: int) -> int:
        """Ones before place i."""
        import numpy as np

        block = i // BLOCK
        full = self.planes[level][block * BLOCK // 8 : i >> 3]
        ones = int(self._directory(level)[block]) + int(np.bitwise_count(full).sum(dtype=np.int64))
        return ones + ((int(self.planes[level][i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of `bit`."""
        import numpy as np

        ones = self._directory(level)
        counts = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.length) - ones
        block = int(np.searchsorted(counts, k, "right")) - 1
        part = self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        places = np.flatnonzero(np.unpackbits(part, bitorder="little") == bit)
        return block * BLOCK + int(places[k - int(counts[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            value = value << 1 | bit
            ones = self._rank(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Places of the token's occurrences within lo..hi, in the order after the last level."""
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(token, lo, self.length if hi is None else hi)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence (from 0)."""
        a, b = self._range(token, 0, self.length)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self):
        """Every token in order: from the lowest bit up, each plane puts the next level's order back into its own."""
        import numpy as np

        low = np.zeros(self.length, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.length, bitorder="little").view(bool)
            zeros = self.zeros[level]
            low[zeros:] |= 1 << (self.levels - 1 - level)
            before = np.empty_like(low)
            before[np.flatnonzero(one)] = low[zeros:]
            before[np.flatnonzero(~one)] = low[:zeros]
            low = before
        return low


def _encode_shards(tokenizer: str, bits: int, shard_tokens: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, nth = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        held: list = []
        ids: list[int] = []
        sizes: list[int] = []
        kinds = [("part", pa.int32()), ("nth", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("no_id", pa.int64()), ("data", pa.binary())]

        def shard() -> pa.RecordBatch:
            nonlocal nth
            data = WaveletMatrix.build(np.concatenate(held), bits, [i or 0 for i in ids], sizes).to_bytes()
            row = {"part": [part], "nth": [nth], "n_docs": [len(ids)], "n_tokens": [sum(sizes)], "no_id": [sum(i is None for i in ids)], "data": [data]}
            nth += 1
            held.clear(), ids.clear(), sizes.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema(kinds))

        size = 0
        for batch in batches:
            for some in slices(batch):
                tokens, starts = encode(some["text"])
                if len(tokens) and int(tokens.max()) >> bits:
                    raise ValueError(f"token id {int(tokens.max())} needs more than {bits} bits")
                tokens = np.insert(tokens, starts[1:], END).astype(np.uint16 if bits <= 16 else np.uint32)
                starts = starts + np.arange(len(starts))
                for doc_id, a, b in zip(some["doc_id"].to_pylist(), starts.tolist(), starts[1:].tolist(), strict=False):
                    if size and size + b - a > shard_tokens:
                        yield shard()
                        size = 0
                    held.append(tokens[a:b])
                    ids.append(doc_id)
                    sizes.append(b - a)
                    size += b - a
        if held:
            yield shard()
        encoder(tokenizer).forget()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, bits: int = 16, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts in ascending order of id (integers; nulls first, equal ids by their texts' hash), an end id after each.

    Every range partition writes its documents as shards of about `shard_tokens` tokens; a longer document is a shard
    of its own. The range sort runs on texts and the encoding follows it in the same stage, so ids are never shuffled.
    """
    rows = documents(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out = rows.mapInArrow(_encode_shards(tokenizer or default_tokenizer(), bits, shard_tokens), "part int, nth long, n_docs long, n_tokens long, no_id long, data binary")
    # Planes are compressed already, and a row group per shard lets readers split a file between shards.
    out.write.option("compression", "none").option("parquet.block.size", 1 << 20).parquet(path)
    return path


def _decode_shards(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part, nth, no_id, data in zip(*(batch[c].to_pylist() for c in ("part", "nth", "no_id", "data")), strict=True):
            m = WaveletMatrix.from_bytes(data)
            tokens = m.tokens().astype("<u4")
            crc = [zlib.crc32(tokens[a:b]) for a, b in zip(m.starts, m.starts[1:], strict=False)]
            n = len(crc)
            ids = [None if i < no_id else x for i, x in enumerate(m.doc_ids.tolist())]
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part] * n, pa.int32()), "nth": pa.array([nth] * n, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "within": pa.array(m.starts[:-1]), "n_tokens": pa.array(m.lengths), "ids_crc32": pa.array(crc, pa.int64())}
            )


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Tokens before every shard: a running sum over range partitions, then over a partition's shards."""
    shards = spark.read.parquet(path).select("part", "nth", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # One row per range partition of the writer, so this window's task is as small as the list of its tasks.
    parts = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("_own", own).join(parts, "part").select("part", "nth", (F.col("_before") + F.col("_own")).alias("shard_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the shards alone, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = spark.read.parquet(path).select("part", "nth", "no_id", "data")
    rows = rows.mapInArrow(_decode_shards, "part int, nth long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(spark, path), ["part", "nth"]).select("doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n, first_place): occurrences in all shards and the first one's place in the whole sequence, from rank and select alone."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, nth, data in zip(*(batch[c].to_pylist() for c in ("part", "nth", "data")), strict=True):
                m = WaveletMatrix.from_bytes(data)
                n = [m.count(t) for t in tokens]
                first = [m.occurrence(t, 0) if k else None for t, k in zip(tokens, n, strict=True)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(n), pa.int32()), "nth": pa.array([nth] * len(n), pa.int64()), "token": pa.array(tokens, pa.int64()), "n": pa.array(n, pa.int64()), "place": pa.array(first, pa.int64())})

    rows = spark.read.parquet(path).select("part", "nth", "data").mapInArrow(run, "part int, nth long, token long, n long, place long")
    rows = rows.join(shard_starts(spark, path), ["part", "nth"])
    return rows.groupBy("token").agg(F.sum("n").alias("n"), F.min(F.col("shard_start") + F.col("place")).alias("first_place"))


def shards_in_work_folder(docs: DataFrame, **options) -> str:
    return write_shards(docs, work_path(docs.sparkSession, "wavelet-shards"), **options)
