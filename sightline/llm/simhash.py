"""Near duplicates by SimHash, found in a grid of segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits, and a segment is mapped to how many of its bits are set.
One differing bit moves one count by one at most, so the Manhattan distance of two count vectors is never over the number
of differing bits. Fingerprints that differ in three bits or fewer are therefore within one of each other in the counts of
their upper or of their lower half. That is a range join on a grid whose cells are the count vectors of a half: equal
vectors meet in their own cell, and vectors at distance one differ in the parity of their sum, so those with an odd sum
also visit the cells around them. What meets in a cell is compared on all bits.

Crowded cells are cut again by the counts of the other half's quarters, which by the same argument are within one in one
of the two, and what is still crowded is compared in blocks of bounded size. A cell gives edges that connect what is
linked in it, never more than it has rows, however many pairs are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import all_salts, documents, release_memory, salted
from sightline.llm.components import connected_components
from sightline.session import materialize

#: Fingerprints of one block of a crowded cell.
BLOCK = 1024
#: Bytes of text hashed at a time, so that a very long text costs little more memory than it has.
PIECE = 1 << 20


def shingle_hashes(text: str | None, width: int = 3, piece: int = PIECE) -> Iterator:
    """XXH64 (seed 42) of a text's shingles, repeats included, in lists: `width` words joined by spaces; fewer words are one shingle; none give nothing.

    Only A-Z are lower-cased, and words end at the six ASCII white-space characters, as `bytes` does both.
    """
    import re

    import xxhash

    digest, white = xxhash.xxh64_intdigest, re.compile(rb"[\x20\x09-\x0D]")
    data, at, words, given = (text or "").encode(), 0, [], False
    while at < len(data):
        found = white.search(data, at + piece)
        end = found.start() if found else len(data)
        words += data[at:end].lower().split()
        at = end
        if len(words) >= width:
            line, starts, place = b" ".join(words), [], 0
            ends = []
            for word in words:
                starts.append(place)
                place += len(word)
                ends.append(place)
                place += 1
            yield [digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)]
            given, words = True, words[len(words) - width + 1 :]
    if words and not given:
        yield [digest(b" ".join(words), 42)]


def majority(hashes, owner, n: int):
    """Fingerprints of n texts as 64-bit numbers: a bit is set where over half of a text's hashes set it. `owner` (ascending) tells whose a hash is.

    Eight bits are counted at once in the bytes of a 64-bit sum, in stretches of 255 hashes.
    """
    import numpy as np

    out = np.zeros(n, np.uint64)
    if not len(hashes):
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    size = np.diff(np.append(first, len(owner)))
    stretches = -(-size // 255)
    begin = np.repeat(first - 255 * (np.cumsum(stretches) - stretches), stretches) + 255 * np.arange(stretches.sum())
    counts = np.empty((len(begin), 64), np.int64)
    for k in range(8):
        lanes = (hashes >> np.uint64(k)) & np.uint64(0x0101010101010101)
        counts[:, k::8] = np.add.reduceat(lanes, begin).astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.add.reduceat(counts, np.cumsum(stretches) - stretches)
    bits = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little")
    out[owner[first]] = bits.view("<u8").ravel()
    return out


def fingerprints(rows: DataFrame, width: int = 3) -> DataFrame:
    """Reads (doc_id, text); (doc_id, fingerprint long)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                parts, owner = [np.zeros(0, np.uint64)], []
                for i, text in enumerate(some["text"]):
                    n = 0
                    for hashes in shingle_hashes(text.as_py(), width):
                        parts.append(np.array(hashes, np.uint64))
                        n += len(hashes)
                    owner.append(np.full(n, i))
                made = majority(np.concatenate(parts), np.concatenate(owner), some.num_rows)
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(made.view(np.int64))], ["doc_id", "fingerprint"])
        release_memory()

    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def _visits(part: Column, bits: int) -> Column:
    """The cells where the low `bits` of `part` stand: their own first, then for an odd sum of counts those one count away; nulls between.

    A cell is written as its counts, two bits each: x minus half of x's upper bits does that for all segments at once.
    """
    fives = int("5" * (bits // 4), 16)
    cell = part - (F.shiftright(part, 1).bitwiseAND(F.lit(fives).cast("long")))
    odd = F.bit_count(part) % 2 == 1
    around = []
    for s in range(0, bits, 2):
        count = F.shiftright(cell, s).bitwiseAND(F.lit(3).cast("long"))
        around += [F.when(odd & (count < 2), cell + (1 << s)), F.when(odd & (count > 0), cell - (1 << s))]
    return F.array(cell, *around)


def _part(start: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), start).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _placed(rows: DataFrame, which: int, start: int, bits: int, *key: str) -> DataFrame:
    """Rows (cell, fp, own): every fingerprint in the cells it stands in by the `bits` from `start`, inside the cell `key` it comes from."""
    at = rows.select(*key, "fp", F.posexplode(_visits(_part(start, bits), bits)).alias("_nth", "_cell")).filter("_cell IS NOT NULL")
    cell = (F.col("_cell") * 2 + which) if not key else F.xxhash64(*key, F.lit(which), "_cell")
    return at.select(cell.alias("cell"), "fp", (F.col("_nth") == 0).alias("own"))


def _shared(placed: DataFrame) -> DataFrame:
    """Rows of cells that hold several, one of them its own, with the cell's size. Never broadcast: Spark sizes a fingerprint's visits like the fingerprint."""
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("_some")).filter("n > 1 AND _some").drop("_some")
    return placed.hint("merge").join(sizes, "cell")


def _edges(most: int):
    """Reads rows sorted by (cell, a, b), own ones first; gives edges (a, b) that connect the fingerprints linked in each group."""

    def linked(key, fp, own):
        import numpy as np

        n = len(fp)
        root = np.arange(n)

        def ends(x):
            while True:
                up = root[x]
                if (up == x).all():
                    return x
                x = up

        live, d = np.flatnonzero(own), 0
        while len(live):
            d += 1
            live = live[live + d < n]
            live = live[key[live + d] == key[live]]
            i = live[root[live] != root[live + d]]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= most]
            j = i + d
            while len(i):
                a, b = ends(i), ends(j)
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        root = ends(root)
        moved = np.flatnonzero((root != np.arange(n)) & (fp != fp[root]))
        return fp[moved].view(np.int64), fp[root[moved]].view(np.int64)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def columns(batch):
            mixed = np.zeros(batch.num_rows, [("cell", "i8"), ("a", "i8"), ("b", "i8")])
            for c in ("cell", "a", "b"):
                mixed[c] = batch[c].to_numpy()
            return mixed, batch["fp"].to_numpy().view(np.uint64), batch["own"].to_numpy(zero_copy_only=False)

        def given(held):
            key, fp, own = held
            new = np.concatenate([[True], key[1:] != key[:-1]])
            a, b = linked(np.cumsum(new), fp, own)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            last = np.flatnonzero(now[0] != now[0][-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield given(tuple(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held is not None:
            yield given(held)

    return run


def links(found: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """Reads distinct fingerprints (fp); edges (a, b) between fingerprints that connect all that differ in `most` (3 at most) bits or fewer."""
    if most > 3:
        raise ValueError("halves within one of each other hold for up to three differing bits")
    cells = materialize(_shared(_placed(found, 0, 0, 32).union(_placed(found, 1, 32, 32))), "cells")
    fine, crowded = cells.filter(F.col("n") <= block), cells.filter(F.col("n") > block)
    # A cell of the upper half (odd numbers) is cut by the quarters of the lower one, and the other way round.
    upper, lower = crowded.filter("cell % 2 <> 0"), crowded.filter("cell % 2 = 0")
    quarters = [_placed(of, which, start + 16 * which, 16, "cell") for of, start in ((upper, 0), (lower, 32)) for which in (0, 1)]
    again = _shared(quarters[0].union(quarters[1]).union(quarters[2]).union(quarters[3]))
    rows = fine.unionByName(again).withColumn("_chunks", F.ceil(F.col("n") / block)).withColumn("_chunk", F.pmod(F.xxhash64("fp"), F.col("_chunks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    rows = rows.select("cell", F.least("_chunk", "_other").alias("a"), F.greatest("_chunk", "_other").alias("b"), "fp", "own")
    rows = rows.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", F.desc("own"))
    return rows.mapInArrow(_edges(most), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, width: int = 3, block: int = BLOCK, salts: int = 16) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    Rows are linked whose fingerprints differ in `most` bits or fewer; component_id is the smallest id that links reach,
    the row's own included. Null, empty and white texts have the fingerprint zero and link like any other. Rows that
    repeat an id count one by one. A null id is never the smallest: its row gets the component of its fingerprint, null
    where no id is reached. An empty table gives no rows. The links are exact, in crowded cells too.
    """
    rows = documents(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = materialize(fingerprints(rows, width), "fingerprints")
    nodes = materialize(made.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found = connected_components(materialize(links(nodes.select("fp"), most, block), "fingerprint-links"), salts)
    joined = materialize(nodes.join(found, nodes["fp"] == found["id"]).select("fp", "rep", "label"), "linked")
    least = all_salts(joined.groupBy(F.col("label").alias("_label")).agg(F.min("rep").alias("component_id")), salts).withColumnRenamed("_salt", "_salt2")
    several = salted(joined, F.xxhash64("fp"), salts).join(least, (F.col("label") == F.col("_label")) & (F.col("_salt") == F.col("_salt2"))).select("fp", "component_id")
    alone = nodes.join(joined.select("fp"), "fp", "left_anti").select("fp", F.col("rep").alias("component_id"))
    of = all_salts(several.union(alone), salts).withColumnRenamed("_salt", "_salt2")
    out = salted(made, F.xxhash64("doc_id"), salts).join(of, (F.col("fingerprint") == F.col("fp")) & (F.col("_salt") == F.col("_salt2")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
