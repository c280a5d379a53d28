"""Source divergence audit by sorted term pointers.

A shard is the Arrow buffer of some texts. Every term of it is a pointer to its first byte; pointers are put in the order
of the terms by multikey quicksort, eight bytes a key, so a run of equal pointers is one term with all its places in the
shard. A run gives the documents and the uses of its term per group; only those sums leave the shard, and Spark adds them
up. Distances between two sources of a language come from blocks of sources and buckets of terms, so no task holds a
language, and no pair of rows is built per term.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import release_memory
from sightline.session import materialize

#: Bytes of text in one shard, and pointers at which quicksort leaves a slice to one sort of its keys.
SHARD, LEAF = 1 << 24, 1 << 15
#: Sources and terms of one block of the distances between sources.
SOURCES, TERMS = 64, 8192


def _letters():
    """What each byte is in a term: A-Z in lower case, a-z and all of 0x80 and up as they are; 0 for bytes that end a term."""
    import numpy as np

    table = np.arange(256, dtype=np.uint8)
    table[: 0x41] = table[0x5B:0x61] = table[0x7B:0x80] = 0
    table[0x41:0x5B] += 0x20
    return table


def sorted_pointers(low, start, length, leaf: int = LEAF):
    """(order, first): pointers in the order of their terms, and whether a pointer is the first of its run of equal terms.

    `low` holds the bytes, no term byte 0, with eight bytes of padding. Multikey quicksort: a slice is cut in three around
    a key of eight bytes; those equal to it go on eight bytes deeper, unless their term ends there.
    """
    import numpy as np

    words = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
    masks = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)

    def keys(some, depth: int):
        return words[start[some] + depth].byteswap() & masks[np.minimum(length[some] - depth, 8)]

    out, firsts = [], []
    every = np.arange(len(start), dtype=np.int32)
    stack = [(every, keys(every, 0), 0)]
    while stack:
        some, key, depth = stack.pop()
        if key is None:  # one term
            out.append(some)
            firsts.append(np.arange(len(some)) == 0)
            continue
        if len(some) > max(leaf, 9):
            pivot = np.sort(key[:: len(key) // 9])[4]
            less, more = key < pivot, key > pivot
            same = some[~(less | more)]
            if more.any():
                stack.append((some[more], key[more], depth))
            stack.append((same, None if pivot & np.uint64(0xFF) == 0 else keys(same, depth + 8), depth + 8))
            if less.any():
                stack.append((some[less], key[less], depth))
            continue
        by = np.argsort(key)
        some, key = some[by], key[by]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        last = np.concatenate([first[1:], [True]]) if len(key) else first
        deeper = np.flatnonzero((key & np.uint64(0xFF) != 0) & ~(first & last))
        while len(deeper):
            depth += 8
            run = np.cumsum(first)[deeper]
            key = keys(some[deeper], depth)
            by = np.lexsort((key, run))
            some[deeper], key = some[deeper][by], key[by]
            first[deeper[1:]] |= key[1:] != key[:-1]
            last = np.concatenate([first[1:], [True]])
            deeper = deeper[(key & np.uint64(0xFF) != 0) & ~(first & last)[deeper]]
        out.append(some)
        firsts.append(first)
    return np.concatenate(out), np.concatenate(firsts)


def _ranges(starts, lengths):
    import numpy as np

    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _pointers(low, ends):
    """(start, length) of every term in the bytes of some texts; a term ends with its text. Places of four bytes, as a shard is never longer."""
    import numpy as np

    inside = low[:-8] != 0
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    at = np.concatenate([[0], ends[:-1]])
    cuts = at[at < len(inside)]
    begins[cuts] = inside[cuts]
    cuts = ends[(ends > 0) & (ends <= len(inside))] - 1
    stops[cuts] = inside[cuts]
    start = np.flatnonzero(begins).astype(np.int32)
    return start, np.flatnonzero(stops).astype(np.int32) + np.int32(1) - start


def shard_counts(data, ends, group):
    """(terms, group, docs, uses) of a shard, a row per term and group: how many of its texts have the term, and how often.

    `data`: the bytes of all texts; `ends`: where each text ends; `group`: each text's group number.
    """
    import numpy as np
    import pyarrow as pa

    low = np.concatenate([_letters()[data], np.zeros(8, np.uint8)])
    start, length = _pointers(low, ends)
    if not len(start):
        none = np.zeros(0, np.int64)
        return pa.array([], pa.string()), none, none, none
    order, first = sorted_pointers(low, start, length)
    by_group = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)
    place[by_group] = np.arange(len(group))
    key = np.cumsum(first) - 1
    key *= len(group)
    key += place[np.searchsorted(ends, start, "right").astype(np.int32)[order]]
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    uses, key = np.diff(np.append(new, len(key))), key[new]
    run, own = key // len(group), group[by_group[key % len(group)]]
    new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (own[1:] != own[:-1])]))
    heads = order[first]
    offsets = np.concatenate([[0], np.cumsum(length[heads])]).astype(np.int32)
    letters = low[_ranges(start[heads], length[heads])]
    terms = pa.StringArray.from_buffers(len(heads), pa.py_buffer(offsets), pa.py_buffer(letters))
    return terms.take(pa.array(run[new])), own[new], np.diff(np.append(new, len(key))), np.add.reduceat(uses, new)


def _long_text(data, size: int):
    """Counts of one text over `size` bytes, in pieces cut where no term goes on; one row per term."""
    import numpy as np
    import pyarrow as pa

    table, at, parts = _letters(), 0, []
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and table[data[end]] and table[data[end - 1]]:
            end += 1
        terms, _, _, uses = shard_counts(data[at:end], np.array([end - at]), np.zeros(1, np.int64))
        parts.append(pa.table({"term": terms, "uses": pa.array(uses, pa.int64())}))
        at = end
    found = pa.concat_tables(parts).group_by("term").aggregate([("uses", "sum")])
    n = len(found)
    return found["term"].combine_chunks(), np.zeros(n, np.int64), np.ones(n, np.int64), found["uses_sum"].to_numpy()


def term_counts(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """Reads (lang, source, text) without nulls; (lang, source, term, docs, uses) summed over all shards, and a row with term null for every group."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["lang", "source", "term", "docs", "uses"]

        def given(langs, sources, group, terms, docs, uses):
            at = pa.array(group, pa.int64())
            return pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), terms, pa.array(docs, pa.int64()), pa.array(uses, pa.int64())], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            coded = [batch[c].dictionary_encode() for c in ("lang", "source")]
            pair = coded[0].indices.to_numpy().astype(np.int64) * len(coded[1].dictionary) + coded[1].indices.to_numpy()
            pairs, group = np.unique(pair, return_inverse=True)
            langs = coded[0].dictionary.take(pa.array(pairs // len(coded[1].dictionary)))
            sources = coded[1].dictionary.take(pa.array(pairs % len(coded[1].dictionary)))
            every = np.arange(len(pairs))
            yield given(langs, sources, every, pa.nulls(len(every), pa.string()), np.bincount(group), 0 * every)
            text = batch["text"].cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            at = 0
            while at < n:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + shard, "right")) - 1)
                some = data[offsets[at] : offsets[end]]
                if len(some) > shard:
                    terms, _, docs, uses = _long_text(some, shard)
                    yield given(langs, sources, np.full(len(docs), group[at]), terms, docs, uses)
                else:
                    terms, own, docs, uses = shard_counts(some, offsets[at + 1 : end + 1] - offsets[at], group[at:end])
                    yield given(langs, sources, own, terms, docs, uses)
                at = end
        release_memory()

    found = rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, docs long, uses long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))


def _share(uses: Column, total: Column, terms: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (uses + smoothing) / (total + smoothing * terms)), in whole numbers of 38 digits."""
    over = (uses.cast("decimal(19,0)") + F.lit(smoothing)).cast("decimal(20,0)") * F.lit(scale).cast("decimal(12,0)")
    under = total.cast("decimal(19,0)") + F.lit(smoothing).cast("decimal(9,0)") * terms.cast("decimal(19,0)")
    return F.when(terms > 0, F.call_function("div", over, under) + 1).otherwise(F.lit(0))


def _distances(table):
    """Reads one block: sources with their shares of some terms (and, with term null, the share of a term they don't use).

    Gives for each two sources, one from either side, the sum of differences over the block's terms, how many terms
    these are, and the difference for a term that neither uses.
    """
    import numpy as np
    import pyarrow as pa

    source, other, sides = table["source"].combine_chunks().dictionary_encode(), table["term"].combine_chunks().dictionary_encode(), np.zeros(0, np.int64)
    row, p = source.indices.to_numpy(), table["p"].to_numpy()
    plain = other.indices.is_null().to_numpy(zero_copy_only=False)
    column = other.indices.fill_null(0).to_numpy()
    rest = np.zeros(len(source.dictionary), np.int64)
    rest[row[plain]] = p[plain]
    sides = np.zeros(len(rest), np.int64)
    sides[row] = table["block"].to_numpy()
    m = np.repeat(rest[:, None], len(other.dictionary), 1)
    m[row[~plain], column[~plain]] = p[~plain]
    a, b = table["a"][0].as_py(), table["b"][0].as_py()
    left, right, value, gap = [], [], [], []
    for g in range(len(rest)):
        h = np.flatnonzero((np.arange(len(rest)) != g) & (sides == (b if sides[g] == a else a)))
        left.append(np.full(len(h), g))
        right.append(h)
        value.append(np.abs(m[h] - m[g]).sum(1))
        gap.append(np.abs(rest[h] - rest[g]))
    left, right, value, gap = (np.concatenate(x).astype(np.int64) for x in (left, right, value, gap))
    n = len(left)
    lang, terms = (pa.repeat(table[c][0], n) for c in ("lang", "terms"))
    return pa.table({"lang": lang, "source": source.dictionary.take(pa.array(left)), "item": source.dictionary.take(pa.array(right)), "value": value, "seen": np.full(n, m.shape[1]), "gap": gap, "terms": terms})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, smoothing: int = 5, scale: int = 10**9, top: int = 50, shard: int = SHARD, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms.

    Null text, lang and source count as empty. A row is a document, also where rows repeat. Terms are runs of A-Z (in
    lower case), a-z and everything beyond ASCII. Each language keeps the terms of at least `min_docs` of its documents;
    a group's share of a term is 1 + floor(scale * (uses + smoothing) / (all its uses of kept terms + smoothing * kept
    terms)). Part `pair`: every other source of the language with the sum of share differences over kept terms; 0 where
    no term is kept. Part `term`: the `top` terms that the source uses and whose share lies over the language's, with
    that difference. Ranks go by value, largest first, ties by item. An empty table gives no rows; a source alone in its
    language has no pair. Whole texts are read, of any length.
    """
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col), empty).alias("lang"), F.coalesce(F.col(source_col), empty).alias("source"), F.coalesce(F.col(text_col), empty).alias("text"))
    counted = materialize(term_counts(rows, shard), "terms")
    used = counted.filter("term IS NOT NULL")
    kept = used.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("lang_uses")).filter(F.col("docs") >= min_docs).drop("docs")
    entries = materialize(used.drop("docs").join(kept, ["lang", "term"]), "kept-terms")

    totals = entries.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    per_lang = entries.groupBy("lang", "term").agg(F.max("lang_uses").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    every = counted.filter("term IS NULL").select("lang", "source")
    groups = every.join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left").join(every.groupBy("lang").agg(F.count("*").alias("_sources")), "lang")
    groups = groups.na.fill(0, ["total", "terms", "lang_total"])
    groups = groups.withColumn("rest", _share(F.lit(0), F.col("total"), F.col("terms"), smoothing, scale))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_sources") / sources))
    groups = groups.withColumn("blocks", blocks).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("terms") / terms)))
    groups = materialize(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))).drop("_sources"), "groups")

    p = _share(F.col("uses"), F.col("total"), F.col("terms"), smoothing, scale)
    q = _share(F.col("lang_uses"), F.col("lang_total"), F.col("terms"), smoothing, scale)
    shares = entries.join(groups, ["lang", "source"]).withColumn("p", p)
    over = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")

    bucket = F.pmod(F.xxhash64("term"), F.col("buckets"))
    columns = ["lang", "source", "term", "p", "terms", "block", "blocks", "bucket"]
    rest = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("string").alias("term"), F.col("rest").alias("p"))
    cells = shares.withColumn("bucket", bucket).select(*columns).union(rest.select(*columns))
    cells = cells.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("lang", "bucket", F.least("block", "_other").alias("a"), F.greatest("block", "_other").alias("b"), "block", "source", "term", "p", "terms")
    found = cells.groupBy("lang", "bucket", "a", "b").applyInArrow(_distances, "lang string, source string, item string, value long, seen long, gap long, terms long")
    found = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("gap").alias("gap"), F.max("terms").alias("terms"))
    pairs = found.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("gap")).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(best)
