"""Near duplicates by an LSH forest over MinHash signatures.

Every distinct shingle set gets a signature. Each tree of the forest is one sorted order of the signatures, which starts
at another place of the signature and goes around. In an order, sets that share the first values stand together; such a
region is as deep as it needs to be: a set is compared with its nearest neighbours in the order, which in a sparse
region share only the least prefix and in a dense one a long one. Neighbours whose signatures agree often enough tie
their region together, and classes tied in this way are confirmed on full shingle sets, in blocks of bounded size.

In a region of more sets than a set has neighbours some pairs never meet. Sets that missed a partner of another class so
are joined exactly: two sets that are similar enough share one of their rarest shingles, so those alone are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import ID_BITS, all_salts, bitmap, documents, marked, release_memory, salted
from sightline.llm.components import connected_components
from sightline.session import materialize

#: Trees, values of the least common prefix, and neighbours on either side in an order.
TREES, DEPTH, NEIGHBOURS = 24, 5, 32
#: Part of the signature that must agree for a tie: five standard deviations under the similarity asked for.
SLACK = 5.0
BLOCK = 256  # sets of one block of a class
#: Sets whose shingles are counted, and counts kept, to tell common shingles from rare ones.
COUNTED, COMMON = 4096, 1 << 16
#: Standard deviations under the similarity asked for at which signatures still let a pair of the exact join pass (chance 1e-15).
PASS = 8.0

_A, _B, _M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mix(x):
    """Finalizer that spreads every bit of 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def word_numbers() -> dict:
    """Words' 64-bit hashes, kept for the life of a Python worker up to a bound."""
    import xxhash

    class Words(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > 500_000:
                self.clear()
            self[word] = n = xxhash.xxh64_intdigest(word)
            return n

    if not hasattr(xxhash, "_kept_words"):
        xxhash._kept_words = Words()  # functions reach executors by value, so the library's module holds what lasts
    return xxhash._kept_words


def shingle_set(text: str | None, words: dict, width: int = 2):
    """Sorted distinct 64-bit shingles of a text: `width` words in a row; fewer words are one shingle; none, the empty set.

    Only A-Z are lower-cased, and words end at the six ASCII white-space characters, as `bytes` does both.
    """
    import numpy as np

    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    n = min(width, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = _mix(s * np.uint64(_A) + h[k : len(h) - n + 1 + k] * np.uint64(_B))
    return np.unique(s)


def signature(shingles, a, b):
    """Smallest value of each hash function a * x + b (its upper 32 bits) over the set."""
    import numpy as np

    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[at : at + 2048, None] * a + b).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def _functions(n: int):
    import numpy as np

    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signatures(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig, prefixes): size and 128-bit hash of each set, its signature with a byte per value, and the least prefix of each tree."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        a, b = _functions(trees * depth)
        words = word_numbers()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                cols: list[list] = [[], [], [], [], []]
                for text in some["text"].to_pylist():
                    s = shingle_set(text, words, width)
                    sig = signature(s, a, b)
                    mixed = _mix(s ^ np.uint64(_B))
                    full = sig.astype(np.uint64).reshape(trees, depth)
                    prefix = np.zeros(trees, np.uint64)
                    for k in range(depth):
                        prefix = _mix(prefix * np.uint64(_A) + full[:, k])
                    values = (len(s), int(s.sum().view(np.int64)) if len(s) else 0, int(mixed.sum().view(np.int64)) if len(s) else 0, (sig >> np.uint32(24)).astype(np.uint8).tobytes(), prefix.view(np.int64).tolist())
                    for col, v in zip(cols, values, strict=True):
                        col.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([some["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_shingles", "set_a", "set_b", "sig", "prefixes"])
        forget_words()

    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary, prefixes array<long>")


def forget_words() -> None:
    """Give the kept words back at the end of a task, so idle workers stay small."""
    word_numbers().clear()
    release_memory()


def _find(parent: dict, x):
    while (p := parent.get(x, x)) != x:
        parent[x] = parent.get(p, p)
        x = parent[x]
    return x


def _neighbour_ties(agree: int, neighbours: int, percent: int):
    """Reads sorted rows (tree, prefix, id, n, sig); gives ties (a, b) that connect what agrees, none twice in a region.

    Rows (a, null, region) are sets that did not meet all of their region: it holds more than the neighbours, or it may
    go on in the task before or after.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = first = None
        parent: dict = {}

        def rows(a: list, b: list, region: list):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a + [r[0] for r in region], b + [None] * len(region), [None] * len(a) + [r[1] for r in region])], ["a", "b", "region"])

        def crowded(some, tree, prefix, ids) -> list:
            region = _mix(prefix[some].view(np.uint64) * np.uint64(_A) + tree[some].astype(np.uint64)).view(np.int64)
            return list(zip(ids[some].tolist(), region.tolist(), strict=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch["sig"][0].as_py())
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint8).reshape(-1, width)
            now = [batch["tree"].to_numpy(), batch["prefix"].to_numpy(), batch["id"].to_numpy(), batch["n"].to_numpy(), sig]
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            tree, prefix, ids, n, sig = now
            if first is None:
                first = tree[0], prefix[0]
                seen = 0
            far = np.arange(max(fresh, neighbours + 1), len(ids))
            far = far[(prefix[far] == prefix[far - neighbours - 1]) & (tree[far] == tree[far - neighbours - 1])]
            missed = crowded(np.union1d(far, far - neighbours - 1), tree, prefix, ids)
            if seen <= neighbours:
                border = np.arange(fresh, min(len(ids), fresh + neighbours + 1 - seen))
                missed += crowded(border[(tree[border] == first[0]) & (prefix[border] == first[1])], tree, prefix, ids)
            seen += len(ids) - fresh
            a_out, b_out = [], []
            live = np.arange(len(ids))
            for d in range(1, neighbours + 1):
                live = live[live + d < len(ids)]
                live = live[(prefix[live] == prefix[live + d]) & (tree[live] == tree[live + d])]
                if not len(live):
                    break
                i = live[live + d >= fresh]
                i = i[100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])]
                for k in range(0, len(i), 8192):
                    part = i[k : k + 8192]
                    part = part[(sig[part] == sig[part + d]).sum(1) >= agree]
                    for x, y, t, p in zip(ids[part].tolist(), ids[part + d].tolist(), tree[part].tolist(), prefix[part].tolist(), strict=True):
                        rx, ry = _find(parent, (t, p, x)), _find(parent, (t, p, y))
                        if rx != ry:
                            parent[max(rx, ry)] = min(rx, ry)
                            a_out.append(x)
                            b_out.append(y)
            held = [x[-neighbours - 1 :] for x in now]
            if len(parent) > 200_000:
                parent.clear()  # the next ties of a region may repeat known ones; none is lost
            yield rows(a_out, b_out, missed)
        if held is not None:
            tree, prefix, ids = held[:3]
            yield rows([], [], crowded(np.flatnonzero((tree == tree[-1]) & (prefix == prefix[-1])), tree, prefix, ids))

    return run


def _confirm(percent: int, width: int, agree: int, trees: int, depth: int):
    """Links of one block pair of a class: pairs of sets that pass on their full shingles, as far as they join something new."""

    def run(rows):
        import numpy as np
        import pandas as pd

        words, (fa, fb) = word_numbers(), _functions(trees * depth)
        rows = rows.sort_values("id", ignore_index=True)
        sets = [shingle_set(t, words, width) for t in rows["text"]]
        sig = np.stack([signature(s, fa, fb) for s in sets])
        size, side, ids = np.array([len(s) for s in sets]), rows["chunk"].to_numpy(), rows["id"].tolist()
        crossing = rows["a"].iloc[0] != rows["b"].iloc[0]
        root = np.arange(len(ids))
        out = []
        for i in range(len(ids) - 1):
            later = np.arange(i + 1, len(ids))
            later = later[(root[later] != root[i]) & (100 * np.minimum(size[later], size[i]) >= percent * np.maximum(size[later], size[i]))]
            if crossing:
                later = later[side[later] != side[i]]
            same = (sig[later] == sig[i]).sum(1)
            later, same = later[same >= agree], same[same >= agree]
            for j in later[np.argsort(-same, kind="stable")].tolist():
                if root[i] == root[j]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    out.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 2, trees: int = TREES, depth: int = DEPTH, neighbours: int = NEIGHBOURS, salts: int = 16) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * common shingles >= percent * all shingles of both; a component is what links
    reach, and its smallest id stays. Texts that are null, empty or white space have an empty set and link with nothing.
    Rows that repeat an id are one document. A null id has a class of its own: component_id null, kept true.

    With the defaults two sets of similarity 0.8 share a region with probability 1 - 7e-5 (0.9: 1 - 1e-9), however many
    sets the region has, and links are confirmed on full sets, so none is reported wrongly. Copies of one set are one
    node throughout.
    """
    rows = documents(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = materialize(signatures(rows, trees, depth, width), "signatures")
    full = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    nodes = materialize(nodes, "set-nodes")
    first = full.join(nodes.select("set_a", "set_b", "rep"), (full["doc_id"] == F.col("rep")) & (full["set_a"] == nodes["set_a"]) & (full["set_b"] == nodes["set_b"]))
    first = first.select("rep", "n_shingles", "sig", "prefixes")
    orders = first.select("rep", "n_shingles", "sig", F.posexplode("prefixes").alias("tree", "prefix"))
    around = F.concat("sig", "sig")
    orders = orders.select("tree", "prefix", F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sig", F.substr(around, (F.col("tree") + 1) * depth + 1, F.lit(12)).alias("_deeper"))
    keys = ["tree", "prefix", "_deeper", "id"]
    orders = orders.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_deeper")
    n, share = trees * depth, percent / 100
    agree = max(1, int(n * share - SLACK * (n * share * (1 - share)) ** 0.5))
    met = materialize(orders.mapInArrow(_neighbour_ties(agree, neighbours, percent), "a long, b long, region long").filter("b IS NULL OR a <> b").distinct(), "ties")
    ties = met.filter("b IS NOT NULL").select("a", "b")
    classes = materialize(connected_components(ties, salts), "classes")
    links = materialize(confirmed_links(rows, classes, percent, width, agree, trees, depth, salts), "links")
    crowded = materialize(open_regions(met.filter("b IS NULL").select(F.col("a").alias("id"), "region"), classes, salts), "crowded")
    if crowded.limit(1).count():
        pass_at = max(1, int(n * share - PASS * (n * share * (1 - share)) ** 0.5))
        links = links.union(materialize(crowded_links(rows, crowded, percent, width, pass_at, n, salts), "crowded-links"))
    found = connected_components(links, salts)
    reps = nodes.join(found, nodes["rep"] == found["id"], "left").select("set_a", "set_b", "n_shingles", F.coalesce("label", "rep").alias("component"))
    # Rows that repeat an id join the sets they have.
    many = all_salts(reps, salts).withColumnsRenamed({c: f"_{c}" for c in ("set_a", "set_b", "n_shingles")}).withColumnRenamed("_salt", "_salt2")
    left = salted(made.select("doc_id", "n_shingles", "set_a", "set_b"), F.xxhash64("doc_id"), salts)
    on = (F.col("set_a") == F.col("_set_a")) & (F.col("set_b") == F.col("_set_b")) & (F.col("n_shingles") == F.col("_n_shingles")) & (F.col("_salt") == F.col("_salt2"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = left.join(many, on, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def confirmed_links(rows: DataFrame, classes: DataFrame, percent: int, width: int, agree: int, trees: int, depth: int, salts: int) -> DataFrame:
    """Links within tied classes, on full sets. A class of many blocks is compared block by block, so no task holds it."""
    sizes = classes.groupBy("label").agg(F.count("*").alias("_n"))
    sizes = all_salts(sizes.select(F.col("label").alias("_label"), F.ceil(F.col("_n") / BLOCK).alias("chunks")), salts).withColumnRenamed("_salt", "_salt2")
    placed = salted(classes, F.xxhash64("id"), salts).join(sizes, (F.col("label") == F.col("_label")) & (F.col("_salt") == F.col("_salt2")))
    placed = placed.select("id", "label", "chunks", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).alias("chunk"))
    placed = materialize(placed, "placed")
    # Only texts of tied documents are shuffled.
    rows = marked(rows, bitmap(placed.select(F.col("id").alias("doc_id")), ID_BITS, "doc_id"), ID_BITS, "_tied", "doc_id").filter("_tied")
    texts = placed.join(rows, placed["id"] == rows["doc_id"]).select("id", "label", "chunk", "chunks", "text")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    pairs = texts.withColumn("_other", other).select("label", F.least("chunk", "_other").alias("a"), F.greatest("chunk", "_other").alias("b"), "chunk", "id", "text")
    return pairs.groupBy("label", "a", "b").applyInPandas(_confirm(percent, width, agree, trees, depth), "a long, b long")


def open_regions(members: DataFrame, classes: DataFrame, salts: int) -> DataFrame:
    """(id, label): members (id, region) of regions that are not of one class. Pairs of one class are all confirmed anyway."""
    own = members.join(classes, "id", "left").select("id", "region", F.coalesce("label", "id").alias("label"))
    several = own.groupBy("region").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high")
    several = all_salts(several.select(F.col("region").alias("_region")), salts).withColumnRenamed("_salt", "_salt2")
    own = salted(own, F.xxhash64("id"), salts).join(several, (F.col("region") == F.col("_region")) & (F.col("_salt") == F.col("_salt2")))
    return own.select("id", "label").distinct()


def crowded_links(rows: DataFrame, crowded: DataFrame, percent: int, width: int, agree: int, n: int, salts: int) -> DataFrame:
    """All links between sets of `crowded` (id, label) of different labels, by a prefix-filter join on rare shingles.

    Shingles are ordered by how many of a sample's sets have them; the sample decides what the join costs, and any order
    gives all links: a set of similarity `percent` shares at least that part of either set, so one of the rest and one
    more, taken in one order from both sets, is common. Common shingles are joined in blocks.
    """
    texts = marked(rows, bitmap(crowded.select(F.col("id").alias("doc_id")), ID_BITS, "doc_id"), ID_BITS, "_crowded", "doc_id").filter("_crowded")
    texts = crowded.join(texts, crowded["id"] == texts["doc_id"]).select("id", "label", "text")
    draw = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) / float(1 << 30) < COUNTED / crowded.count()
    counts = texts.filter(draw).select("text").mapInArrow(_shingles_of(width), "s long").groupBy("s").count().filter("count > 1")
    counts = counts.orderBy(F.desc("count"), "s").limit(COMMON).orderBy("s").toArrow()
    common, often = counts["s"].to_numpy(), counts["count"].to_numpy()
    made = materialize(texts.mapInArrow(_rarest(percent, width, n, common, often), "id long, label long, n long, sig binary, rare array<long>"), "rarest")
    entries = made.select("id", "label", "n", F.explode("rare").alias("s"))
    several = entries.groupBy("s").agg(F.count("*").alias("_n"), F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high")
    several = all_salts(several.select(F.col("s").alias("_s"), F.ceil(F.col("_n") / BLOCK).alias("chunks")), salts).withColumnRenamed("_salt", "_salt2")
    entries = salted(entries, F.xxhash64("id"), salts).join(several, (F.col("s") == F.col("_s")) & (F.col("_salt") == F.col("_salt2"))).select("s", "id", "label", "n", "chunks")
    left = entries.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks"))).alias("l")
    right = entries.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).alias("r")
    near = 100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")
    pairs = left.join(right, (F.col("l.s") == F.col("r.s")) & (F.col("l.chunk") == F.col("r.chunk")) & (F.col("l.label") < F.col("r.label")) & near)
    pairs = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).filter("a <> b").distinct()

    def both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(of.select(F.col("id").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return pairs.select("a", "b", f"{column}_a", f"{column}_b")

    alike = materialize(both(pairs, made, "sig").mapInArrow(_agreeing(agree), "a long, b long").distinct(), "alike")
    ids = alike.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = marked(rows, bitmap(ids, ID_BITS, "doc_id"), ID_BITS, "_alike", "doc_id").filter("_alike").select(F.col("doc_id").alias("id"), "text")
    return both(alike, texts, "text").mapInArrow(_similar(percent, width), "a long, b long").distinct()


def _shingles_of(width: int):
    """Reads texts; gives their shingles, each once a text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = word_numbers()
        for batch in batches:
            for text in batch["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words, width).view("int64"))], ["s"])
        forget_words()

    return run


def _rarest(percent: int, width: int, n: int, common, often):
    """Reads (id, label, text); gives size, signature and the rarest shingles of each set, as many as must hold one that a similar set has too."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words, (fa, fb) = word_numbers(), _functions(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sizes, sigs, rare = [], [], []
                for text in some["text"].to_pylist():
                    s = shingle_set(text, words, width)
                    own = s.view(np.int64)
                    count = np.zeros(len(own), np.int64)
                    if len(common):
                        i = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        count = np.where(common[i] == own, often[i], 0)
                    sizes.append(len(own))
                    sigs.append((signature(s, fa, fb) >> np.uint32(24)).astype(np.uint8).tobytes())
                    rare.append(own[np.lexsort((own, count))[: len(own) - -(-percent * len(own) // 100) + 1]] if len(own) else own)
                yield pa.RecordBatch.from_arrays([some["id"], some["label"], pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(rare, pa.list_(pa.int64()))], ["id", "label", "n", "sig", "rare"])
        forget_words()

    return run


def _agreeing(agree: int):
    """Reads (a, b, sig_a, sig_b); gives pairs whose signatures agree in so many values."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array((x == y).sum(1) >= agree))

    return run


def _similar(percent: int, width: int):
    """Reads (a, b, text_a, text_b); gives pairs that pass on their full sets."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words = word_numbers()
        for batch in batches:
            keep = []
            for x, y in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True):
                x, y = shingle_set(x, words, width), shingle_set(y, words, width)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        forget_words()

    return run
