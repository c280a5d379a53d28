"""Exact top-k search by inner product with two cover trees.

Queries and data are both dealt to blocks around pivots (the trees' top level), and every block holds a cover tree of
its own. A pair of nodes is dropped when the largest inner product it could hold, from the two centres and covering
radii, is under the worst k-th score of the query node's queries. A first round searches the block at each query
block's own pivot for such scores; the second one visits the other block pairs that the bound leaves.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import materialize

#: Rows of a data block and of a query block, most pivots (drawn by a hash of the id), points of a leaf.
DATA_ROWS, QUERY_ROWS, PIVOTS, LEAF = 2048, 256, 256, 64


class CoverTree:
    """Nodes with a centre (a point), the covering radius of all points below, and those points as a range.

    Children of a node of radius R are a net: every point lies within R / 2 of its child's centre, and the centres lie
    further apart than that. A node whose net would have more centres than a quarter of its points is a leaf.
    """

    def __init__(self, points, ids):
        import numpy as np

        self.exact, self.ids = points, np.asarray(ids)
        self.points = np.asarray(points, dtype=np.float64)
        self.nodes: list[tuple[int, float, int, int, list[int]]] = []
        self.order = np.arange(len(self.points))
        self._build(0, len(self.points))
        self.points, self.exact, self.ids = self.points[self.order], self.exact[self.order], self.ids[self.order]
        self.centres = np.array([self.points[n[0]] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])
        self.norms = np.sqrt((self.centres**2).sum(1))

    def to_bytes(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def from_bytes(cls, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(data))
        return tree

    def _build(self, lo: int, hi: int) -> int:
        import numpy as np

        own = self.order[lo:hi]
        x = self.points[own]
        away = np.sqrt(((x - x[0]) ** 2).sum(1))
        radius = float(away.max())
        at = len(self.nodes)
        self.nodes.append((lo, radius, lo, hi, []))
        if hi - lo <= LEAF or radius == 0:
            return at
        nearest, best, centres = np.zeros(len(own), np.int64), away.copy(), 1
        # Furthest point first, until all lie within half the radius.
        while (far := int(best.argmax())) is not None and best[far] > radius / 2:
            if centres >= len(own) // 4:
                return at
            d = np.sqrt(((x - x[far]) ** 2).sum(1))
            closer = d < best
            nearest[closer], best[closer] = centres, d[closer]
            centres += 1
        # A child's centre comes first in its range, and the node's own centre in the first child's.
        sort = np.lexsort((best, nearest))
        self.order[lo:hi] = own[sort]
        bounds = np.searchsorted(nearest[sort], np.arange(centres + 1))
        for a, b in zip(bounds, bounds[1:], strict=False):
            self.nodes[at][4].append(self._build(lo + int(a), lo + int(b)))
        return at


def _products(a, b):
    """Exact inner products of integer vectors: in floating point while every sum stays under 2^53, else in integers of any length, held to 64 bits."""
    import numpy as np

    largest = max(1, int(abs(a).max(initial=0))) * max(1, int(abs(b).max(initial=0))) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    top = (1 << 63) - 1
    return np.clip(a.astype(object) @ b.astype(object).T, -top, top).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, k: int, kth):
        self.k, self.kth = k, kth
        self.held: list[list[tuple[int, int]]] = [[] for _ in kth]

    def offer(self, q: int, scores, ids) -> None:
        own = self.held[q]
        own.extend(zip((-scores).tolist(), ids.tolist(), strict=True))
        own.sort()
        del own[self.k :]
        if len(own) == self.k:
            self.kth[q] = max(self.kth[q], -own[-1][0])


def search(queries: CoverTree, data: CoverTree, best: Best) -> int:
    """Dual-tree search of one block pair; gives the number of node pairs visited."""
    import numpy as np

    slack = 1e-9

    def bound(q: int, ds):
        rq = queries.radii[q]
        dots = data.centres[ds] @ queries.centres[q]
        top = dots + queries.norms[q] * data.radii[ds] + data.norms[ds] * rq + rq * data.radii[ds]
        return top + slack * (np.abs(dots) + top + 1)

    stack = [(0, 0, float(bound(0, [0])[0]))]
    visited = 0
    while stack:
        q, d, top = stack.pop()
        _, rq, qa, qb, qkids = queries.nodes[q]
        _, rd, da, db, dkids = data.nodes[d]
        if top < best.kth[qa:qb].min():
            continue
        visited += 1
        if not qkids and not dkids:
            scores = _products(queries.exact[qa:qb], data.exact[da:db])
            other = queries.ids[qa:qb, None] != data.ids[None, da:db]
            good = other & (scores >= best.kth[qa:qb, None])
            for i in np.flatnonzero(good.any(1)).tolist():
                cols = np.flatnonzero(good[i])
                best.offer(qa + i, scores[i, cols], data.ids[da + cols])
            continue
        # Open the wider of the two, and look at its best child first (last on the stack).
        if qkids and (not dkids or rq > rd):
            more = [(k, d, float(bound(k, [d])[0])) for k in qkids]
        else:
            more = [(q, k, t) for k, t in zip(dkids, bound(q, dkids).tolist(), strict=True)]
        stack += sorted(more, key=lambda m: m[2])
    return visited


_BLOCK = "block long, pivot int, first boolean, n long, centre array<double>, radius double, data binary"


def _nearest(pivots):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        p = np.asarray(pivots, dtype=np.float64)
        for batch in batches:
            x = np.asarray(batch["v"].to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            near = ((p**2).sum(1) - 2 * (x @ p.T)).argmin(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(near, pa.int32())], ["id", "v", "pivot"])

    return run


def _blocks(rows: DataFrame, pivots: list, size: int) -> DataFrame:
    """Rows (id, v) as blocks of about `size` around their nearest pivots, each with its cover tree. A crowded pivot has many blocks, dealt by id."""
    placed = materialize(rows.mapInArrow(_nearest(pivots), "id long, v array<long>, pivot int"), "pivoted")
    counts = {r["pivot"]: r["count"] for r in placed.groupBy("pivot").count().collect()}  # a row per pivot at most
    parts = {p: -(-n // size) for p, n in counts.items()}
    before, at = {}, 0
    for p in sorted(parts):
        before[p], at = at, at + parts[p]

    def tree(key, table):
        import numpy as np
        import pyarrow as pa

        v = np.asarray(table["v"].to_pylist(), dtype=np.int64)
        ids = table["id"].to_numpy()
        order = np.lexsort((*v.T[::-1], ids))
        v = v[order]
        v = v.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max))
        t = CoverTree(v, ids[order])
        block = key[0].as_py()
        row = {"block": [block], "pivot": [table["pivot"][0].as_py()], "first": [block in starts], "n": [len(v)], "centre": [t.centres[0].tolist()], "radius": [t.radii[0]], "data": [t.to_bytes()]}
        kinds = [("block", pa.int64()), ("pivot", pa.int32()), ("first", pa.bool_()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("data", pa.binary())]
        return pa.Table.from_pydict(row, schema=pa.schema(kinds))

    starts = set(before.values())
    if not counts:
        return rows.sparkSession.createDataFrame([], _BLOCK)
    of = F.create_map(*[x for p in parts for x in (F.lit(p), F.struct(F.lit(before[p]).alias("at"), F.lit(parts[p]).alias("n")))])
    own = F.element_at(of, F.col("pivot"))
    placed = placed.withColumn("block", (own["at"] + F.pmod(F.xxhash64("id", "v"), own["n"])).cast("long"))
    return materialize(placed.groupBy("block").applyInArrow(tree, _BLOCK), "cover-trees")


_FOUND = "qblock long, query_id long, query_row long, vec_id long, score long, kth long"


def _search(k: int):
    """Pairs (qblock, qdata, kth, data) to each query's k best of the pair."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                queries, data = CoverTree.from_bytes(batch["qdata"][i].as_py()), CoverTree.from_bytes(batch["data"][i].as_py())
                given = batch["kth"][i].as_py()
                lowest = np.iinfo(np.int64).min
                kth = np.full(len(queries.ids), lowest) if given is None else np.asarray([lowest if g is None else g for g in given], dtype=np.int64)
                best = Best(k, kth)
                search(queries, data, best)
                rows = [(q, vec, -minus) for q, held in enumerate(best.held) for minus, vec in held]
                q = np.array([r[0] for r in rows], np.int64)
                columns = [pa.array(np.full(len(rows), batch["qblock"][i].as_py())), pa.array(queries.ids[q] if len(rows) else q), pa.array(q), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(best.kth[q] if len(rows) else q)]
                yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], ["qblock", "query_id", "query_row", "vec_id", "score", "kth"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector", data_rows: int = DATA_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For every query row its k best other rows by inner product: query_id, rank, vec_id, score.

    `vectors` holds integer vectors; `is_query` is a condition on its id and marks the queries. Rows with a null id or
    vector take no part, equal rows count once, a shorter vector is filled up with zeros. A query meets no row with its
    own id; of rows that share an id but not the vector each is a query and a candidate of its own. Ties go to the
    smaller id. With no rows or no queries the result is empty. Vectors that many rows share are searched as their k + 1
    smallest ids, which decide the same results.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v"), is_query.alias("q")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = materialize(rows.dropDuplicates(["id", "v"]), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(width) - F.size("v"), F.lit(0)))))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    data = materialize(rows.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1).select("id", "v"), "distinct-vectors")
    queries = rows.filter("q").select("id", "v")
    n, n_queries = data.count(), queries.count()
    result = "query_id long, rank int, vec_id long, score long"
    if not n or not n_queries:
        return spark.createDataFrame([], result)
    drawn = [r["v"] for r in data.select(F.xxhash64("v").alias("o"), "v").distinct().orderBy("o", "v").limit(min(PIVOTS, max(1, n // data_rows))).collect()]
    trees = _blocks(data, drawn, data_rows)
    groups = _blocks(queries, drawn[: max(1, n_queries // query_rows)], query_rows)
    q = groups.select(F.col("block").alias("qblock"), F.col("pivot").alias("qpivot"), F.col("centre").alias("qcentre"), F.col("radius").alias("qradius"), F.col("data").alias("qdata"))
    home = q.join(trees.filter("first"), F.col("qpivot") == F.col("pivot")).select("qblock", "qdata", F.lit(None).cast("array<long>").alias("kth"), "data")
    seeds = materialize(home.mapInArrow(_search(k), _FOUND), "seeds")
    # The k-th scores of a block's queries, in the order of its tree, and the worst of them (none while one has fewer than k).
    kth = seeds.groupBy("qblock", "query_row").agg(F.max("kth").alias("kth"), F.count("*").alias("n"))
    kth = kth.groupBy("qblock").agg(F.map_from_entries(F.collect_list(F.struct("query_row", F.when(F.col("n") == k, F.col("kth")).alias("kth")))).alias("_kth"))
    sized = groups.select(F.col("block").alias("qblock"), "n")
    kth = sized.join(kth, "qblock", "left").withColumn("kth", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("_kth", i)))
    worst = F.when(F.forall("kth", lambda x: x.isNotNull()), F.array_min("kth"))
    kth = kth.select("qblock", "kth", worst.alias("worst"))
    # Every query block with every other data block, centres and radii only; the trees join what the bound leaves.
    last = trees.agg(F.max("block")).first()[0]
    pairs = q.drop("qdata").join(kth, "qblock").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    pairs = pairs.join(trees.select("block", "pivot", "first", "centre", "radius"), "block").filter(~(F.col("first") & (F.col("pivot") == F.col("qpivot"))))
    dot = _dot("qcentre", "centre")
    top = dot + F.sqrt(_dot("qcentre", "qcentre")) * F.col("radius") + F.sqrt(_dot("centre", "centre")) * F.col("qradius") + F.col("qradius") * F.col("radius")
    pairs = pairs.withColumn("_top", top * (1 + 1e-9) + 1).filter(F.col("worst").isNull() | (F.col("_top") >= F.col("worst"))).select("qblock", "block", "kth")
    pairs = pairs.join(trees.select("block", "data"), "block").join(q.select("qblock", "qdata"), "qblock").select("qblock", "qdata", "kth", "data")
    found = seeds.unionByName(pairs.mapInArrow(_search(k), _FOUND))
    rank = F.row_number().over(Window.partitionBy("qblock", "query_row").orderBy(F.desc("score"), "vec_id"))
    # Rows that share an id but not the vector may both be found; each is a result.
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def quantized(rows: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """Adds `vector`: floor(scale * x) of every component as a double; null where the vector is null, or holds null or a number that is not finite."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return rows.withColumn("vector", F.when(finite, F.transform(x, lambda c: F.floor(c * scale).cast("long"))))
