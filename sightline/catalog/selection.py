"""Sorts, limits, top-k and frame selection as table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import tables as B
from sightline.catalog.columns import query_vector
from sightline.catalog.registry import query
from sightline.catalog.windows import NEIGHBOUR_SQL, RAW_SQL, merged_sql, raw_intervals, temporal_rerank
from sightline.operators import filters as P
from sightline.operators import intervals as I
from sightline.operators import ranking as K
from sightline.operators.core import rank_rows, top_n
from sightline.session import materialize

TERMS = ["the", "and", "tion", "license", "password", "quelle"]


@query(
    "keyword_topk",
    "WITH s AS (SELECT doc_id, "
    + " + ".join(f"contains(lower(concat_ws(chr(10), text, source)), '{t}')::INTEGER" for t in TERMS)
    + " AS score FROM documents) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 50",
)
def _(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "text", "source")
    return K.keyword_topk(docs, ["text", "source"], TERMS, 50, "doc_id").select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "embedding_topk",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 3),
    s AS (SELECT query_id, vec_id AS seq, label AS video_id, round(list_inner_product(embedding::DOUBLE[], q) / (greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-8) * greatest(sqrt(list_inner_product(q, q)), 1e-8)), 6) AS score FROM embeddings, q)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM s QUALIFY rank <= 10""",
)
def _(spark, sf):
    queries = {i: query_vector(spark, sf, i) for i in range(3)}
    out = K.embedding_topk(B.frames(spark, sf), queries, 10)
    return out.select("query_id", "seq", "video_id", "score", F.col("rank").cast("long").alias("rank"))


CLIPS_SQL = "cl AS (SELECT video_id, min(t_ms) AS lo, max(t_ms) AS hi FROM fr GROUP BY video_id)"


def clips(frames):
    return frames.groupBy("video_id").agg(F.min("t_ms").alias("clip_start_ms"), F.max("t_ms").alias("clip_end_ms"))


@query(
    "midpoint_rank",
    f"""WITH {B.FRAMES_SQL}, {CLIPS_SQL}, d AS (SELECT seq, f.video_id, abs(2 * t_ms - lo - hi) AS mid, least(abs(t_ms - 40000), abs(t_ms - 90000)) * 2 AS anc, t_ms FROM fr f JOIN cl ON f.video_id = cl.video_id)
    SELECT seq, video_id, mid / 2000.0::DOUBLE AS distance_s, greatest(0.0::DOUBLE, 1 - mid / 2000.0::DOUBLE) AS temporal_score, row_number() OVER (PARTITION BY video_id ORDER BY mid, t_ms, seq) AS rank, anc / 2000.0::DOUBLE AS anchor_s FROM d""",
)
def _(spark, sf):
    frames = B.scored_frames(spark, sf)
    near = K.midpoint_distance(frames, clips(frames))
    ranked = rank_rows(near, ["video_id"], "distance2_ms", "t_ms", 2 * I.SLAB_MS, last=["seq"])
    anchored = K.midpoint_distance(frames, clips(frames), [40_000, 90_000])
    anchored = anchored.select("seq", (F.col("distance2_ms") / F.lit(2000.0)).alias("anchor_s"))
    distance = F.col("distance2_ms") / F.lit(2000.0)
    out = ranked.select("seq", "video_id", distance.alias("distance_s"), F.greatest(F.lit(0.0), 1 - distance).alias("temporal_score"), "rank")
    return out.join(anchored, "seq")


def reranked(spark, sf):
    frames = B.scored_frames(spark, sf)
    return temporal_rerank(frames, clips(frames), True, [30_000])


RERANK_SQL = f"""{B.FRAMES_SQL}, {NEIGHBOUR_SQL.format(2000)},
cl AS (SELECT video_id, min(t_ms) AS lo, max(t_ms) AS hi FROM fr GROUP BY video_id),
rb AS (SELECT f.*, lo, hi, CASE WHEN n > 0 THEN 0.18::DOUBLE * (s::DOUBLE / n) ELSE 0.0::DOUBLE END AS bonus, abs(t_ms - 30000) AS d,
  greatest(1000.0::DOUBLE, least(2500.0::DOUBLE, CASE WHEN hi > lo THEN (hi - lo) * 0.2::DOUBLE ELSE 1000.0 END)) AS w FROM fr f JOIN nb ON f.seq = nb.seq JOIN cl ON f.video_id = cl.video_id),
ra AS (SELECT *, bool_or(d <= w) OVER (PARTITION BY video_id) AS alive, 0.25::DOUBLE * greatest(0.0::DOUBLE, 1.0 - d / w) AS pull FROM rb),
rk AS (SELECT seq, video_id, t_ms, d AS distance_ms, round(score_u + bonus + (CASE WHEN alive AND d > w THEN pull * 0.5::DOUBLE ELSE pull END) * 1000000.0::DOUBLE
  + (CASE WHEN hi > lo THEN 0.04::DOUBLE * ((t_ms - lo)::DOUBLE / (hi - lo)) ELSE 0.0 END) * 1000000.0::DOUBLE)::BIGINT AS temporal_u FROM ra)"""


@query(
    "diverse_topk",
    f"""WITH RECURSIVE {RERANK_SQL},
    pk AS (SELECT video_id, max(temporal_u) AS pk FROM rk GROUP BY video_id),
    hi AS (SELECT rk.* FROM rk JOIN pk USING (video_id) WHERE pk - temporal_u <= greatest(20000::DOUBLE, pk * 0.03::DOUBLE)),
    g1 AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY t_ms) <= 1250 THEN 0 ELSE 1 END AS brk FROM hi),
    g2 AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS g FROM g1),
    gr AS (SELECT video_id, g, sum(temporal_u) / count(*)::DOUBLE AS mean, count(*) AS n, max(temporal_u) AS top, min(t_ms) AS t0, median(t_ms) AS mid FROM g2 GROUP BY video_id, g),
    best AS (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY mean DESC, n DESC, top DESC, t0) = 1),
    centre AS (SELECT video_id, seq FROM g2 JOIN best USING (video_id, g) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY abs(t_ms - mid), temporal_u DESC, t_ms, seq) = 1),
    o AS (SELECT rk.*, row_number() OVER (PARTITION BY rk.video_id ORDER BY c.seq IS NULL, temporal_u DESC, distance_ms, t_ms, rk.seq) AS rn FROM rk LEFT JOIN centre c ON rk.video_id = c.video_id AND rk.seq = c.seq),
    walk AS (
      SELECT video_id, 0 AS k, []::BIGINT[] AS seqs, []::BIGINT[] AS ts FROM pk
      UNION ALL
      SELECT walk.video_id, k + 1, list_append(seqs, o.seq), list_append(ts, o.t_ms) FROM walk JOIN o ON o.video_id = walk.video_id
      WHERE k < 5 AND NOT list_contains(seqs, o.seq) AND len(list_filter(ts, lambda c: abs(c - o.t_ms) < 2500)) = 0
      QUALIFY row_number() OVER (PARTITION BY walk.video_id ORDER BY rn) = 1
    ),
    ended AS (SELECT * FROM walk QUALIFY k = max(k) OVER (PARTITION BY video_id)),
    taken AS (SELECT video_id, unnest(seqs) AS seq, unnest(range(len(seqs))) + 1 AS pick FROM ended
      UNION ALL SELECT o.video_id, o.seq, k + row_number() OVER (PARTITION BY o.video_id ORDER BY rn) FROM o JOIN ended ON o.video_id = ended.video_id WHERE NOT list_contains(seqs, o.seq) QUALIFY row_number() OVER (PARTITION BY o.video_id ORDER BY rn) <= 5 - k)
    SELECT t.video_id, t.seq, rk.t_ms, rk.temporal_u, t.pick FROM taken t JOIN rk ON rk.seq = t.seq AND rk.video_id = t.video_id""",
)
def _(spark, sf):
    # Ranked frames feed several branches, so their plan is cut by a written table first.
    ranked = materialize(reranked(spark, sf), "ranked")
    centre = I.best_plateau(ranked.withColumn("score_u", F.col("temporal_u")), ["video_id"], "score_u")
    # Frames stand a second apart, so a chosen one keeps two on either side away.
    return K.diverse_topk(ranked, "video_id", 5, 2500, centre)


@query(
    "anchor_window_select",
    f"""WITH {B.FRAMES_SQL}, a(i, a) AS (VALUES (0, 30500), (1, 200000)),
    r AS (SELECT video_id, seq, t_ms, score_u, i, a, abs(t_ms - a) AS dist, abs(t_ms - a) > 15000 AS outside FROM fr, a),
    near AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY video_id, i ORDER BY outside, dist, score_u DESC, t_ms, seq) <= 10),
    win AS (SELECT * FROM near QUALIFY outside = min(outside) OVER (PARTITION BY video_id, i)),
    asked AS (SELECT *, 0 AS pri FROM win QUALIFY row_number() OVER (PARTITION BY video_id, i ORDER BY dist, t_ms, seq) = 1
      UNION ALL SELECT *, 1 FROM r WHERE t_ms < a QUALIFY row_number() OVER (PARTITION BY video_id, i ORDER BY t_ms DESC, seq) = 1
      UNION ALL SELECT *, 2 FROM r WHERE t_ms > a QUALIFY row_number() OVER (PARTITION BY video_id, i ORDER BY t_ms, seq) = 1),
    goal AS (SELECT w.video_id, w.i, greatest(4, any_value(k.n), least(5, count(*))) AS goal FROM win w JOIN (SELECT video_id, i, count(DISTINCT seq) AS n FROM asked GROUP BY ALL) k ON w.video_id = k.video_id AND w.i = k.i GROUP BY w.video_id, w.i),
    wish AS (SELECT * FROM asked UNION ALL SELECT *, 2 + row_number() OVER (PARTITION BY video_id, i ORDER BY dist, score_u DESC, t_ms) FROM win),
    u AS (SELECT * FROM wish QUALIFY row_number() OVER (PARTITION BY video_id, i, seq ORDER BY pri) = 1),
    one AS (SELECT u.* FROM u JOIN goal g ON u.video_id = g.video_id AND u.i = g.i WHERE u.i = 0 QUALIFY row_number() OVER (PARTITION BY u.video_id ORDER BY pri) <= any_value(goal) OVER (PARTITION BY u.video_id)),
    held AS (SELECT video_id, count(*) AS n FROM one GROUP BY video_id),
    two AS (SELECT u.* FROM u JOIN goal g ON u.video_id = g.video_id AND u.i = g.i JOIN held h ON h.video_id = u.video_id
      WHERE u.i = 1 AND NOT EXISTS (SELECT 1 FROM one o WHERE o.video_id = u.video_id AND o.seq = u.seq)
      QUALIFY row_number() OVER (PARTITION BY u.video_id ORDER BY pri) <= any_value(greatest(1, goal - h.n)) OVER (PARTITION BY u.video_id)),
    t AS (SELECT * FROM one UNION ALL SELECT * FROM two)
    SELECT video_id, seq, t_ms, score_u, a::BIGINT AS anchor_ms, dist::BIGINT AS distance_ms, CASE WHEN pri = 0 THEN 'anchor' WHEN t_ms < a THEN 'before' ELSE 'after' END AS role FROM t""",
)
def _(spark, sf):
    return K.anchor_window_select(B.scored_frames(spark, sf), "video_id", [30_500, 200_000], 4, 15_000)


@query(
    "per_clip_topk",
    """WITH RECURSIVE f AS (SELECT vec_id AS frame_key, label % 2 AS request_id, label // 2 AS clip_no, round(abs(embedding[1]::DOUBLE) * 1000000)::BIGINT AS score_u FROM embeddings
      UNION ALL SELECT vec_id, label % 2, label // 2 + 1, round(abs(embedding[1]::DOUBLE) * 1000000)::BIGINT FROM embeddings WHERE label < 8),
    g(clip_no, seen) AS (
      SELECT -1, []::STRUCT(request_id INTEGER, clip_no INTEGER, frame_key BIGINT, score_u BIGINT)[]
      UNION ALL
      SELECT g.clip_no + 1, list_concat(g.seen, (SELECT coalesce(list({'request_id': request_id, 'clip_no': clip_no, 'frame_key': frame_key, 'score_u': score_u}), []) FROM (
         SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score_u DESC, frame_key) AS n FROM f
         WHERE f.clip_no = g.clip_no + 1 AND NOT list_contains(list_transform(g.seen, lambda s: s.request_id || '/' || s.frame_key), f.request_id || '/' || f.frame_key)) WHERE n <= 3))
      FROM g WHERE g.clip_no < 4)
    SELECT s.request_id, s.clip_no, s.frame_key, s.score_u, row_number() OVER (PARTITION BY s.request_id ORDER BY s.score_u DESC, s.clip_no, s.frame_key) AS place FROM (SELECT unnest(seen) AS s FROM g WHERE clip_no = 4)""",
)
def _(spark, sf):
    frames = B.scored_frames(spark, sf)
    base = frames.select(
        (F.col("video_id") % 2).alias("request_id"), F.floor(F.col("video_id") / 2).cast("int").alias("clip_no"), F.col("seq").alias("frame_key"),
        "score_u", F.lit(None).cast("long").alias("distance_ms"), "t_ms", "video_id",
    )
    # The next clip of the request also holds the frame, so frames repeat across clips.
    again = base.filter("video_id < 8").withColumn("clip_no", F.col("clip_no") + 1)
    return K.per_clip_topk(base.unionByName(again).drop("video_id"), 3, clips=2).select("request_id", "clip_no", "frame_key", "score_u", "place")


@query(
    "per_clip_window",
    f"""WITH RECURSIVE {B.FRAMES_SQL}, f AS (SELECT video_id % 2 AS request_id, (video_id // 2 + c)::INTEGER AS clip_no, seq AS frame_key, t_ms, CASE WHEN seq % 3 = 0 THEN t_ms - seq % 5 * 100 ELSE t_ms END AS asked FROM fr, range(2) x(c) WHERE c = 0 OR video_id < 8),
    g(clip_no, seen) AS (
      SELECT -1, []::STRUCT(request_id BIGINT, clip_no INTEGER, frame_key BIGINT, t_ms BIGINT, asked BIGINT)[]
      UNION ALL
      SELECT g.clip_no + 1, list_concat(g.seen, (SELECT coalesce(list({{'request_id': request_id, 'clip_no': clip_no, 'frame_key': frame_key, 't_ms': t_ms, 'asked': asked}}), []) FROM (
         SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY clip_no * 100, asked, t_ms, frame_key) AS n FROM f
         WHERE f.clip_no = g.clip_no + 1 AND NOT list_contains(list_transform(g.seen, lambda s: s.request_id || '/' || s.frame_key), f.request_id || '/' || f.frame_key)) WHERE n <= 7))
      FROM g WHERE g.clip_no < 5)
    SELECT s.request_id, s.clip_no, s.frame_key, row_number() OVER (PARTITION BY s.request_id ORDER BY s.clip_no * 100, s.asked, s.t_ms, s.frame_key) AS place FROM (SELECT unnest(seen) AS s FROM g WHERE clip_no = 5)""",
)
def _(spark, sf):
    frames = B.scored_frames(spark, sf)
    asked = F.when(F.col("seq") % 3 == 0, F.col("t_ms") - F.col("seq") % 5 * 100)
    base = frames.select((F.col("video_id") % 2).alias("request_id"), F.floor(F.col("video_id") / 2).cast("int").alias("clip_no"), F.col("seq").alias("frame_key"), "score_u", F.lit(None).cast("long").alias("distance_ms"), "t_ms", asked.alias("requested_ms"), "video_id")
    again = base.filter("video_id < 8").withColumn("clip_no", F.col("clip_no") + 1)
    both = base.unionByName(again).withColumn("clip_start_ms", (F.col("clip_no") * 100).cast("long")).drop("video_id")
    return K.per_clip_topk(both, 7, "anchor_window", clips=2).select("request_id", "clip_no", "frame_key", "place")


@query(
    "global_topk_multi",
    f"WITH {B.FRAMES_SQL} SELECT video_id AS request_id, seq, row_number() OVER (PARTITION BY video_id ORDER BY score_u // 50000 DESC, score_u % 1000 DESC, t_ms, seq) AS rank FROM fr QUALIFY rank <= 6",
)
def _(spark, sf):
    relevance, temporal = F.floor(F.col("score_u") / 50_000), F.col("score_u") % 1000
    best = top_n(B.scored_frames(spark, sf), ["video_id"], [relevance.desc(), temporal.desc(), F.asc("t_ms"), F.asc("seq")], 6)
    return best.select(F.col("video_id").alias("request_id"), "seq", F.col("rank").cast("long").alias("rank"))


@query(
    "first_k_intervals",
    f"""WITH {RAW_SQL}, {merged_sql('tidy', 'video_id')},
    a AS (SELECT video_id, start_ms, end_ms, 'time' AS kind, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) AS pos FROM merged),
    b AS (SELECT video_id, start_ms, end_ms, 'arrival' AS kind, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS pos FROM tidy)
    SELECT * FROM a WHERE pos <= 5 UNION ALL SELECT * FROM b WHERE pos <= 5""",
)
def _(spark, sf):
    rows = I.tidy_intervals(raw_intervals(spark, sf))
    by_time = I.first_intervals(I.merge_intervals(rows, ["video_id"]).drop("n"), ["video_id"], 5).withColumn("kind", F.lit("time"))
    arrival = top_n(rows, ["video_id"], [F.asc("seq")], 5, "pos").withColumn("kind", F.lit("arrival"))
    cols = ["video_id", "start_ms", "end_ms", "kind", F.col("pos").cast("long").alias("pos")]
    return by_time.select(*cols).unionByName(arrival.select(*cols))


@query(
    "frame_pool_bounds",
    f"""WITH {B.FRAMES_SQL}, {CLIPS_SQL},
    b AS (SELECT video_id, lo, hi, greatest(lo, 100000) AS a0, least(hi, 120000) AS a1 FROM cl),
    p AS (SELECT video_id, hi - lo > greatest(30000, greatest(0, a1 - a0) + 8000) AS long, lo, hi, a0, a1 FROM b),
    r AS (SELECT video_id, greatest(0, CASE WHEN long THEN a0 - 2000 ELSE least(lo, a0) - 2000 END) AS lo_ms, CASE WHEN long THEN a1 + 2000 ELSE greatest(hi, a1) + 2000 END AS hi_ms FROM p)
    SELECT seq, f.video_id, lo_ms, hi_ms FROM fr f JOIN r ON f.video_id = r.video_id QUALIFY t_ms BETWEEN lo_ms AND hi_ms OR NOT bool_or(t_ms BETWEEN lo_ms AND hi_ms) OVER (PARTITION BY f.video_id)""",
)
def _(spark, sf):
    frames = B.scored_frames(spark, sf)
    pools = K.frame_pool(clips(frames), [100_000, 120_000], 2000)
    return K.within_pool(frames, pools).select("seq", "video_id", "lo_ms", "hi_ms")


@query(
    "findings_order",
    """WITH f AS (SELECT o_orderkey, unnest(['low', 'HIGH', '', 'medium', 'other']) AS severity, unnest([o_orderstatus, o_orderpriority, ' ', o_orderstatus, o_orderpriority]) AS category, unnest(['c' || o_custkey, 'x', '', 'b', 'a']) AS message FROM orders),
    k AS (SELECT o_orderkey, coalesce(nullif(upper(trim(severity)), ''), 'MEDIUM') AS severity, trim(category) AS category, message FROM f WHERE trim(category) <> '' OR message <> '')
    SELECT o_orderkey, severity, category, message, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 99 END, category, message) - 1 AS pos FROM k""",
)
def _(spark, sf):
    def finding(severity, category, message):
        return F.struct(severity.alias("severity"), category.alias("category"), message.alias("message"), F.array(F.lit("e")).alias("evidence_ids"))

    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    findings = F.array(
        finding(F.lit("low"), status, F.concat(F.lit("c"), "o_custkey")), finding(F.lit("HIGH"), priority, F.lit("x")), finding(F.lit(""), F.lit(" "), F.lit("")),
        finding(F.lit("medium"), status, F.lit("b")), finding(F.lit("other"), priority, F.lit("a")),
    )
    rows = B.table(spark, sf, "orders").select("o_orderkey", F.posexplode(P.ordered_findings(findings)).alias("pos", "f"))
    return rows.select("o_orderkey", "f.severity", "f.category", "f.message", F.col("pos").cast("long").alias("pos"))


@query(
    "select_by_index_limit",
    "SELECT 'index' AS kind, item_id FROM (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 1 OFFSET 3) UNION ALL SELECT 'limit', item_id FROM (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 7)",
)
def _(spark, sf):
    tasks = B.table(spark, sf, "benchmark").select("item_id")
    one = K.select_rows(tasks, "item_id", index=3).withColumn("kind", F.lit("index"))
    return one.unionByName(K.select_rows(tasks, "item_id", limit=7).withColumn("kind", F.lit("limit")))


@query(
    "recent_steps",
    f"WITH {B.OBS_SQL} SELECT evidence_id AS run_id, seq, predicate AS step FROM obs QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY seq DESC) <= 20",
)
def _(spark, sf):
    rows = B.observations(spark, sf).select(F.col("evidence_id").alias("run_id"), "seq", F.col("predicate").alias("step"))
    return top_n(rows, ["run_id"], [F.desc("seq")], 20, "back").drop("back")
