"""One query per operator, each over its whole table, with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import chat, cover_tree, divergence, exact_dedup, langid, lsh_forest, mixing, packing, pii, quality, repair, simhash, wavelet
from sightline.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@_query(
    "op3_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), digest_all=True)


@_query(
    "op5_mixing",
    r"""
    WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
    c AS (SELECT *, source_size * 2e0 AS cap, source_size * 2e0 / weight AS ratio FROM w),
    l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5e0 - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
    v AS (SELECT level AS v FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
    t AS (SELECT source, source_size, CASE WHEN v IS NULL OR v * weight > cap THEN cap ELSE v * weight END AS target FROM c LEFT JOIN v ON true),
    m AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target / t.source_size) AS whole,
            coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2e0 AS middle
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
      CASE WHEN source_size > 0 THEN CAST(size * (whole + CASE WHEN whole < 2 AND size > 0 AND middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) ELSE 0 END AS taken
    FROM m
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents"))
    taken = F.sum(F.when(F.col("position").isNotNull(), F.col("size")).otherwise(0))
    return rows.groupBy("doc_id", "row_key", "size", "source_size", "target").agg(taken.alias("taken")).drop("row_key")


#: Demonstration key. A real job passes its own secret.
PII_KEY = b"demonstration key of the pii query"


@_query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), PII_KEY)


@_query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@_query(
    "op8_chat",
    r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
    ),
    e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|TURN[ \]])'))
        + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(replace(replace(role, '\', '\\'), ']', '\]')) END AS chars FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.read_back(materialize(chat.format_conversations(rows.unionByName(more)), "formatted"))


@_query("op10_wavelet")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(spark, wavelet.shards_in_work_folder(_table(spark, sf_dir, "documents")))


@_query(
    "op2_near_dedup",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
    c AS (SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM s GROUP BY ALL HAVING len(s) > 0),
    e AS (SELECT id, n, hash(unnest(s)) AS h FROM c),
    l AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.h = y.h AND x.id < y.id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
          GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
    g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT id, id AS reached FROM c UNION SELECT r.id, g.b FROM r JOIN g ON r.reached = g.a),
    m AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
    FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON c.id = m.id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@_query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


@_query(
    "op1_cover_tree",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    p AS (
      SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
    ),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
    SELECT * FROM r WHERE rank <= 5
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cover_tree.quantized(_table(spark, sf_dir, "embeddings"))
    return cover_tree.top_k(rows, F.col("vec_id") % 50 == 0)


@_query(
    "op13_divergence",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM documents
    ),
    u AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS uses, count(DISTINCT r) AS docs FROM u GROUP BY ALL),
    k AS (SELECT lang, term, sum(uses) AS lang_uses FROM c GROUP BY ALL HAVING sum(docs) >= 30),
    l AS (SELECT lang, count(*) AS v, sum(lang_uses) AS lang_total FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    x AS (SELECT g.lang, g.source, k.term, k.lang_uses, coalesce(c.uses, 0) AS uses FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    n AS (SELECT lang, source, sum(uses) AS total FROM x GROUP BY ALL),
    p AS (
      SELECT x.lang, x.source, x.term, x.uses, 1 + (1000000000::HUGEINT * (x.uses + 5)) // (n.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (x.lang_uses + 5)) // (l.lang_total + 5 * l.v) AS q
      FROM x JOIN n ON x.lang = n.lang AND x.source = n.source JOIN l ON x.lang = l.lang
    ),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    f AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE uses > 0 AND p > q
    ),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
    SELECT * FROM r WHERE part = 'pair' OR rank <= 50
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


@_query("op12_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _edit(weight: str, cost: str, letter: str) -> str:
    """SQL of a weight (nine digits of cost, then the audit) after one more edit."""
    return f"lpad(CAST(CAST({weight}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {weight}[10:] || '{letter}'"


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


@_query(
    "op11_repair",
    f"""
    WITH RECURSIVE t AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_CRC32.format(key="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hit FROM conversations
    ),
    d AS (
      SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) FROM t WHERE hit <> 0
    ),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    f AS (
      SELECT conv_id, turn, role, text, i, role[1:1] AS ini, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
        CASE WHEN rtrim(text, ' 	

') = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
          WHEN rtrim(text, ' 	

')[-1:] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
      FROM n
    ),
    r AS (
      SELECT conv_id, 0 AS i, '000000000' AS k0, CAST(NULL AS VARCHAR) AS k1, '000000003I' AS k2, '000000006II' AS k3 FROM (SELECT DISTINCT conv_id FROM n)
      UNION ALL
      SELECT conv_id, i, k0, k1, k2, least(k3, {_edit("k2", "3", "I")}) FROM (
        SELECT conv_id, i, k0, k1, least(k2, {_edit("least(k0, k1, k3)", "3", "I")}) AS k2, k3 FROM (
          SELECT conv_id, i, {_edit("k0", "4", "D")} AS k0, least({_edit("k1", "4", "D")}, CASE WHEN ini = 's' THEN {_edit("k0", "pen", "K")} END) AS k1,
            least({_edit("k2", "4", "D")}, CASE WHEN ini = 'u' THEN {_edit("m", "pen", "K")} END, {_edit("m", "pen + 3", "R")}) AS k2,
            least({_edit("k3", "4", "D")}, CASE WHEN ini = 'a' THEN {_edit("k2", "pen", "K")} END, {_edit("k2", "pen + 3", "R")}) AS k3
          FROM (
            SELECT r.conv_id, f.i, f.ini, k0, k1, k2, k3, least(k0, k1, k3) AS m, CASE f.fault WHEN '' THEN 0 WHEN 't' THEN 3 END AS pen
            FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1
          )
        )
      )
    ),
    a AS (SELECT conv_id, least(k0, k3) AS w, (length(least(k0, k3)) - 9 - len(regexp_extract_all(least(k0, k3), 'D'))) % 2 AS lead FROM r QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
    l AS (SELECT conv_id, lead, unnest(string_split(w[10:], '')) AS e, unnest(range(length(w) - 9)) AS pos FROM a WHERE length(w) > 9),
    o AS (
      SELECT *, CAST(count(*) FILTER (e <> 'I') OVER p AS BIGINT) AS i, (count(*) FILTER (e <> 'D') OVER p - lead) % 2 AS odd FROM l
      WINDOW p AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ),
    p AS (
      SELECT o.conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN f.role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY pos)) AS digest
      FROM o LEFT JOIN f ON o.conv_id IS NOT DISTINCT FROM f.conv_id AND o.i = f.i WHERE e <> 'D' GROUP BY o.conv_id
    ),
    s AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
    )
    SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
      coalesce(CAST(a.w[1:9] AS BIGINT), 0) AS cost, coalesce(a.w[10:], '') AS audit, coalesce(p.digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
      LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, sf_dir, "conversations"))
