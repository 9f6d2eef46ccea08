"""Queries over versioned records: levels, latest rows, occurrences, reach, state along an order, chains and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.functions import hashing, hunks, sketch, text
from lamina.operators import asof, claims, graph
from lamina.sources import tables

_LEVEL_SQL = "CASE event_type WHEN 'click' THEN 'none' WHEN 'view' THEN 'raw' WHEN 'signup' THEN 'alpha' WHEN 'purchase' THEN 'shape' WHEN 'error' THEN 'death' ELSE 'token' END"
_CHANGES_SQL = f"c AS (SELECT event_id AS commit, event_id AS topo, ts AS at_ts, user_id AS lineage, event_type AS name, user_id::VARCHAR || '/' || coalesce((props::JSON->>'$.k')::BIGINT, -1)::VARCHAR AS entity, (props::JSON->>'$.k')::BIGINT AS k, {_LEVEL_SQL} AS change_level, value FROM events)"


def change_level_histogram(spark: SparkSession, d: str) -> DataFrame:
    t = tables.turns(spark, d)
    layers = {k: hashing.sha(F.col(k)) for k in ("raw", "token", "alpha", "shape")}
    before = {k: hashing.sha(F.col(f"prev.{k}")) for k in layers}
    level = F.when(F.col("prev").isNull(), "birth").otherwise(hashing.change_level(before | {"profile": F.lit("text")}, layers | {"profile": F.lit("text")}))
    return t.select("role", level.alias("change_level")).groupBy("role", "change_level").agg(F.count("*").alias("changes"))


def hotspots_users(spark: SparkSession, d: str, limit: int = 20) -> DataFrame:
    c = tables.event_changes(spark, d)
    real = c.where("change_level <> 'none'")
    counted = real.groupBy("lineage").agg(
        F.sum(F.when(F.col("change_level") == "shape", 1).otherwise(0)).alias("structural"), F.count("*").alias("changes"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max_by("name", "topo").alias("last_name")
    )
    shown = counted.where("structural >= 2").withColumn("authored_days", F.round(text.days_between(F.col("first_at"), F.col("last_at")), 6))
    top = shown.orderBy(F.desc("structural"), F.desc("changes"), F.asc("lineage")).limit(limit)
    return top.select("lineage", "structural", "changes", "authored_days", "last_name", F.round(text.annual_rate(F.col("structural"), F.col("authored_days")), 4).alias("annual_rate"))


def latest_record_per_entity(spark: SparkSession, d: str) -> DataFrame:
    return asof.latest_by(tables.event_changes(spark, d), ["entity"], ["topo"], ["topo", "name", "change_level"])


def occurrence_numbering(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents").select("source", "lang", "doc_id")
    return asof.occurrences(docs, ["source", "lang"], ["doc_id"]).select("doc_id", "occurrence")


def reach_per_commit(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("entity"), F.when(F.col("l_returnflag") == "R", "none").otherwise("shape").alias("change_level"))
    return claims.reach(rows)


def strongest_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("subject"), F.when(F.col("l_returnflag") == "R", "none").otherwise("shape").alias("change_level"))
    reach = claims.reach(rows).select("commit", "entities")
    own = rows.join(reach, "commit", "left").withColumn("n", F.coalesce("entities", F.lit(1)))
    return own.groupBy("subject").agg(
        F.min(F.when(F.col("n") <= 1, 0).otherwise(1)).cast("bigint").alias("strongest"), F.count_distinct(F.when(F.col("change_level") == "shape", F.col("entity"))).alias("structural_entities"),
        F.count_distinct(F.when(F.col("change_level") == "none", F.col("entity"))).alias("idle_entities"), F.count_distinct("commit").alias("commits"),
    )


def content_dedup_dim(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents")
    key = hashing.content_key(hashing.sha(F.col("text")), F.col("lang"), F.col("n_chars"))
    return docs.select(key.alias("content_key"), "doc_id").groupBy("content_key").agg(F.count("*").alias("revisions"), F.min("doc_id").alias("first_doc"))


def minhash_estimate(spark: SparkSession, d: str) -> DataFrame:
    items = tables.read(spark, d, "benchmark")
    grams = sketch.ngram_set(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: w != ""))
    signed = items.select("item_id", grams.alias("grams")).withColumn("sig", sketch.minhash(F.col("grams")))
    a, b = signed.alias("a"), signed.alias("b")
    pairs = a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1)
    return pairs.select(F.col("a.item_id").alias("item_id"), F.col("a.sig")[0].alias("first_slot"), F.col("a.sig")[127].alias("last_slot"), F.round(sketch.estimate_jaccard(F.col("a.sig"), F.col("b.sig")), 6).alias("estimate"), F.round(sketch.exact_jaccard(F.col("a.grams"), F.col("b.grams")), 6).alias("exact"))


_COEFFICIENTS = sketch.coefficients()
_WORDS_SQL = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')"


def _grams_sql(words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < 3 THEN [array_to_string({words}, chr(30))] ELSE list_distinct(list_transform(range(1, len({words}) - 1), lambda i: array_to_string({words}[i:i + 2], chr(30)))) END"


MINHASH_SQL = f"""
WITH w AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
g AS (SELECT item_id, unnest({_grams_sql("ws")}) AS s FROM w),
h AS (SELECT DISTINCT item_id, ('0x' || substr(sha1(s), 1, 8))::BIGINT % 2147483647 AS x FROM g),
k AS (SELECT unnest([{", ".join(str(a) for a, _ in _COEFFICIENTS)}]::BIGINT[]) AS a, unnest([{", ".join(str(b) for _, b in _COEFFICIENTS)}]::BIGINT[]) AS b, unnest(range(0, 128)) AS i),
m AS (SELECT item_id, i, min((a * x + b) % 2147483647) AS v FROM h, k GROUP BY item_id, i),
e AS (SELECT p.item_id, sum(CASE WHEN p.v = q.v THEN 1 ELSE 0 END) / 128.0 AS estimate, min(CASE WHEN p.i = 0 THEN p.v END) AS first_slot, min(CASE WHEN p.i = 127 THEN p.v END) AS last_slot FROM m p JOIN m q ON q.item_id = p.item_id + 1 AND q.i = p.i GROUP BY p.item_id),
n AS (SELECT item_id, count(*) AS n FROM h GROUP BY item_id),
b AS (SELECT p.item_id, count(*) AS n FROM h p JOIN h q ON q.item_id = p.item_id + 1 AND q.x = p.x GROUP BY p.item_id)
SELECT e.item_id, e.first_slot, e.last_slot, round(e.estimate, 6)::DOUBLE AS estimate, round(coalesce(b.n, 0)::DOUBLE / (x.n + y.n - coalesce(b.n, 0)), 6) AS exact
FROM e JOIN n x ON x.item_id = e.item_id JOIN n y ON y.item_id = e.item_id + 1 LEFT JOIN b ON b.item_id = e.item_id
"""


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """Line items as declarations (start, end) with two hunks of their file."""
    c = F.col
    i = tables.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_partkey") % 50 + 1).alias("s"), (c("l_partkey") % 50 + 1 + c("l_suppkey") % 10).alias("e"))
    first = F.struct((c("l_orderkey") % 20 + 1).alias("old_start"), (c("l_orderkey") % 3).alias("old_count"), (c("l_orderkey") % 20 + 1).alias("new_start"), (c("l_partkey") % 4).alias("new_count"))
    second = F.struct((c("l_orderkey") % 30 + 30).alias("old_start"), (c("l_suppkey") % 2).alias("old_count"), (c("l_orderkey") % 30 + 31).alias("new_start"), (c("l_linenumber") % 3).cast("bigint").alias("new_count"))
    return i.withColumn("hunks", F.array(first, second))


def hunk_geometry(spark: SparkSession, d: str) -> DataFrame:
    r = _ranges(spark, d)
    old = hunks.old_range(F.col("hunks"), F.col("s"), F.col("e"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", hunks.touched(F.col("hunks"), F.col("s"), F.col("e")).cast("bigint").alias("touched"), old["start"].alias("old_start"), old["end"].alias("old_end"), hunks.inside_pure_add(F.col("hunks"), F.col("s"), F.col("e")).cast("bigint").alias("pure_add"))


_RANGES_SQL = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 50 + 1 AS s, l_partkey % 50 + 1 + l_suppkey % 10 AS e,
  [{'os': l_orderkey % 20 + 1, 'oc': l_orderkey % 3, 'ns': l_orderkey % 20 + 1, 'nc': l_partkey % 4}, {'os': l_orderkey % 30 + 30, 'oc': l_suppkey % 2, 'ns': l_orderkey % 30 + 31, 'nc': (l_linenumber % 3)::BIGINT}] AS hs FROM lineitem),
g AS (SELECT *, len(list_filter(hs, lambda h: CASE WHEN h.nc > 0 THEN h.ns <= e AND h.ns + h.nc - 1 >= s ELSE s <= h.ns AND h.ns <= e END)) > 0 AS t,
  coalesce(list_sum(list_transform(list_filter(hs, lambda h: CASE WHEN h.nc > 0 THEN h.ns + h.nc - 1 < s ELSE h.ns < s END), lambda h: h.nc - h.oc)), 0)::BIGINT AS shift,
  len(list_filter(hs, lambda h: h.oc = 0 AND h.nc > 0 AND h.ns <= s AND e <= h.ns + h.nc - 1)) > 0 AS a FROM r)"""


def hunk_evidence_tristate(spark: SparkSession, d: str) -> DataFrame:
    """Per part and order: 2 if any hunk touches, 1 if there are hunks but none does, 0 without hunks."""
    r = _ranges(spark, d).withColumn("hunks", F.when(F.col("l_orderkey") % 4 != 0, F.col("hunks")))
    state = F.when(F.col("hunks").isNull(), 0).when(hunks.touched(F.col("hunks"), F.col("s"), F.col("e")), 2).otherwise(1)
    return r.groupBy("l_partkey", "l_orderkey").agg(F.max(state).cast("bigint").alias("evidence"))


def path_state_fold(spark: SparkSession, d: str) -> DataFrame:
    e = tables.event_changes(spark, d).select(F.col("lineage").alias("repo"), F.col("k").alias("path"), "topo", F.when(F.col("change_level") != "death", F.col("name")).alias("value"))
    return asof.folded_state(e, ["repo", "path"], ["topo"], "value").select("repo", "path", "value")


def first_parent_chain(spark: SparkSession, d: str) -> DataFrame:
    o = tables.read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("node"))
    links = o.select("node", F.lag("node").over(W.partitionBy("o_custkey").orderBy("node")).alias("prev"))
    return graph.chain_roots(links)


def ancestors_closure(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = tables.read(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("p1"), F.lag("o_orderkey", 2).over(w).alias("p2"))
    edges = o.select(F.col("o_orderkey").alias("child"), F.explode(F.array("p1", "p2")).alias("parent"))
    return graph.ancestors(edges, include_self=False).groupBy("node").agg(F.count("*").alias("ancestors"), F.min("ancestor").alias("oldest"))


def locf_state(spark: SparkSession, d: str) -> DataFrame:
    e = tables.event_changes(spark, d)
    before = asof.previous_value(F.when(F.col("name") == "purchase", F.col("topo")), ["lineage"], ["topo"])
    return e.select("topo", before.alias("last_purchase"))


def asof_previous_occupant(spark: SparkSession, d: str) -> DataFrame:
    e = tables.event_changes(spark, d)
    left = e.select("lineage", "topo", "at")
    right = e.where("name = 'purchase'").select("lineage", F.col("at").alias("bought_at"), F.col("topo").alias("bought"))
    return asof.asof_join(left, right, ["lineage"], "at", "bought_at", ["bought"]).select("topo", F.col("asof_bought").alias("bought"))


def entity_roots(spark: SparkSession, d: str) -> DataFrame:
    e = tables.event_changes(spark, d)
    links = e.select(F.col("topo").alias("node"), F.lag("topo").over(W.partitionBy("lineage", "name").orderBy("topo")).alias("prev"), "lineage", "name")
    roots = graph.chain_roots(links.select("node", "prev"))
    born = roots.join(links.select("node", "lineage", "name"), "node")
    key = hashing.stable_key(F.col("root").cast("string"), F.col("lineage").cast("string"), F.col("name"))
    return born.select("node", "root", key.alias("stable_key"))


QUERIES = {
    "change_level_histogram": change_level_histogram, "hotspots_users": hotspots_users, "latest_record_per_entity": latest_record_per_entity, "occurrence_numbering": occurrence_numbering, "reach_per_commit": reach_per_commit, "strongest_scope": strongest_scope, "content_dedup_dim": content_dedup_dim,
    "minhash_estimate": minhash_estimate, "hunk_geometry": hunk_geometry, "hunk_evidence_tristate": hunk_evidence_tristate, "path_state_fold": path_state_fold, "first_parent_chain": first_parent_chain, "ancestors_closure": ancestors_closure, "locf_state": locf_state, "asof_previous_occupant": asof_previous_occupant, "entity_roots": entity_roots,
}

_REACH_SQL = "r AS (SELECT l_orderkey AS commit, count(DISTINCT l_partkey) AS entities FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)"
_TURNS_SQL = """t AS (SELECT conv_id, turn, role, text AS raw, trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS token FROM conversations),
l AS (SELECT *, lower(token) AS alpha, regexp_replace(lower(token), '[a-z]+', 'w', 'g') AS shape FROM t),
p AS (SELECT *, row_number() OVER w AS rn, lag(raw) OVER w AS p_raw, lag(token) OVER w AS p_token, lag(alpha) OVER w AS p_alpha, lag(shape) OVER w AS p_shape FROM l WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn, raw))"""

ORACLE_SQL = {
    "change_level_histogram": f"WITH {_TURNS_SQL} SELECT role, CASE WHEN rn = 1 THEN 'birth' WHEN raw = p_raw THEN 'none' WHEN token = p_token THEN 'raw' WHEN alpha = p_alpha THEN 'token' WHEN shape = p_shape THEN 'alpha' ELSE 'shape' END AS change_level, count(*) AS changes FROM p GROUP BY ALL",
    "hotspots_users": f"""WITH {_CHANGES_SQL}, a AS (SELECT lineage, count(*) FILTER (change_level = 'shape') AS structural, count(*) AS changes, round((epoch_us(max(at_ts)) - epoch_us(min(at_ts))) / 86400000000.0, 6) AS authored_days, arg_max(name, topo) AS last_name FROM c WHERE change_level <> 'none' GROUP BY 1)
        SELECT lineage, structural, changes, authored_days, last_name, round(structural / (authored_days / 365), 4) AS annual_rate FROM a WHERE structural >= 2 ORDER BY structural DESC, changes DESC, lineage LIMIT 20""",
    "latest_record_per_entity": f"WITH {_CHANGES_SQL} SELECT entity, max(topo) AS topo, arg_max(name, topo) AS name, arg_max(change_level, topo) AS change_level FROM c GROUP BY entity",
    "occurrence_numbering": "SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS occurrence FROM documents",
    "reach_per_commit": f"WITH {_REACH_SQL} SELECT commit, entities, CASE WHEN entities <= 1 THEN 'entity' ELSE 'batch' END AS scope FROM r",
    "strongest_scope": f"WITH {_REACH_SQL} SELECT l_suppkey AS subject, min(CASE WHEN coalesce(entities, 1) <= 1 THEN 0 ELSE 1 END)::BIGINT AS strongest, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_partkey END) AS structural_entities, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS idle_entities, count(DISTINCT l_orderkey) AS commits FROM lineitem LEFT JOIN r ON r.commit = l_orderkey GROUP BY 1",
    "content_dedup_dim": "SELECT sha256(sha256(text) || chr(31) || coalesce(lang, '') || chr(31) || coalesce(n_chars::VARCHAR, '')) AS content_key, count(*) AS revisions, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "minhash_estimate": MINHASH_SQL,
    "hunk_geometry": f"WITH {_RANGES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, t::BIGINT AS touched, CASE WHEN NOT t THEN s - shift END AS old_start, CASE WHEN NOT t THEN e - shift END AS old_end, a::BIGINT AS pure_add FROM g",
    "hunk_evidence_tristate": f"WITH {_RANGES_SQL} SELECT l_partkey, l_orderkey, max(CASE WHEN l_orderkey % 4 = 0 THEN 0 WHEN t THEN 2 ELSE 1 END)::BIGINT AS evidence FROM g GROUP BY 1, 2",
    "path_state_fold": f"WITH {_CHANGES_SQL}, l AS (SELECT lineage AS repo, k AS path, name AS value, change_level, row_number() OVER (PARTITION BY lineage, k ORDER BY topo DESC) AS rn FROM c) SELECT repo, path, value FROM l WHERE rn = 1 AND change_level <> 'death'",
    "first_parent_chain": "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS depth FROM orders",
    "ancestors_closure": "WITH r AS (SELECT o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ancestors, min(o_orderkey) OVER (PARTITION BY o_custkey) AS oldest FROM orders) SELECT * FROM r WHERE ancestors > 0",
    "locf_state": f"WITH {_CHANGES_SQL} SELECT topo, last_value(CASE WHEN name = 'purchase' THEN topo END IGNORE NULLS) OVER (PARTITION BY lineage ORDER BY topo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM c",
    "asof_previous_occupant": f"WITH {_CHANGES_SQL}, p AS (SELECT lineage, at_ts, max(topo) AS bought FROM c WHERE name = 'purchase' GROUP BY 1, 2) SELECT c.topo, p.bought FROM c ASOF LEFT JOIN p ON p.lineage = c.lineage AND c.at_ts > p.at_ts",
    "entity_roots": f"WITH {_CHANGES_SQL}, r AS (SELECT topo AS node, min(topo) OVER (PARTITION BY lineage, name) AS root, lineage, name FROM c) SELECT node, root, sha256(root::VARCHAR || chr(0) || lineage::VARCHAR || chr(0) || name || chr(0)) AS stable_key FROM r",
}
