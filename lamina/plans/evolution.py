"""Queries over evolution: full timelines, linked claims, ancestors of given commits, namesakes, deletions, miners, orderings and store rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.functions import sketch, text
from lamina.operators import claims, evolution, graph, lifecycle
from lamina.plans import matching as M
from lamina.plans import narrative as N
from lamina.plans.records import _CHANGES_SQL
from lamina.sources import tables


def timeline_full(spark: SparkSession, d: str) -> DataFrame:
    evidence, changes, deaths = N._evidence(spark, d)
    gated = claims.gated(claims.candidates(evidence, changes, deaths))
    derived = gated.where("gate is null and subject = 'change'")
    return evolution.full_timeline(changes, claims.reach(changes), derived, gated.where("gate is not null"), N.reference_extract(spark, d))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Parts as discussions, of which every fifth says why; a message refers to those that it lists."""
    _, changes, deaths = N._evidence(spark, d)
    p = tables.read(spark, d, "part").where("p_partkey % 5 = 0")
    rule = F.when(F.col("p_partkey") % 3 == 0, "causal:because").otherwise("causal:rather than/result")
    evidence = p.select(F.concat(F.lit("issue:"), F.col("p_partkey").cast("string")).alias("doc_key"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("evidence_key"), F.lit(0).alias("char_start"), F.col("p_name").alias("quoted_text"), rule.alias("rule"))
    references = N.reference_extract(spark, d).withColumn("kind", F.lit("issue"))
    return claims.gated(evolution.linked_candidates(references, evidence, changes, deaths))


def linked_claims(spark: SparkSession, d: str) -> DataFrame:
    derived = _linked(spark, d).where("gate is null")
    return derived.groupBy("commit", "subject", "claim_type").agg(F.count("*").alias("claims"), F.count_distinct("evidence_key").alias("quotes"), F.max("confidence").alias("confidence"))


def rationale_summary(spark: SparkSession, d: str) -> DataFrame:
    evidence, changes, deaths = N._evidence(spark, d)
    derived = claims.derive(claims.candidates(evidence, changes, deaths)).where("subject = 'change'")
    return evolution.rationale_summary(derived, claims.reach(changes))


def earliest_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first order of a part, where every seventh has no known date."""
    o = tables.read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("date")).alias("at"), F.col("o_custkey").alias("doc_key"))
    i = tables.read(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("char_start"), F.col("l_orderkey").alias("evidence_key"))
    found = evolution.earliest_evidence(i.join(o, F.col("evidence_key") == F.col("o_orderkey")).drop("o_orderkey"), "part")
    return found.select("part", "evidence_key", "doc_key", F.col("char_start").cast("bigint").alias("char_start"), "additional")


def ancestors_of_commits(spark: SparkSession, d: str) -> DataFrame:
    """Of every fiftieth customer's last order, all orders that it goes back to."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = tables.read(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("p1"), F.lag("o_orderkey", 2).over(w).alias("p2"))
    edges = graph.settled(o.select(F.col("o_orderkey").alias("child"), F.explode(F.array("p1", "p2")).alias("parent")))
    last = o.where("o_custkey % 50 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("node")).select("node")
    return graph.ancestors_of(edges, last)


def namesakes_alive(spark: SparkSession, d: str) -> DataFrame:
    revisions, deaths = M._lives(spark, d)
    spans = lifecycle.spans(revisions, deaths, ["entity"]).withColumn("name", F.split_part("entity", F.lit("/"), F.lit(1)))
    return evolution.namesakes(graph.settled(spans), ["name"]).select("entity", F.array_join("survivors", ",").alias("survivors"), "count")


def last_deletes(spark: SparkSession, d: str) -> DataFrame:
    return evolution.last_delete(tables.event_changes(spark, d).select("lineage", "topo", "change_level"), ["lineage"], "topo").select("topo", "last_delete")


def discontinuity_totals(spark: SparkSession, d: str) -> DataFrame:
    found = M.discontinuity_occupant(spark, d)
    return found.agg(F.count("*").alias("discontinuities"), F.count_if(F.col("similarity").isNull()).alias("unknown"), F.count_distinct("conv_id").alias("conversations"))


def pass_report(spark: SparkSession, d: str) -> DataFrame:
    """What a pass over the event stream did, by lineage modulo 10: births, removals, other changes, and changes that left the key of the one before."""
    c = tables.event_changes(spark, d)
    w = W.partitionBy("lineage").orderBy("topo")
    marked = c.withColumn("before", F.lag("entity").over(w)).withColumn("first", F.row_number().over(W.partitionBy("entity").orderBy("topo")) == 1)
    return marked.groupBy((F.col("lineage") % 10).alias("part")).agg(F.count_if("first").alias("births"), F.count_if(F.col("change_level") == "death").alias("deaths"), F.count_if(~F.col("first") & (F.col("change_level") != "death")).alias("changes"), F.count_if(F.col("before") != F.col("entity")).alias("moves"))


def rename_miner(spark: SparkSession, d: str) -> DataFrame:
    """Renames by similarity score: the surer git is, the easier the case."""
    score = (F.lit(50) + F.col("l_quantity").cast("int")).alias("score")
    rows = tables.read(spark, d, "lineitem").select(score, "l_linestatus")
    difficulty = F.when(F.col("score") >= 95, "low").when(F.col("score") >= 80, "medium").otherwise("hard")
    return rows.groupBy(difficulty.alias("difficulty"), F.col("l_linestatus").alias("mode")).agg(F.count("*").alias("cases"), F.min("score").cast("bigint").alias("least"))


def churn_miner(spark: SparkSession, d: str) -> DataFrame:
    """The twenty parts that most commits touch."""
    i = tables.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count_distinct("l_orderkey").alias("commits"))
    return i.orderBy(F.desc("commits"), "part").limit(20)


def best_explained(spark: SparkSession, d: str) -> DataFrame:
    """The fifty parts with most quotes, then most changes."""
    i = tables.read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("changes"))
    rows = rationale_summary(spark, d).select(F.col("entity").alias("l_partkey"), (F.col("own") + F.col("shared")).alias("quotes"))
    joined = i.join(rows, "l_partkey", "left").select(F.col("l_partkey").alias("part"), "changes", F.coalesce("quotes", F.lit(0)).alias("quotes"))
    return joined.orderBy(F.desc("quotes"), F.desc("changes"), "part").limit(50)


def store_rules(spark: SparkSession, d: str) -> DataFrame:
    """How often the rules of a store are broken: parts in several repositories (suppliers), and steps between repositories (priorities)."""
    i = tables.read(spark, d, "lineitem")
    o = tables.read(spark, d, "orders")
    steps = o.select(F.col("o_orderpriority").alias("here"), F.lag("o_orderpriority").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before")).where("before is not null")
    split = evolution.split_identities(i, "l_partkey", "l_suppkey").agg(F.lit("split_identity").alias("rule"), F.count("*").alias("violations"))
    return split.unionByName(evolution.crossing(steps, "before", "here").agg(F.lit("cross_repository").alias("rule"), F.count("*").alias("violations")))


def signature_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Sets of at most 200 grams are kept as they are, larger ones as sketches."""
    kind = sketch.signature_kind(sketch.gram_texts(M.words()))
    return tables.read(spark, d, "documents").where("text is not null").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), kind.alias("kind")).agg(F.count("*").alias("documents"))


def valid_props(spark: SparkSession, d: str) -> DataFrame:
    """Whether props are valid JSON; those of every eleventh event are cut short."""
    props = F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return tables.read(spark, d, "events").select("event_type", text.json_valid(props).alias("valid")).groupBy("event_type", "valid").agg(F.count("*").alias("events"))


def timeline_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of parts, every second at one commit, and what they read back as."""
    key = F.concat_ws("/", "p_type", "p_name")
    sha = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("c+"), F.col("p_partkey").cast("string")))
    made = tables.read(spark, d, "part").select("p_partkey", text.timeline_address(key, sha).alias("address"))
    return made.withColumn("read", text.parse_address(F.col("address"))).select("p_partkey", "address", "read.key", "read.sha")


QUERIES = {
    "timeline_full": timeline_full, "linked_claims": linked_claims, "rationale_summary": rationale_summary, "earliest_evidence": earliest_evidence, "ancestors_of_commits": ancestors_of_commits, "namesakes_alive": namesakes_alive, "last_deletes": last_deletes, "discontinuity_totals": discontinuity_totals, "pass_report": pass_report,
    "rename_miner": rename_miner, "churn_miner": churn_miner, "best_explained": best_explained, "store_rules": store_rules, "signature_kinds": signature_kinds, "valid_props": valid_props, "timeline_addresses": timeline_addresses,
}

_REACH_SQL = "rh AS (SELECT commit, count(*) AS entities FROM ch GROUP BY 1)"
_SUMMARY_SQL = f"{N._CLAIMS_SQL}, {_REACH_SQL}, su AS (SELECT entity, count(*) FILTER (entities <= 1) AS own, count(*) FILTER (entities > 1) AS shared, min(entities) FILTER (entities > 1) AS least_reach FROM ga JOIN rh USING (commit) WHERE gate IS NULL AND subject = 'change' GROUP BY 1)"

ORACLE_SQL = {
    "timeline_full": f"""{N._CLAIMS_SQL}, {N._REFS_SQL}, {_REACH_SQL}, al AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS entity, CASE WHEN l_returnflag = 'R' THEN 'none' ELSE 'shape' END AS change_level FROM lineitem),
        qu AS (SELECT commit, entity, string_agg(DISTINCT quoted_text, chr(31) ORDER BY quoted_text) AS quotes FROM ga WHERE gate IS NULL AND subject = 'change' GROUP BY 1, 2), si AS (SELECT commit, entity, count(*) AS n FROM ga WHERE gate IS NOT NULL GROUP BY 1, 2),
        li AS (SELECT commit, count(*) AS n, first(to_key ORDER BY confidence DESC, to_key) AS best FROM rr GROUP BY 1)
        SELECT al.commit, al.entity, change_level, coalesce(entities, 0)::BIGINT AS reach, coalesce(li.n, 0)::BIGINT AS n_references, coalesce(si.n, 0)::BIGINT AS suppressed, CASE WHEN coalesce(entities, 0) <= 1 THEN 'entity' ELSE 'batch' END AS scope, CASE WHEN change_level = 'none' THEN '' ELSE coalesce(quotes, '') END AS quotes, li.best AS best_reference
        FROM al LEFT JOIN rh ON rh.commit = al.commit LEFT JOIN qu ON qu.commit = al.commit AND qu.entity = al.entity LEFT JOIN si ON si.commit = al.commit AND si.entity = al.entity LEFT JOIN li ON li.commit = al.commit""",
    "linked_claims": f"""{N._CLAIMS_SQL}, {N._REFS_SQL}, ev AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'why' ELSE 'tradeoff' END AS typ FROM part WHERE p_partkey % 5 = 0), lk AS (SELECT rr.commit, confidence, p_partkey, ev.typ FROM rr JOIN ev ON ev.p_partkey::VARCHAR = rr.to_key),
        al AS (SELECT lk.*, 'change' AS subject, typ AS claim_type FROM lk JOIN ch USING (commit) UNION ALL SELECT lk.*, 'excursion', 'abandoned_reason' FROM lk JOIN de USING (commit) JOIN dn USING (commit) WHERE deaths = 1)
        SELECT commit, subject, claim_type, count(*) AS claims, count(DISTINCT p_partkey) AS quotes, max(confidence) AS confidence FROM al GROUP BY 1, 2, 3""",
    "rationale_summary": f"{_SUMMARY_SQL} SELECT entity, own, shared, least_reach FROM su",
    "earliest_evidence": """WITH e AS (SELECT l_partkey AS part, l_orderkey AS evidence_key, o_custkey AS doc_key, l_linenumber::BIGINT AS char_start, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
        r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY day ASC NULLS LAST, doc_key, char_start, evidence_key) AS rn FROM e), c AS (SELECT part, count(DISTINCT doc_key) - 1 AS additional FROM e GROUP BY 1) SELECT part, evidence_key, doc_key, char_start, additional FROM r JOIN c USING (part) WHERE rn = 1""",
    "ancestors_of_commits": "SELECT b.o_orderkey AS node, a.o_orderkey AS ancestor FROM orders a JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey % 50 = 0 GROUP BY 1) b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey",
    "namesakes_alive": M._LIFE_SQL + """, nm AS (SELECT entity, death, split_part(entity, '/', 1) AS name FROM sp), al AS (SELECT d.entity, a.entity AS other FROM nm d LEFT JOIN nm a ON a.name = d.name AND a.entity <> d.entity AND a.death IS NULL WHERE d.death IS NOT NULL)
        SELECT entity, coalesce(string_agg(other, ',' ORDER BY other), '') AS survivors, count(other) AS count FROM al GROUP BY 1""",
    "last_deletes": f"WITH {_CHANGES_SQL} SELECT topo, max(CASE WHEN change_level = 'death' THEN topo END) OVER (PARTITION BY lineage ORDER BY topo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_delete FROM c",
    "discontinuity_totals": f"SELECT count(*) AS discontinuities, count(*) FILTER (similarity IS NULL) AS unknown, count(DISTINCT conv_id) AS conversations FROM ({M.ORACLE_SQL['discontinuity_occupant']})",
    "pass_report": f"""WITH {_CHANGES_SQL}, k AS (SELECT *, lag(entity) OVER (PARTITION BY lineage ORDER BY topo) AS before, row_number() OVER (PARTITION BY entity ORDER BY topo) = 1 AS first FROM c)
        SELECT lineage % 10 AS part, count(*) FILTER (first) AS births, count(*) FILTER (change_level = 'death') AS deaths, count(*) FILTER (NOT first AND change_level <> 'death') AS changes, count(*) FILTER (before <> entity) AS moves FROM k GROUP BY 1""",
    "rename_miner": "WITH s AS (SELECT 50 + l_quantity::INTEGER AS score, l_linestatus AS mode FROM lineitem) SELECT CASE WHEN score >= 95 THEN 'low' WHEN score >= 80 THEN 'medium' ELSE 'hard' END AS difficulty, mode, count(*) AS cases, min(score)::BIGINT AS least FROM s GROUP BY 1, 2",
    "churn_miner": "SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "best_explained": f"{_SUMMARY_SQL}, it AS (SELECT l_partkey AS part, count(*) AS changes FROM lineitem GROUP BY 1) SELECT part, changes, coalesce(own + shared, 0)::BIGINT AS quotes FROM it LEFT JOIN su ON su.entity = part ORDER BY quotes DESC, changes DESC, part LIMIT 50",
    "store_rules": """WITH o AS (SELECT o_orderpriority AS here, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
        SELECT 'split_identity' AS rule, count(*) AS violations FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1) UNION ALL SELECT 'cross_repository', count(*) FROM o WHERE before IS NOT NULL AND before <> here""",
    "signature_kinds": f"WITH w AS (SELECT coalesce(lang, '') AS lang, {M._WS} AS ws FROM documents WHERE text IS NOT NULL), g AS (SELECT lang, len({M._grams_sql('ws')}) AS n FROM w) SELECT lang, CASE WHEN n <= 200 THEN 'exact' ELSE 'sketch' END AS kind, count(*) AS documents FROM g GROUP BY 1, 2",
    "timeline_addresses": "SELECT p_partkey, '#' || url_encode(p_type || '/' || p_name) || CASE WHEN p_partkey % 2 = 0 THEN '/' || url_encode('c+' || p_partkey) ELSE '' END AS address, p_type || '/' || p_name AS key, CASE WHEN p_partkey % 2 = 0 THEN 'c+' || p_partkey ELSE '' END AS sha FROM part",
    "valid_props": "SELECT event_type, json_valid(CASE WHEN event_id % 11 = 0 THEN substr(props, 1, 3) ELSE props END) AS valid, count(*) AS events FROM events GROUP BY 1, 2",
}
