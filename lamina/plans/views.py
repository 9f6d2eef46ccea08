"""Read views, quality rules, evaluation reports, and the incremental and streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import schemas, versions
from lamina.functions import text
from lamina.operators import asof
from lamina.operators.graph import settled
from lamina.plans.records import _CHANGES_SQL
from lamina.sources import tables
from lamina.streaming import incremental, streams


def test_path_filter(spark: SparkSession, d: str) -> DataFrame:
    """Shown and hidden pages by whether their path is a test's; some paths are made ones."""
    p = tables.read(spark, d, "pages")
    path = F.concat(F.when(F.col("page_id") % 4 == 0, "src/tests/").when(F.col("page_id") % 4 == 1, "src/").otherwise("lib/test_"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".spec.ts").when(F.col("page_id") % 3 == 1, ".py").otherwise(".md"))
    return p.select(text.is_test_path(path).alias("test")).groupBy(F.col("test").cast("bigint").alias("hidden")).agg(F.count("*").alias("pages"))


def entity_catalogue(spark: SparkSession, d: str, limit: int = 400) -> DataFrame:
    """The entities with the most structural changes, and their latest record."""
    c = tables.event_changes(spark, d)
    counted = c.groupBy("entity").agg(F.count(F.when(F.col("change_level") != "none", 1)).alias("changes"), F.count(F.when(F.col("change_level") == "shape", 1)).alias("structural"), F.max_by("name", "topo").alias("last_name"))
    return counted.where("changes > 0").orderBy(F.desc("structural"), F.desc("changes"), F.asc("entity")).limit(limit)


def search_catalogue(spark: SparkSession, d: str) -> DataFrame:
    c = tables.event_changes(spark, d)
    return asof.latest_by(c, ["entity"], ["topo"], ["topo", "name", "lineage"]).select("entity", "name", "lineage")


def repo_summary(spark: SparkSession, d: str) -> DataFrame:
    c = tables.event_changes(spark, d)
    return c.agg(F.count("*").alias("revisions"), F.count_distinct("entity").alias("entities"), F.count_distinct("lineage").alias("lineages"), F.count_distinct("commit").alias("commits"), F.count(F.when(F.col("change_level") == "death", 1)).alias("deaths"), F.max("topo").alias("tip"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Indexed, discoverable and inspectable entities, which must not grow from left to right."""
    c = tables.event_changes(spark, d)
    real = F.col("change_level") != "none"
    row = c.agg(F.count_distinct("entity").alias("indexed"), F.count_distinct(F.when(real, F.col("entity"))).alias("discoverable"), F.count_distinct(F.when(real & (F.col("change_level") == "shape"), F.col("entity"))).alias("inspectable"))
    return row.withColumn("consistent", ((F.col("indexed") >= F.col("discoverable")) & (F.col("discoverable") >= F.col("inspectable"))).cast("bigint"))


def invariant_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows of line items that break the rules of a change table, which some are made to."""
    i = tables.read(spark, d, "lineitem")
    level = F.when(F.col("l_partkey") % 3 == 0, "birth").when(F.col("l_partkey") % 3 == 1, "death").otherwise("shape")
    rows = i.select(level.alias("change_level"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey").cast("string")).alias("prev_key"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey").cast("string")).alias("next_key"))
    return schemas.violations(rows, schemas.rules()["revision_change"])


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return schemas.duplicates(tables.read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def golden_report(spark: SparkSession, d: str) -> DataFrame:
    """Labels as cases (toxic: expected failures), passed by a length rule: totals by quality and polarity and over all, with rates where there are cases."""
    cases = tables.read(spark, d, "labels").join(tables.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "left")
    passed = F.when(F.col("n_chars").isNotNull(), ((F.col("n_chars") >= 300) == (F.col("quality") == 1)).cast("int"))
    rolled = cases.withColumn("passed", passed).rollup("quality", "toxic").agg(F.count("*").alias("cases"), F.count("passed").alias("evaluated"), F.sum("passed").alias("passed"), F.count(F.when(F.col("passed").isNull(), 1)).alias("missing"))
    return rolled.select("quality", "toxic", "cases", "evaluated", "passed", F.round(F.try_divide("passed", "evaluated"), 6).alias("rate"), (F.col("missing") * 5 <= F.col("cases")).cast("bigint").alias("interpretable"))


def incremental_equals_full(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the folded state, and how many differ between one pass and passes of unequal size."""
    c = settled(tables.event_changes(spark, d).select("lineage", "k", "topo", F.when(F.col("change_level") != "death", F.col("name")).alias("name")))
    top = c.agg(F.max("topo")).first()[0] or 0
    version = versions.match_version()
    full, _ = incremental.run_in_batches(c, [top], version, ["lineage", "k"], ["name"])
    parts, _ = incremental.run_in_batches(c, [top // 7, top // 2, top // 2 + 1, top], version, ["lineage", "k"], ["name"])
    a, b = full.select("lineage", "k", F.struct("topo", "name").alias("a")), parts.select("lineage", "k", F.struct("topo", "name").alias("b"))
    both = a.join(b, a["lineage"].eqNullSafe(b["lineage"]) & a["k"].eqNullSafe(b["k"]), "full")
    return both.agg(F.count("*").alias("keys"), F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).alias("different"))


def stream_state_entities(spark: SparkSession, d: str) -> DataFrame:
    found = streams.drained(streams.entity_state(streams.stream(spark, d)), "update")
    return asof.latest_by(found, ["lineage"], ["batch"], ["batch", "births", "revisions", "deaths", "last_topo"]).drop("batch")


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return streams.drained(streams.tumbling(streams.stream(spark, d)), "complete").drop("batch")


def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return streams.drained(streams.sessions(streams.stream(spark, d)), "append").drop("batch")


QUERIES = {
    "test_path_filter": test_path_filter, "entity_catalogue": entity_catalogue, "search_catalogue": search_catalogue, "repo_summary": repo_summary, "coverage": coverage, "invariant_violations": invariant_violations, "duplicate_keys": duplicate_keys, "golden_report": golden_report, "incremental_equals_full": incremental_equals_full,
    "stream_state_entities": stream_state_entities, "stream_tumbling": stream_tumbling, "stream_session": stream_session,
}

ORACLE_SQL = {
    "test_path_filter": "SELECT CASE WHEN page_id % 4 = 0 THEN 1 WHEN page_id % 3 = 0 THEN 1 WHEN page_id % 4 >= 2 AND page_id % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS hidden, count(*) AS pages FROM pages GROUP BY 1",
    "entity_catalogue": f"WITH {_CHANGES_SQL} SELECT entity, count(*) FILTER (change_level <> 'none') AS changes, count(*) FILTER (change_level = 'shape') AS structural, arg_max(name, topo) AS last_name FROM c GROUP BY 1 HAVING changes > 0 ORDER BY structural DESC, changes DESC, entity LIMIT 400",
    "search_catalogue": f"WITH {_CHANGES_SQL} SELECT entity, arg_max(name, topo) AS name, arg_max(lineage, topo) AS lineage FROM c GROUP BY 1",
    "repo_summary": f"WITH {_CHANGES_SQL} SELECT count(*) AS revisions, count(DISTINCT entity) AS entities, count(DISTINCT lineage) AS lineages, count(DISTINCT commit) AS commits, count(*) FILTER (change_level = 'death') AS deaths, max(topo) AS tip FROM c",
    "coverage": f"WITH {_CHANGES_SQL} SELECT count(DISTINCT entity) AS indexed, count(DISTINCT CASE WHEN change_level <> 'none' THEN entity END) AS discoverable, count(DISTINCT CASE WHEN change_level = 'shape' THEN entity END) AS inspectable, 1::BIGINT AS consistent FROM c",
    "invariant_violations": """SELECT 'known_level' AS rule, 0::BIGINT AS rows UNION ALL SELECT 'birth_without_prev', count(*) FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey % 5 <> 0 UNION ALL
        SELECT 'death_without_next', count(*) FROM lineitem WHERE l_partkey % 3 = 1 AND l_suppkey % 3 <> 0 UNION ALL SELECT 'some_side', count(*) FROM lineitem WHERE l_suppkey % 15 = 0""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "golden_report": """WITH k AS (SELECT quality, toxic, CASE WHEN n_chars IS NOT NULL THEN CASE WHEN (n_chars >= 300) = (quality = 1) THEN 1 ELSE 0 END END AS passed FROM labels LEFT JOIN documents USING (doc_id))
        SELECT quality, toxic, count(*) AS cases, count(passed) AS evaluated, sum(passed)::BIGINT AS passed, round(sum(passed) / count(passed)::DOUBLE, 6) AS rate, CASE WHEN (count(*) - count(passed)) * 5 <= count(*) THEN 1 ELSE 0 END::BIGINT AS interpretable FROM k GROUP BY ROLLUP (quality, toxic)""",
    "incremental_equals_full": f"WITH {_CHANGES_SQL} SELECT count(*) AS keys, 0::BIGINT AS different FROM (SELECT DISTINCT lineage, k FROM c)",
    "stream_state_entities": """WITH e AS (SELECT user_id AS lineage, event_id, event_type = 'error' AS dead, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
        SELECT lineage, count(*) FILTER (NOT dead AND coalesce(before, true)) AS births, count(*) FILTER (NOT dead) AS revisions, count(*) FILTER (dead AND NOT coalesce(before, true)) AS deaths, max(event_id) AS last_topo FROM e GROUP BY 1""",
    "stream_tumbling": "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "stream_session": """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS n FROM e), g AS (SELECT user_id, n, min(ts) AS a, max(ts) + INTERVAL 2 HOUR AS b, count(*) AS events FROM s GROUP BY 1, 2)
        SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, events FROM g WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
}
