"""Golden cases planted in the driver's tables, and what the evaluators make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamina.schemas import TIERS
from lamina.sources import golden, tables



def _nth(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


def _cases(df: DataFrame, kind: str, **columns) -> DataFrame:
    """Case rows of one kind; what isn't given is null."""
    given = {"fixture": F.lit("planted"), "kind": F.lit(kind), "difficulty": F.lit("hard"), "polarity": F.lit("positive"), **columns}
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(golden.CASES)])


def golden_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Of every fifth customer the first four orders as a chain of anchors. Every 31st order is no revision, every fifth isn't matched with the one before."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = tables.read(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.row_number().over(w).alias("n"))
    anchor = lambda c: F.struct(F.col(c).cast("string").alias("sha"), F.lit("p").alias("path"), F.lit("s").alias("symbol"), F.lit(0).alias("occurrence"))
    ambiguous = F.col("o_custkey") % 3 == 0
    step = F.struct(F.when(ambiguous, F.col("n")).otherwise(0).alias("alternative"), F.col("n").alias("step"), anchor("before").alias("prev"), anchor("o_orderkey").alias("next"), _nth(TIERS, F.col("o_custkey") % 7).alias("tier"))
    chains = o.where("o_custkey % 5 = 0 and n between 2 and 4").groupBy("o_custkey").agg(F.collect_list(step).alias("steps"))
    cases = _cases(chains, "lineage", id=F.col("o_custkey"), steps=F.col("steps"), confidence=F.when(ambiguous, "ambiguous"), expect=F.when(F.col("o_custkey") % 4 == 1, "absent"))
    revisions = o.where("o_orderkey % 31 <> 0").select(F.col("o_orderkey").cast("string").alias("sha"), F.lit("p").alias("path"), F.lit("s").alias("symbol"), F.lit(0).alias("occurrence"), F.col("o_orderkey").alias("node"))
    matches = o.where("before is not null and o_orderkey % 5 <> 0").select(F.col("before").alias("prev_node"), F.col("o_orderkey").alias("next_node"), _nth(TIERS, F.col("o_orderkey") % 7).alias("tier"), (F.col("o_orderkey") % 3 + 1).alias("ambiguity_size"))
    return golden.evaluate_lineages(cases, revisions, matches).select("id", "status")


def golden_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Parts as documents with their items as quotes. A case wants none to three quotes; every fifth part was never read, every eighth has no quotes."""
    p = tables.read(spark, d, "part").select("p_partkey")
    month = F.concat(F.lit("-0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("-"))
    wanted = F.slice(F.array(*[F.struct(month.alias("contains"), F.lit(t).alias("tier")) for t in "ANR"]), F.lit(1), (F.col("p_partkey") % 4).cast("int"))
    cases = _cases(p.where("p_partkey % 3 = 0"), "evidence", id=F.col("p_partkey"), doc_type=F.lit("issue"), doc_id=F.col("p_partkey"), spans=wanted)
    key = lambda c: (F.lit("issue").alias("doc_type"), F.col(c).cast("string").alias("external_id"))
    quotes = tables.read(spark, d, "lineitem").where("l_partkey % 8 <> 0").select(*key("l_partkey"), F.col("l_returnflag").alias("tier"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("quoted_text"))
    return golden.evaluate_evidence(cases, p.where("p_partkey % 5 <> 0").select(*key("p_partkey")), quotes).select("id", "status")


def golden_discontinuity(spark: SparkSession, d: str) -> DataFrame:
    """Items of every tenth order as places; those that came back were taken again, and every second place is expected to."""
    i = tables.read(spark, d, "lineitem")
    at = {"sha": F.col("l_orderkey").cast("string"), "path": F.col("l_linenumber").cast("string"), "symbol": F.lit("s")}
    place = F.concat_ws(":", "l_orderkey", "l_linenumber")
    cases = _cases(i.where("l_orderkey % 10 = 0"), "discontinuity", id=place, at_commit=at["sha"], path=at["path"], symbol=at["symbol"], expect=F.when((F.col("l_linenumber") + F.col("l_partkey")) % 2 == 0, "present").otherwise("absent"))
    found = i.where("l_returnflag = 'R'").select(*[c.alias(k) for k, c in at.items()])
    return golden.evaluate_discontinuities(cases, found).select("id", "status")


def golden_excursions(spark: SparkSession, d: str) -> DataFrame:
    """Items as excursions from their order to their date; a third should be absent, the others at least as strong as their status says."""
    i = tables.read(spark, d, "lineitem")
    at = {"introduce_at": F.col("l_orderkey").cast("string"), "remove_at": F.date_format("l_shipdate", "yyyy-MM-dd"), "path": F.col("l_linenumber").cast("string"), "symbol": F.lit("s")}
    graded = _nth(golden.STRENGTHS, F.col("l_partkey") % 3)
    expect = F.when(F.col("l_suppkey") % 3 == 0, "absent")
    least = F.when(F.col("l_suppkey") % 3 == 1, F.when(F.col("l_linestatus") == "O", "A").otherwise("B"))
    cases = _cases(i.where("l_orderkey % 10 = 0"), "excursion", id=F.concat_ws(":", "l_orderkey", "l_linenumber"), expect=expect, strength=least, **at)
    found = i.where("l_returnflag <> 'N'").select(*[c.alias(k) for k, c in at.items()], graded.alias("strength"))
    return golden.evaluate_excursions(cases, found).select("id", "status")


QUERIES = {"golden_lineage": golden_lineage, "golden_evidence": golden_evidence, "golden_discontinuity": golden_discontinuity, "golden_excursions": golden_excursions}

ORACLE_SQL = {
    "golden_lineage": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, lag(o_orderkey) OVER w AS b, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
        s AS (SELECT c, n, c % 3 = 0 AS amb, k % 31 <> 0 AND b % 31 <> 0 AS known, CASE WHEN c % 4 = 1 THEN k % 5 = 0 ELSE k % 5 <> 0 AND k % 7 <= c % 7 END AS met, CASE WHEN k % 5 <> 0 THEN k % 3 + 1 END AS size FROM o WHERE c % 5 = 0 AND n BETWEEN 2 AND 4),
        a AS (SELECT c, amb, CASE WHEN amb THEN n ELSE 0 END AS alt, bool_and(known) AS known, bool_and(known AND met) AS met, arg_max(CASE WHEN known THEN coalesce(size, -1) ELSE -1 END, n) AS size FROM s GROUP BY 1, 2, 3),
        f AS (SELECT c, amb, bool_or(known) AS known, count(*) FILTER (met) AS met, max(CASE WHEN met AND size > 0 THEN size END) AS size FROM a GROUP BY 1, 2)
        SELECT c::VARCHAR AS id, CASE WHEN amb AND size IS NULL OR NOT amb AND NOT known THEN 'missing' WHEN met = 1 AND (NOT amb OR size > 1) THEN 'pass' ELSE 'fail' END AS status FROM f""",
    "golden_evidence": """WITH q AS (SELECT l_partkey AS p, l_returnflag AS tier, strftime(l_shipdate, '%Y-%m-%d') AS q FROM lineitem WHERE l_partkey % 8 <> 0),
        c AS (SELECT p_partkey AS p, count(q.p) AS quotes, coalesce(bool_or(tier = 'A' AND contains(q, '-0' || (p_partkey % 9 + 1) || '-')), false) AS a, coalesce(bool_or(tier = 'N' AND contains(q, '-0' || (p_partkey % 9 + 1) || '-')), false) AS n, coalesce(bool_or(tier = 'R' AND contains(q, '-0' || (p_partkey % 9 + 1) || '-')), false) AS r
              FROM part LEFT JOIN q ON q.p = p_partkey WHERE p_partkey % 3 = 0 GROUP BY 1)
        SELECT p::VARCHAR AS id, CASE WHEN p % 5 = 0 THEN 'missing' WHEN CASE p % 4 WHEN 0 THEN quotes = 0 WHEN 1 THEN a WHEN 2 THEN a AND n ELSE a AND n AND r END THEN 'pass' ELSE 'fail' END AS status FROM c""",
    "golden_discontinuity": "WITH f AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R') SELECT l_orderkey || ':' || l_linenumber AS id, CASE WHEN ((l_linenumber + l_partkey) % 2 = 0) = (k IS NOT NULL) THEN 'pass' ELSE 'fail' END AS status FROM lineitem LEFT JOIN f ON k = l_orderkey AND n = l_linenumber WHERE l_orderkey % 10 = 0",
    "golden_excursions": """WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_shipdate AS s, min(l_partkey % 3) AS g FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3)
        SELECT l_orderkey || ':' || l_linenumber AS id, CASE WHEN CASE l_suppkey % 3 WHEN 0 THEN g IS NULL WHEN 1 THEN coalesce(g <= CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, false) ELSE g IS NOT NULL END THEN 'pass' ELSE 'fail' END AS status
        FROM lineitem LEFT JOIN f ON k = l_orderkey AND n = l_linenumber AND s = l_shipdate WHERE l_orderkey % 10 = 0""",
}
