"""What both vector searches share: valid vectors, one representative for equal vectors, and the way back to rows.

Equal vectors have equal scores, so a search runs over different vectors only. Each keeps its TOP + 1 least ids: with more, no copy
could be among the first TOP of any query, its own row left out.

Rows with a null vec_id take no part. Rows that share a vec_id but not a vector are queries and candidates each, under that id; a row is never
its own query's candidate, nor is another row of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP = 10
QUERY_EVERY = 100


def valid(rows: DataFrame, vector: str = "embedding", zero: bool = False) -> DataFrame:
    """Rows with an id and a vector without null or non-finite components; with a nonzero component unless zero is allowed."""
    x = F.col(vector)
    wide = F.transform(x, lambda v: v.cast("double"))
    finite = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False))
    return rows.where(kept if zero else kept & F.exists(wide, lambda v: v != 0.0))


def keyed(rows: DataFrame, vector: str) -> DataFrame:
    """vec_id, v, and a digest of v (k1, k2) that stands for it."""
    return rows.select("vec_id", F.col(vector).alias("v"), F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit(1), vector).alias("k2"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """vec (least id), k1, k2, v, ids (the TOP + 1 least) and asked (whether a query has this vector), from keyed()."""
    asked = (F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0).cast("int")
    # row_number over ids that are first made distinct; the limit on it is applied before the shuffle too
    ranked = rows.select("k1", "k2", "vec_id", F.row_number().over(W.partitionBy("k1", "k2").orderBy("vec_id")).alias("rank")).where(F.col("rank") <= TOP + 1)
    ids = ranked.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # vec tells vectors apart: of several whose least id is the same, all but one get a number of their own
    again = F.row_number().over(W.partitionBy(F.col("ids")[0]).orderBy("k1", "k2")) > 1
    named = ids.withColumn("vec", F.when(again, -1 - F.pmod("k1", F.lit(1 << 62))).otherwise(F.col("ids")[0]))
    any_asked = rows.groupBy("k1", "k2").agg(F.max(asked).alias("asked"), F.first("v").alias("v"))
    return any_asked.join(named, ["k1", "k2"]).select("vec", "k1", "k2", "v", "ids", "asked")


def best_ids(hits: DataFrame, vectors: DataFrame, descending: bool) -> DataFrame:
    """q, found: each query vector's TOP + 1 best (score, id), best first, from hits (q, vec, score), of which there are at most a few
    dozen for each q. Ties go to the smaller id."""
    rows = hits.join(vectors.select("vec", "ids"), "vec").select("q", "score", F.explode("ids").alias("id"))
    order = [F.desc("score") if descending else F.asc("score"), F.asc("id")]
    top = rows.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= TOP + 1)
    return top.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("found"))


def answers(rows: DataFrame, vectors: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for every row (keyed()) whose id is divisible by QUERY_EVERY, without the row itself."""
    per_key = vectors.where("asked = 1").select(F.col("vec").alias("q"), "k1", "k2").join(found, "q").select("k1", "k2", "found")
    from lamina.llm.common import staged

    asked = rows.where(F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0).select(F.col("vec_id").alias("query_id"), "k1", "k2")
    joined = asked.join(staged(per_key), ["k1", "k2"])
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, TOP)
    return joined.select("query_id", F.posexplode(others)).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), F.col("col.score").alias("score"))


def dimensions(vectors: DataFrame) -> list[int]:
    return sorted(r["d"] for r in vectors.select(F.size("v").alias("d")).distinct().collect())


def limited(hits: DataFrame, key: str, order: list[Column], count: int) -> DataFrame:
    return hits.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= count).drop("_rank")
