"""Closures and roots over edges, in rounds whose number grows with the logarithm of a chain's length."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df computed and cut off from its lineage: a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lamina-"))
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that nothing refers to any more: it does so when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def chain_roots(links: DataFrame) -> DataFrame:
    """links (node, prev; null prev at a root) -> node, root, depth, by pointer doubling. A prev that is no node is a root itself."""
    base = links.select("node", F.coalesce("prev", "node").alias("root"), F.col("prev").isNotNull().cast("bigint").alias("depth"))
    state = settled(base)
    while True:
        up = state.select(F.col("node").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more")).where("above <> root")
        stepped = settled(state.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")))
        state = stepped.drop("moved")
        if not stepped.where("moved").take(1):
            return state


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) between two sides -> b, label: the least a of its component. Labels move along edges and then along labels, so the number of
    rounds grows with the logarithm of a component's diameter."""
    labels = settled(edges.groupBy("b").agg(F.min("a").alias("label")))
    while True:
        up = settled(edges.join(labels, "b").groupBy("a").agg(F.min("label").alias("label")))
        down = edges.join(up, "a").groupBy("b").agg(F.min("label").alias("label"))
        jumped = settled(down.join(up.select(F.col("a").alias("label"), F.col("label").alias("further")), "label").select("b", F.col("further").alias("label")))
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "b").where("label <> old").take(1)
        labels = jumped
        if not changed:
            return labels


def ancestors(edges: DataFrame, include_self: bool = True) -> DataFrame:
    """edges (child, parent) -> node, ancestor: the distinct closure, by squaring."""
    pairs = edges.where("child is not null and parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct()
    if include_self:
        nodes = pairs.select("node").union(pairs.select("ancestor")).distinct()
        pairs = pairs.unionByName(nodes.select("node", F.col("node").alias("ancestor")))
    reach = settled(pairs)
    count = reach.count()
    while True:
        further = reach.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"))
        reach = settled(further.unionByName(reach).distinct())
        more = reach.count()
        if more == count:
            return reach
        count = more


def ancestors_of(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (node) and edges (child, parent) -> node, ancestor: all that each start goes back to, by a frontier that moves on to what is new. Only what the
    starts reach is visited; a chain takes as many rounds as it is long."""
    steps = edges.where("child is not null and parent is not null").select("child", "parent")
    frontier = settled(starts.select("node", F.col("node").alias("ancestor")).distinct())
    reached = [frontier]
    while True:
        seen = reached[0]
        for r in reached[1:]:
            seen = seen.unionByName(r)
        met = frontier.join(steps, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor")).distinct()
        frontier = settled(met.join(seen, ["node", "ancestor"], "left_anti"))
        if not frontier.take(1):
            return seen.where("node <> ancestor")
        reached.append(frontier)


def is_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (ancestor, node) with is_ancestor; a commit is its own ancestor."""
    known = ancestors_of(edges, pairs.select("node")).withColumn("_found", F.lit(True))
    return pairs.join(known, ["node", "ancestor"], "left").withColumn("is_ancestor", F.coalesce("_found", F.lit(False)) | (F.col("node") == F.col("ancestor"))).drop("_found")


def resurrections(events: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """Rows of kind A that come directly after a D of the same key."""
    from pyspark.sql import Window as W

    before = F.lag(kind).over(W.partitionBy(*keys).orderBy(*order))
    return events.withColumn("_before", before).where((F.col(kind) == "A") & (F.col("_before") == "D")).drop("_before")
