"""Tables by name, and the versioned-record views of them that the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The change level that each kind of event stands for.
EVENT_LEVELS = {"click": "none", "view": "raw", "signup": "alpha", "purchase": "shape", "error": "death"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_level(kind: Column) -> Column:
    out = None
    for name, level in EVENT_LEVELS.items():
        out = F.when(kind == name, level) if out is None else out.when(kind == name, level)
    return out.otherwise("token")


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes: commit and topo event_id, lineage user_id, name event_type, entity user_id with the key of its props."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_id").alias("commit"), F.col("event_id").alias("topo"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("lineage"), F.col("event_type").alias("name"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.coalesce(k, F.lit(-1)).cast("string")).alias("entity"), k.alias("k"), event_level(F.col("event_type")).alias("change_level"), "value",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as revisions, with the text of the same role's turn before, layer by layer."""
    from lamina.operators.asof import previous_value

    c = read(spark, sf_dir, "conversations")
    token = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    layered = c.select("conv_id", "turn", "role", F.col("text").alias("raw"), token.alias("token"), F.lower(token).alias("alpha"), F.regexp_replace(F.lower(token), "[a-z]+", "w").alias("shape"))
    before = previous_value(F.struct("turn", "raw", "token", "alpha", "shape"), ["conv_id", "role"], [F.col("turn"), F.col("raw")])
    return layered.withColumn("prev", before)
