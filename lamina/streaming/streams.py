"""Structured Streaming over events: keyed state, and windows with a watermark (these go beyond the batch views)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = "births bigint, revisions bigint, deaths bigint, last_topo bigint"
OUTPUT = f"lineage bigint, {STATE}"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as a stream; a file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/events.parquet"
    plain = not spark.read.format("binaryFile").load(path).where(F.col("path").endswith("/events.parquet")).isEmpty()
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet" if plain else path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or 'file://' + tempfile.mkdtemp(prefix='lamina-')}/stream-{uuid.uuid4().hex}"


def drained(rows: DataFrame, mode: str, schema: str | None = None) -> DataFrame:
    """All that a stream gives for the files there are, as a table in the shared folder. In complete and update mode a later batch
    replaces or follows an earlier one, under its number, so a repeated batch writes the same folder again."""
    spark = rows.sparkSession
    at = _folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}" if mode != "complete" else f"{at}/out/batch=0")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(lambda b, n: write(b, n)).start()
    query.awaitTermination()
    found = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", f"{at}/out").parquet(f"{at}/out")
    return found


def _entities(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    births, revisions, deaths, last = state.get if state.exists else (0, 0, 0, -1)
    rows = pd.concat(batches).sort_values("event_id")
    alive = births > deaths
    for event_id, dead in zip(rows["event_id"], rows["event_type"] == "error", strict=True):
        if dead:
            deaths += alive
            alive = False
        else:
            births += not alive
            alive = True
            revisions += 1
        last = max(last, event_id)
    state.update((int(births), int(revisions), int(deaths), int(last)))
    yield pd.DataFrame([(key[0], births, revisions, deaths, last)], columns=["lineage", "births", "revisions", "deaths", "last_topo"])


def entity_state(rows: DataFrame) -> DataFrame:
    """Per user, what has been born and removed so far; an item that is removed and comes again is born again."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    keyed = rows.select(F.col("user_id").alias("lineage"), "event_id", "event_type").groupBy("lineage")
    return keyed.applyInPandasWithState(_entities, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def tumbling(rows: DataFrame, width: str = "1 day") -> DataFrame:
    counted = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"))
    return counted.select(F.unix_micros("w.start").alias("start_us"), "event_type", "events")


def sessions(rows: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Closed sessions of each user: those that end before the watermark."""
    counted = rows.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return counted.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events")
