"""State along an order: last value before a row, as-of joins, occurrence numbers and folded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.operators.graph import settled


def previous_value(value: Column, partition: list[str], order: list[Column | str]) -> Column:
    """The last non-null value strictly before a row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str, payload: list[str], strict: bool = True) -> DataFrame:
    """left with the payload of the latest right row of the same key whose order is below (or, unless strict, at) left's. One
    shuffle of both sides on the key: the rows are put in one order, and the last right row is carried forward. Of right rows
    with the same order, the one with the greatest payload counts."""
    kept = F.struct(*[F.col(c) for c in payload])
    best = right.groupBy(*keys, F.col(right_order).alias("_at")).agg(F.max(kept).alias("_payload"))
    width = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(*keys, F.col(left_order).alias("_at"), F.lit(0 if strict else 1).alias("_side"), width.alias("_row"), F.lit(None).cast(best.schema["_payload"].dataType).alias("_payload"))
    b = best.select(*keys, "_at", F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "_payload")
    both = a.unionByName(b)
    carried = both.withColumn("_found", F.last("_payload", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return carried.where("_row is not null").select("_row.*", *[F.col(f"_found.{c}").alias(f"asof_{c}") for c in payload])


def latest_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row for each key: the columns of its last row in order. A partial aggregate, so hot keys shrink before the shuffle."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns if c not in order])).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}" if c in order else f"_best._{c}").alias(c) for c in columns])


def folded_state(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Current value of each key after all sets and deletes; a null value is a delete and leaves no row."""
    return latest_by(events, keys, order, [value]).where(F.col(value).isNotNull())


def occurrences(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """df with the number of each row among those of its key, in order, from 0. Rows are dealt by ranges of key and order, so a hot key lies in many
    parts; a part's rows are numbered within it, and what the parts before it hold of the key is added."""
    placed = settled(df.repartitionByRange(*partition, *order).withColumn("_part", F.spark_partition_id()))
    held = placed.groupBy("_part", *partition).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*partition).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_{c}") for c in partition], before.alias("_before"))
    same = F.col("_part") == F.col("_of")
    for c in partition:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = F.row_number().over(W.partitionBy("_part", *partition).orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(offsets, same).withColumn("occurrence", (F.col("_own") + F.col("_before")).cast("bigint")).select(*df.columns, "occurrence")
