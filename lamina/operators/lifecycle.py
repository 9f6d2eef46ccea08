"""Births, deaths, items that were tried and removed, and breaks of continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.functions.text import REVERT, days_between

REPLACED_AT_MOST = 0.25


def spans(revisions: DataFrame, deaths: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: birth, last_revision and death topo. A key is dead only if its last death comes after its last revision."""
    seen = revisions.groupBy(*keys).agg(F.min("topo").alias("birth"), F.max("topo").alias("last_revision"), F.count("*").alias("revisions"))
    gone = deaths.groupBy(*keys).agg(F.max("topo").alias("last_death"))
    both = seen.join(gone, keys, "left")
    return both.select(*keys, "birth", "last_revision", "revisions", F.when(F.col("last_death") > F.coalesce("last_revision", F.lit(-1)), F.col("last_death")).alias("death"))


def move_guard(carriers: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """Candidates (*by, entity, death, hash) with guarded: whether another entity that ever had the hash outlives this one.

    carriers: *by, hash, entity, death (null while alive). Two ends per hash tell it: the greatest, and the greatest of another entity."""
    alive = F.lit(1 << 62)
    ends = carriers.groupBy(*by, "hash", "entity").agg(F.max(F.coalesce("death", alive)).alias("end"))
    first = ends.groupBy(*by, "hash").agg(F.max(F.struct("end", "entity")).alias("top"))
    second = ends.join(first, [*by, "hash"]).where("entity <> top.entity").groupBy(*by, "hash").agg(F.max("end").alias("second_end"))
    best = first.select(*by, "hash", F.col("top.end").alias("top_end"), F.col("top.entity").alias("top_entity")).join(second, [*by, "hash"], "left")
    other = F.when(F.col("top_entity") == F.col("entity"), F.col("second_end")).otherwise(F.col("top_end"))
    joined = candidates.join(best, [*by, "hash"], "left")
    return joined.withColumn("guarded", F.coalesce(other > F.col("death"), F.lit(False))).select(*candidates.columns, "guarded")


def grade(message: Column, first_raw: Column, last_raw: Column, revisions: Column) -> tuple[Column, Column]:
    """Strength and method of a removal."""
    revert, inverse = message.rlike(REVERT), first_raw == last_raw
    strength = F.when(revert | inverse, "A").otherwise("C")
    method = F.when(revert, "git_revert").when(inverse, "inverse_diff").when(revisions <= 1, "short_lifecycle").otherwise("trajectory")
    return strength, method


def excursions(lives: DataFrame) -> DataFrame:
    """lives: entity, birth, death (topo), born_at, died_at, message (of the removal), first_raw, last_raw, revisions, guarded. Entities
    that were seen to be born and to die, in different commits, and live on nowhere else."""
    strength, method = grade(F.col("message"), F.col("first_raw"), F.col("last_raw"), F.col("revisions"))
    seen = lives.where("birth is not null and death is not null and birth <> death and not guarded")
    return seen.select("entity", "birth", "death", strength.alias("strength"), method.alias("method"), days_between(F.col("born_at"), F.col("died_at")).alias("duration_days"))


def replaced(pairs: DataFrame, similarity: str = "similarity", at_most: float = REPLACED_AT_MOST) -> DataFrame:
    """Pairs of occupants of one slot that are not the same thing: similarity known and at most the threshold."""
    return pairs.where(F.col(similarity).isNotNull() & (F.col(similarity) <= at_most))


def first_last(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(f"first_{value}"), F.max_by(value, order).alias(f"last_{value}"), F.count("*").alias("revisions"))


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
