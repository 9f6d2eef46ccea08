"""Sinks: tables written by repository and batch, JSON views, and snippets of source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNIPPET_LINES = 24
SNIPPET_BYTES = 4000


def write_batch(df: DataFrame, root: str, table: str, batch: int) -> None:
    """Rows of one batch; writing a batch again replaces it and nothing else, so a restarted pass leaves no duplicates."""
    own = df.withColumn("batch", F.lit(batch))
    own.write.mode("overwrite").partitionBy("repo", "batch").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{table}")


def upserted(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """fresh rows, and stored ones whose key is not among them."""
    return fresh.unionByName(stored.join(fresh.select(*keys).distinct(), keys, "left_anti"))


def export_views(views: dict[str, DataFrame], root: str) -> None:
    """One folder of JSON lines for each view. What can be inspected is written last, from what was really exported."""
    for name in sorted(views, key=lambda n: (n == "coverage", n)):
        views[name].write.mode("overwrite").json(f"{root}/{name}")


def reachable(lists: list[DataFrame], key: str) -> DataFrame:
    """Union of lists by key; the first list that has a key gives its row."""
    rows = None
    for k, df in enumerate(lists):
        own = df.withColumn("_rank", F.lit(k))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    best = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), "_rank").alias("_row"))
    return best.select(key, "_row.*").drop("_rank")


def snippet(source: Column, start_line: Column, end_line: Column) -> Column:
    """struct<text, lines>: at most SNIPPET_LINES lines and SNIPPET_BYTES bytes, with the full number of lines; null where the source is."""
    wanted = F.slice(F.split(source, "\n", -1), start_line.cast("int"), (end_line - start_line + 1).cast("int"))
    shown = F.array_join(F.slice(wanted, 1, SNIPPET_LINES), "\n")
    # cut by characters that surely fit: no character is cut in two
    fits = F.when(F.octet_length(shown) <= SNIPPET_BYTES, shown).otherwise(F.substring(shown, 1, SNIPPET_BYTES // 4))
    return F.when(source.isNotNull(), F.struct(fits.alias("text"), F.size(wanted).alias("lines")))
