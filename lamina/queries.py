"""All queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.plans import evolution, golden, matching, narrative, records, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**records.QUERIES, **matching.QUERIES, **narrative.QUERIES, **views.QUERIES, **evolution.QUERIES, **golden.QUERIES}

ORACLE_SQL: dict[str, str] = {**records.ORACLE_SQL, **matching.ORACLE_SQL, **narrative.ORACLE_SQL, **views.ORACLE_SQL, **evolution.ORACLE_SQL, **golden.ORACLE_SQL}
