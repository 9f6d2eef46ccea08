"""From verified quotes to typed claims. Every gate keeps the count of what it holds back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import text as X


def reach(changes: DataFrame) -> DataFrame:
    """commit, entities, scope: how many entities a commit really changes."""
    real = changes.where(F.col("change_level") != "none")
    counted = real.groupBy("commit").agg(F.count_distinct("entity").alias("entities"))
    return counted.withColumn("scope", X.scope_of(F.col("entities")))


def candidates(evidence: DataFrame, changes: DataFrame, deaths: DataFrame) -> DataFrame:
    """Quotes (evidence_key, commit, message, char_start, quoted_text, rule, confidence) against what their commit changes. subject is
    change for each relevant change, and excursion for each removal in the commit, with the number of its removals. Whether a message gathers several
    changes is settled once for each quote, and the message stays behind."""
    ready = evidence.withColumn("aggregate", ~X.attributable(F.col("message"), F.col("char_start"))).select("evidence_key", "commit", "aggregate", "char_start", "quoted_text", "rule", "confidence")
    return fan_out(ready, changes, deaths)


def fan_out(ready: DataFrame, changes: DataFrame, deaths: DataFrame) -> DataFrame:
    """Quotes that are ready to be put down to what their commit changes and removes."""
    columns = ready.columns
    real = changes.where(F.col("change_level") != "none").select("commit", "entity")
    stated = ready.join(real, "commit").select(*columns, F.lit("change").alias("subject"), "entity", F.lit(None).cast("bigint").alias("commit_deaths"))
    count = deaths.groupBy("commit").agg(F.count("*").alias("commit_deaths"))
    gone = deaths.join(count, "commit")
    removed = ready.join(gone, "commit").select(*columns, F.lit("excursion").alias("subject"), "entity", "commit_deaths")
    return stated.unionByName(removed)


def gated(found: DataFrame) -> DataFrame:
    """found with claim_type and gate: why a candidate makes no claim, or null if it makes one."""
    types = F.create_map(*[F.lit(x) for pair in X.MARKER_TYPES.items() for x in pair])
    typed = F.try_element_at(types, X.marker_of(F.col("rule")))
    claim_type = F.when(F.col("subject") == "excursion", F.when(typed.isNotNull(), "abandoned_reason")).otherwise(typed)
    gate = (
        F.when(F.col("aggregate"), "aggregate_message")
        .when((F.col("subject") == "excursion") & (F.col("commit_deaths") != 1), "several_removals")
        .when(claim_type.isNull(), "untyped_marker")
    )
    return found.withColumn("claim_type", claim_type).withColumn("gate", gate)


def derive(found: DataFrame) -> DataFrame:
    return gated(found).where("gate is null").drop("gate")


def suppressed(found: DataFrame) -> DataFrame:
    """gate, candidates, quotes, commits of what was held back."""
    return gated(found).where("gate is not null").groupBy("gate").agg(F.count("*").alias("candidates"), F.count_distinct("quoted_text").alias("quotes"), F.count_distinct("commit").alias("commits"))


def presentable(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims whose quote comes from a document as it is now."""
    current = documents.select("doc_key", F.col("body_sha256").alias("doc_body_sha"))
    return claims.join(current, ["doc_key", "doc_body_sha"], "left_semi")


def stale(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(fresh.select(*keys), keys, "left_anti")


def rationale_groups(quotes: DataFrame, kind: Column | None = None) -> DataFrame:
    """One row for each quote, commit and kind: its entities, and a short id."""
    from lamina.functions.hashing import quote_id

    text = X.unwrap_quote(F.col("quoted_text"))
    rows = quotes.withColumn("text", text).withColumn("kind", kind if kind is not None else F.lit("stated"))
    grouped = rows.groupBy("text", "commit", "kind").agg(F.count_distinct("entity").alias("entities"))
    return grouped.withColumn("quote_id", quote_id(F.col("text"), F.col("commit").cast("string"), F.col("kind"))).withColumn("scope", X.scope_of(F.col("entities")))


def best_references(links: DataFrame) -> DataFrame:
    """Per to_key the strongest reference: confidence first, then the earliest, then method and key."""
    from lamina.operators.lifecycle import ranked

    order = [F.desc("confidence"), F.asc("topo"), F.asc("method"), F.asc("from_key")]
    return ranked(links, ["to_key"], order).where("rank = 1").drop("rank")
