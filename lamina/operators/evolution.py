"""What is told about an entity beyond its own changes: evidence from linked discussions, its references, namesakes, past deletions and rules
that a store must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import asof
from lamina.operators.claims import fan_out
from lamina.operators.lifecycle import ranked


def linked_candidates(references: DataFrame, evidence: DataFrame, changes: DataFrame, deaths: DataFrame) -> DataFrame:
    """Candidates from discussions. references: commit, kind, to_key, confidence; evidence: doc_key (kind:key), evidence_key, char_start, quoted_text,
    rule. A quote counts with the confidence of its best link to a commit; it can't be an aggregate message's."""
    links = references.groupBy("commit", F.concat_ws(":", "kind", "to_key").alias("doc_key")).agg(F.max("confidence").alias("confidence"))
    ready = evidence.join(links, "doc_key").select("evidence_key", "commit", F.lit(False).alias("aggregate"), "char_start", "quoted_text", "rule", "confidence")
    return fan_out(ready, changes, deaths)


def corrected_kinds(references: DataFrame, fetched: DataFrame) -> DataFrame:
    """references (kind, to_key, ...) with the kind that the document turned out to have (to_key, kind) where it has been fetched."""
    known = fetched.groupBy("to_key").agg(F.min("kind").alias("_kind"))
    return references.join(known, "to_key", "left").withColumn("kind", F.coalesce("_kind", "kind")).drop("_kind").select(*references.columns)


def earliest_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """Per key its earliest quote (dates first, unknown ones last; then document, place and id), and how many documents there are besides."""
    order = [F.asc_nulls_last("at"), F.asc("doc_key"), F.asc("char_start"), F.asc("evidence_key")]
    more = evidence.groupBy(key).agg((F.count_distinct("doc_key") - 1).alias("additional"))
    return ranked(evidence, [key], order).where("rank = 1").drop("rank").join(more, key)


def rationale_summary(derived: DataFrame, reach: DataFrame) -> DataFrame:
    """Per entity: quotes of commits that change it alone, quotes that it shares, and the least reach among these."""
    shared = F.col("entities") > 1
    counts = derived.join(reach.select("commit", "entities"), "commit").groupBy("entity")
    return counts.agg(F.count_if(~shared).alias("own"), F.count_if(shared).alias("shared"), F.min(F.when(shared, F.col("entities"))).alias("least_reach"))


def full_timeline(changes: DataFrame, reach: DataFrame, derived: DataFrame, held_back: DataFrame, references: DataFrame) -> DataFrame:
    """One row for each change (commit, entity, change_level): reach and scope of its commit, quotes, the number of its commit's references and the best of
    them, and how many candidates were held back. A change of level none keeps its counts and loses its quotes: they are about something else."""
    quotes = derived.groupBy("commit", "entity").agg(F.array_join(F.sort_array(F.collect_set("quoted_text")), "\x1f").alias("quotes"))
    silent = held_back.groupBy("commit", "entity").agg(F.count("*").alias("suppressed"))
    best = references.groupBy("commit", "to_key").agg(F.max("confidence").alias("confidence")).groupBy("commit")
    linked = best.agg(F.count("*").alias("n_references"), F.min(F.struct((-F.col("confidence")).alias("c"), "to_key"))["to_key"].alias("best_reference"))
    rows = changes.join(reach, "commit", "left").join(quotes, ["commit", "entity"], "left").join(silent, ["commit", "entity"], "left").join(linked, "commit", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for c, n in (("entities", "reach"), ("n_references", "n_references"), ("suppressed", "suppressed"))]
    shown = F.when(F.col("change_level") == "none", "").otherwise(F.coalesce("quotes", F.lit("")))
    return rows.select("commit", "entity", "change_level", *zero, F.coalesce("scope", F.lit("entity")).alias("scope"), shown.alias("quotes"), "best_reference")


def namesakes(spans: DataFrame, name: list[str]) -> DataFrame:
    """Entities that are gone, with those of the same name that live on: entity, survivors (sorted), count."""
    alive = spans.where("death is null").groupBy(*name).agg(F.sort_array(F.collect_set("entity")).alias("alive"))
    others = F.filter(F.coalesce("alive", F.array().cast("array<string>")), lambda e: e != F.col("entity"))
    return spans.where("death is not null").join(alive, name, "left").select("entity", others.alias("survivors")).withColumn("count", F.size("survivors").cast("bigint"))


def last_delete(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """changes with the order of the last removal of the same key before each of them."""
    deaths = changes.where("change_level = 'death'").select(*keys, F.col(order).alias("_death"))
    found = asof.asof_join(changes, deaths, keys, order, "_death", ["_death"])
    return found.withColumnRenamed("asof__death", "last_delete")


def resurrected(found: DataFrame, occupants: DataFrame) -> DataFrame:
    """Changes that bring back what was deleted: found has name and previous_key, the lineage that was deleted; occupants: key, name, entity at its last version.
    Only a name that exactly one entity had there is taken for the one that was lost."""
    single = occupants.groupBy(F.col("key").alias("previous_key"), "name").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("previous_entity")).where("n = 1").drop("n")
    return found.join(single, ["previous_key", "name"])


def split_identities(rows: DataFrame, entity: str, repo: str) -> DataFrame:
    """Entities that lie in more than one repository."""
    return rows.groupBy(entity).agg(F.count_distinct(repo).alias("repositories")).where("repositories > 1")


def crossing(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two ends lie in different repositories."""
    return rows.where(~F.col(left).eqNullSafe(F.col(right)))
