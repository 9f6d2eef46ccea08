"""Documents and the quotes that are verified on them; and checks of a history's health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina import versions
from lamina.functions import hashing, text
from lamina.functions.rationale import rationale_spans


def ingest(stored: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages (key, doc_type, body) as documents: the new ones, and those whose key is stored with another body, which stay out."""
    fresh = messages.select(F.col("key").alias("doc_key"), "doc_type", "body", hashing.sha(F.col("body")).alias("body_sha256")).dropDuplicates(["doc_key"])
    known = stored.select("doc_key", F.col("body_sha256").alias("old"))
    return fresh.join(known, "doc_key", "left_anti"), fresh.join(known, "doc_key").where("old <> body_sha256").drop("old")


def extracted(docs: DataFrame) -> DataFrame:
    """Proposed spans of documents (doc_key, doc_type, body, body_sha256): commit messages as plain text, all others as Markdown."""
    plain = docs.where("doc_type = 'commit'").select("doc_key", "body_sha256", F.explode(rationale_spans(F.col("body"))).alias("s"), F.lit("stated").alias("tier"), F.lit(versions.EXTRACTOR).alias("generator"))
    marked = docs.where("doc_type <> 'commit'").select("doc_key", "body_sha256", F.explode(rationale_spans(F.col("body"), markdown=True)).alias("s"), F.lit("linked").alias("tier"), F.lit(versions.MARKDOWN_EXTRACTOR).alias("generator"))
    return plain.unionByName(marked).select("doc_key", F.col("body_sha256").alias("expected_sha"), "s.char_start", "s.char_end", "s.quoted_text", "s.rule", "tier", "generator")


def submit(proposed: DataFrame, docs: DataFrame) -> DataFrame:
    """Each different proposal once, with status (promoted or rejected), reason, and an evidence_key if it was promoted."""
    key = hashing.content_key(F.col("doc_key"), F.col("char_start"), F.col("char_end"), F.col("quoted_text"), F.col("rule"))
    once = proposed.withColumn("candidate_key", key).dropDuplicates(["candidate_key"])
    joined = once.join(docs.select("doc_key", "body", "body_sha256"), "doc_key", "left")
    verdict = F.when(F.col("body").isNull(), "stale_document").otherwise(text.verify_span(F.col("body"), F.col("body_sha256"), F.col("char_start"), F.col("char_end"), F.col("quoted_text"), F.col("expected_sha")))
    good = F.col("reason") == "verified"
    return joined.withColumn("reason", verdict).withColumn("status", F.when(good, "promoted").otherwise("rejected")).withColumn("evidence_key", F.when(good, F.col("candidate_key"))).withColumn("reason", F.when(~good, F.col("reason"))).drop("body", "body_sha256")


def revalidated(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """Evidence (doc_key, doc_body_sha, char_start, char_end, quoted_text) with its verdict now. Nothing is deleted."""
    joined = evidence.join(docs.select("doc_key", "body", "body_sha256"), "doc_key", "left")
    verdict = text.verify_span(F.col("body"), F.col("body_sha256"), F.col("char_start"), F.col("char_end"), F.col("quoted_text"), F.col("doc_body_sha"))
    return joined.withColumn("verdict", F.when(F.col("body").isNull(), "stale_document").otherwise(verdict)).drop("body", "body_sha256")


def current_generators(evidence: DataFrame) -> DataFrame:
    return evidence.where(F.col("generator").isin(versions.EXTRACTOR, versions.MARKDOWN_EXTRACTOR))


def parallel_lineage_risk(anomalies: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: anomalies (sha, path) that hit parsed files, and what of changes (sha, prev_path, next_path, entity, change_level) they put at risk."""
    places = anomalies.select("sha", "path").distinct()
    rows = changes.where("change_level <> 'none'").select("sha", "entity", F.explode(F.array_distinct(F.array_compact(F.array("prev_path", "next_path")))).alias("path"))
    hit = rows.join(places, ["sha", "path"])
    totals = places.agg(F.count("*").alias("anomalies"))
    return hit.agg(F.count_distinct("path").alias("paths"), F.count_distinct("entity").alias("entities"), F.count_distinct("sha", "entity").alias("rows_at_risk")).crossJoin(totals)


def consolidated(repositories: DataFrame) -> DataFrame:
    """repositories (path, id, commits) by canonical path: the one with the most commits, the lowest id among equals, and how many it absorbs."""
    path = F.regexp_replace(F.regexp_replace("path", r"/+", "/"), r"(?<=.)/(\.git/?)?$", "")
    best = repositories.groupBy(path.alias("path")).agg(F.max(F.struct("commits", (-F.col("id")).alias("n"))).alias("b"), (F.count("*") - 1).alias("absorbed"))
    return best.select("path", (-F.col("b.n")).alias("id"), F.col("b.commits").alias("commits"), "absorbed")


def search_terms(docs: DataFrame, key: str, body: str) -> DataFrame:
    """term, key, hits: an inverted table of lower-case words."""
    words = F.split(F.lower(body), r"[^\p{L}\p{N}]+")
    return docs.select(key, F.explode(F.filter(words, lambda w: w != "")).alias("term")).groupBy("term", key).agg(F.count("*").alias("hits"))
