"""Tables of the engine and the rules that their rows must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUNKS = "array<struct<old_start:bigint,old_count:bigint,new_start:bigint,new_count:bigint>>"

TABLES: dict[str, str] = {
    "commit": "repo string, sha string, topo bigint, author string, authored_at timestamp, committed_at timestamp, message string, is_merge boolean",
    "commit_parent": "repo string, child string, parent string, ordinal int",
    "path_event": "repo string, sha string, topo bigint, path string, lineage bigint",
    "file_change": f"repo string, sha string, topo bigint, change_type string, path string, old_path string, score int, hunks {HUNKS}",
    "anomaly": "repo string, sha string, path string, kind string",
    "slot": "repo string, lineage bigint, name string, disambiguator string",
    "entity": "stable_key string, repo string, birth_sha string, death_sha string, birth_topo bigint, death_topo bigint",
    "content": "content_key string, hash_raw string, hash_token string, hash_alpha string, hash_alpha_self string, hash_shape string, shape_profile string, signature string, node_count int, token_count int, ngrams array<bigint>",
    "revision": "repo string, sha string, topo bigint, lineage bigint, name string, occurrence int, stable_key string, content_key string, path string, start_line int, end_line int",
    "revision_match": "repo string, sha string, prev_key string, next_key string, tier string, jaccard double, exact_verified boolean, ambiguity_size bigint, accepted boolean",
    "revision_change": "repo string, sha string, stable_key string, prev_key string, next_key string, change_level string, sig_changed boolean",
    "discontinuity": "repo string, sha string, lineage bigint, name string, prev_entity string, next_entity string, similarity double",
    "source_doc": "doc_key string, doc_type string, external_id string, body string, body_sha256 string",
    "reference_link": "from_key string, to_kind string, to_key string, method string, confidence double",
    "evidence": "evidence_key string, doc_key string, tier string, char_start int, char_end int, quoted_text string, rule string, doc_body_sha string",
    "candidate": "candidate_key string, doc_key string, char_start int, char_end int, quoted_text string, status string, reason string, evidence_key string",
    "claim": "claim_key string, claim_type string, change_key string, excursion_key string, evidence_key string, confidence double",
    "excursion": "repo string, stable_key string, strength string, method string, birth_sha string, death_sha string, duration_days double",
    "pass_state": "repo string, pass string, last_sha string, last_topo bigint, version string",
}

CHANGE_LEVELS = ("none", "raw", "token", "alpha", "shape", "birth", "death")
TIERS = ("L1", "L2", "L3", "L3b", "L3c", "L4", "L5")


def rules() -> dict[str, dict[str, Column]]:
    """Per table, what must hold of each row. A rule that is null doesn't hold."""
    col = F.col
    fuzzy = col("tier").isin("L4", "L5")
    return {
        "revision_match": {
            "known_tier": col("tier").isin(*TIERS),
            "fuzzy_verified": ~(col("accepted") & fuzzy) | (col("exact_verified") & col("jaccard").isNotNull()),
            "exact_unscored": ~(col("accepted") & ~fuzzy) | (col("exact_verified").isNull() & col("jaccard").isNull()),
        },
        "revision_change": {
            "known_level": col("change_level").isin(*CHANGE_LEVELS),
            "birth_without_prev": (col("change_level") != "birth") | col("prev_key").isNull(),
            "death_without_next": (col("change_level") != "death") | col("next_key").isNull(),
            "some_side": col("prev_key").isNotNull() | col("next_key").isNotNull(),
        },
        "claim": {"one_subject": col("change_key").isNotNull().cast("int") + col("excursion_key").isNotNull().cast("int") == 1},
        "candidate": {"promoted_has_evidence": (col("status") == "promoted") == col("evidence_key").isNotNull()},
        "evidence": {"span_order": (col("char_end") > col("char_start")) & (col("char_start") >= 0)},
    }


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rule, rows: how many rows break each rule, also when none does."""
    broken = [F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).alias(name) for name, ok in checks.items()]
    one = df.agg(*broken)
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias("rows")) for name in checks])
    return one.select(F.explode(pairs).alias("r")).select("r.rule", "r.rows")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, where they must be unique."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")
