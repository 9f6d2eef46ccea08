from lamina.operators import evidence


def test_proposals_are_promoted_or_rejected_once(spark):
    messages = spark.createDataFrame([("c1", "commit", "Use A instead of B.\nDone because fast"), ("p1", "pr", "```\nbecause code\n```\nbecause real")], "key string, doc_type string, body string")
    none = spark.createDataFrame([], "doc_key string, body_sha256 string")
    docs, conflicts = evidence.ingest(none, messages)
    assert docs.count() == 2 and conflicts.count() == 0
    assert evidence.ingest(docs.select("doc_key", "body_sha256"), messages)[0].count() == 0
    proposed = evidence.extracted(docs)
    out = evidence.submit(proposed.unionByName(proposed), docs).collect()
    assert sorted((r["tier"], r["quoted_text"], r["status"]) for r in out) == [("linked", "because real", "promoted"), ("stated", "Use A instead of B.", "promoted"), ("stated", "because fast", "promoted")]
    bad = proposed.withColumn("char_start", proposed["char_start"] + 1)
    assert {r["reason"] for r in evidence.submit(bad, docs).collect()} == {"offset_mismatch"}
    edited = docs.withColumn("body_sha256", docs["doc_key"])
    kept = proposed.withColumnRenamed("expected_sha", "doc_body_sha")
    assert {r["verdict"] for r in evidence.revalidated(kept, edited).collect()} == {"stale_document"}
    assert evidence.current_generators(proposed).count() == 3


def test_health_and_repositories(spark):
    anomalies = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "z")], "sha string, path string")
    changes = spark.createDataFrame([("s", "a", "b", "e1", "raw"), ("s", "c", None, "e2", "raw"), ("s", "a", "a", "e3", "none")], "sha string, prev_path string, next_path string, entity string, change_level string")
    assert tuple(evidence.parallel_lineage_risk(anomalies, changes).first()) == (2, 1, 1, 3)
    repos = spark.createDataFrame([("/r//x/", 3, 5), ("/r/x", 1, 5), ("/r/x/.git", 2, 4), ("/y", 9, 1)], "path string, id long, commits long")
    assert sorted(map(tuple, evidence.consolidated(repos).collect())) == [("/r/x", 1, 5, 2), ("/y", 9, 1, 0)]
    docs = spark.createDataFrame([(1, "Ab, ab é1")], "k int, body string")
    assert sorted(map(tuple, evidence.search_terms(docs, "k", "body").collect())) == [("ab", 1, 2), ("é1", 1, 1)]
