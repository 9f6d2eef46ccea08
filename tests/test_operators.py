"""Operators against small plain models, with rows in every awkward order."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from lamina import schemas
from lamina.functions import sketch
from lamina.operators import asof, claims, evolution, graph, lifecycle, lineage, matching
from lamina.sources import history
from lamina.streaming import incremental
from lamina.versions import VersionMismatch


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_buckets_refuse_what_is_not_one_to_one(spark):
    prev = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "id int, key string")
    next = spark.createDataFrame([(11, "a"), (12, "b"), (13, "c"), (14, "c"), (15, None)], "id int, key string")
    assert rows(matching.unique_matches(prev, next, ["key"])) == [("a", 1, 11)]
    assert rows(matching.ambiguous(prev, next, ["key"])) == [("b", 2, 1), ("c", 1, 2)]


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(3)
    sets = [(k, sorted(rng.sample(range(40), rng.randint(0, 12)))) for k in range(40)]
    sets += [(k + 100, s) for k, s in sets[:10]]
    df = spark.createDataFrame(sets, "id int, grams array<int>")
    got = {(a, b) for a, b, *_ in rows(matching.similar_pairs(df, df, 0.5, same_side=True))}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and set(x) | set(y) and len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))}
    assert got == want


def test_greedy_rounds_equal_the_sequential_choice(spark):
    rng = random.Random(9)
    pairs = [(c, p, n, rng.choice([0.5, 0.6, 0.75, 0.9])) for c in range(6) for p in range(5) for n in range(5) if rng.random() < 0.6]
    df = spark.createDataFrame(pairs, "commit int, prev_id int, next_id int, score double")
    want = set()
    for c in range(6):
        own = sorted((x for x in pairs if x[0] == c), key=lambda x: (-x[3], x[1], x[2]))
        p_taken, n_taken = set(), set()
        for _, p, n, s in own:
            if p in p_taken or n in n_taken:
                continue
            want.add((c, p, n, s, sum(1 for x in own if x[2] == n and x[3] == s and x[1] not in p_taken)))
            p_taken.add(p)
            n_taken.add(n)
    assert set(rows(matching.greedy_pairs(df, ["commit"]).select("commit", "prev_id", "next_id", "score", "ambiguity_size"))) == want


def side(spark, records):
    columns = "commit int, id int, lineage int, name string, kind string, profile string, raw string, token string, alpha string, alpha_self string, node_count int, start_line bigint, end_line bigint, grams array<int>, hunks array<struct<old_start:bigint,old_count:bigint,new_start:bigint,new_count:bigint>>"
    made = []
    for r in records:
        base = {"commit": 1, "lineage": 1, "name": f"n{r['id']}", "kind": "f", "profile": "p", "node_count": 50, "start_line": 1, "end_line": 1, "grams": [r["id"]], "hunks": None}
        layers = {k: f"{k}{r['id']}" for k in ("raw", "token", "alpha", "alpha_self")}
        made.append(base | layers | r)
    names = [c.split()[0] for c in columns.split(", ")]
    return spark.createDataFrame([tuple(m[k] for k in names) for m in made], columns)


def test_ladder_tiers_in_order(spark):
    prev = [{"id": 1, "name": "same"}, {"id": 2, "raw": "r"}, {"id": 3, "token": "t"}, {"id": 4, "alpha": "al"}, {"id": 5, "alpha_self": "as"}, {"id": 6, "grams": [1, 2, 3, 4]}, {"id": 7, "grams": [11, 12, 13, 14, 15, 16, 17, 18, 19, 20]}, {"id": 8, "raw": "d", "start_line": 10, "end_line": 12}, {"id": 9, "raw": "d", "start_line": 20, "end_line": 22}]
    moved = [(1, 0, 1, 5)]
    next = [{"id": 21, "name": "same", "raw": "x1"}, {"id": 22, "raw": "r", "lineage": 2}, {"id": 23, "token": "t"}, {"id": 24, "alpha": "al"}, {"id": 25, "alpha_self": "as"}, {"id": 26, "grams": [1, 2, 3, 9]}, {"id": 27, "lineage": 3, "grams": [11, 12, 13, 14, 15, 16, 17, 18, 19, 30]}, {"id": 28, "raw": "d", "start_line": 15, "end_line": 17, "hunks": moved}, {"id": 29, "raw": "d", "start_line": 25, "end_line": 27, "hunks": moved}]
    found, refused = matching.ladder(side(spark, prev), side(spark, next))
    got = {(r["prev_id"], r["next_id"], r["tier"]) for r in found.collect()}
    assert got == {(1, 21, "L1"), (2, 22, "L2"), (3, 23, "L2"), (4, 24, "L3"), (5, 25, "L3b"), (6, 26, "L4"), (7, 27, "L5"), (8, 28, "L3c"), (9, 29, "L3c")}
    assert {(r["tier"], r["prev_count"], r["next_count"]) for r in refused.collect()} == {("L2", 2, 2)}
    assert {r["ambiguity_size"] for r in found.where("tier = 'L3c'").collect()} == {2}


def test_audit_names_the_buckets_a_match_came_out_of(spark):
    """Two equal texts under one name on each side: refused by every exact tier, and told apart by their grams alone."""
    twin = {"name": "t", "raw": "r", "token": "t", "alpha": "al", "alpha_self": "as"}
    prev = side(spark, [twin | {"id": 1, "grams": [1, 2, 3]}, twin | {"id": 2, "grams": [7, 8, 9]}, {"id": 3, "name": "c", "raw": "c"}])
    next = side(spark, [twin | {"id": 11, "grams": [1, 2, 3]}, twin | {"id": 12, "grams": [7, 8, 6]}, {"id": 13, "name": "d", "raw": "c"}])
    found, refused = matching.ladder(prev, next)
    audited = matching.audit(prev, next, found, refused)
    got = {(r["prev_id"], r["next_id"], r["tier"]): [(o["tier"], o["prev_count"], o["next_count"]) for o in r["origins"]] for r in audited.collect()}
    every = [("L1", 2, 2), ("L2", 2, 2), ("L2", 2, 2), ("L3", 2, 2), ("L3b", 2, 2)]
    assert got == {(1, 11, "L4"): every, (2, 12, "L4"): every, (3, 13, "L2"): []}
    assert tuple(matching.audit_summary(audited).first()) == (3, 2, 1)


def test_born_in_file_blocks_its_own_file_only(spark):
    added = [(0, 0, 1, 9)]
    prev = side(spark, [{"id": 1, "name": "f", "raw": "r"}])
    inside = side(spark, [{"id": 2, "name": "f", "raw": "z", "hunks": added}, {"id": 3, "name": "g", "raw": "y", "start_line": 50, "end_line": 51, "hunks": added}])
    assert matching.ladder(prev, inside)[0].count() == 0
    other = side(spark, [{"id": 2, "name": "f", "raw": "r", "lineage": 2, "hunks": added}])
    assert rows(matching.ladder(prev, other)[0].select("prev_id", "next_id", "tier")) == [(1, 2, "L2")]


def test_asof_join_is_strict_and_keeps_every_row(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 5), ("b", 2), (None, 9)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("a", 4, 41), ("a", 5, 50), ("c", 0, 1)], "k string, at int, v int")
    assert rows(asof.asof_join(left, right, ["k"], "t", "at", ["v"])) == rows(spark.createDataFrame([("a", 1, None), ("a", 5, 41), ("a", 5, 41), ("b", 2, None), (None, 9, None)], "k string, t int, v int"))
    assert ("a", 5, 50) in rows(asof.asof_join(left, right, ["k"], "t", "at", ["v"], strict=False))


def test_roots_and_ancestors(spark):
    links = spark.createDataFrame([(k, k - 1 if k % 100 else None) for k in range(1, 230)], "node int, prev int")
    got = {r["node"]: (r["root"], r["depth"]) for r in graph.chain_roots(links).collect()}
    assert got[99] == (0, 99) and got[229] == (200, 29) and got[100] == (100, 0)
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4)], "child int, parent int")
    assert {r["ancestor"] for r in graph.ancestors(edges).where("node = 5").collect()} == {1, 2, 3, 4, 5}


def test_move_guard_equals_exists(spark):
    rng = random.Random(4)
    carriers = [(1, rng.choice("xyz"), e, rng.choice([None, 3, 5, 7])) for e in range(12) for _ in range(2)]
    ends = {}
    carriers = [(r, h, e, ends.setdefault(e, d)) for r, h, e, d in carriers]
    candidates = [(1, e, d, h) for r, h, e, d in carriers if d is not None]
    df = lifecycle.move_guard(spark.createDataFrame(carriers, "repo int, hash string, entity int, death int"), spark.createDataFrame(candidates, "repo int, entity int, death int, hash string"), ["repo"])
    for r in df.collect():
        assert r["guarded"] == any(h == r["hash"] and e != r["entity"] and (d is None or d > r["death"]) for _, h, e, d in carriers)


def test_spans_with_revival(spark):
    revisions = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1), ("c", 2)], "entity string, topo int")
    deaths = spark.createDataFrame([("a", 3), ("b", 4), ("c", 2)], "entity string, topo int")
    assert {(r["entity"], r["death"]) for r in lifecycle.spans(revisions, deaths, ["entity"]).collect()} == {("a", None), ("b", 4), ("c", None)}


def test_replaced_needs_evidence(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 0.25), (4, 0.26)], "id int, similarity double")
    assert [r["id"] for r in lifecycle.replaced(df).collect()] == [2, 3]


def test_gates_count_what_they_hold_back(spark):
    e = spark.createDataFrame([("e1", 1, "S because x", 2, "because x", "causal:because", 0.9), ("e2", 2, "S\n* a (#1)\n* b (#2) because", 20, "because", "causal:because", 0.9), ("e3", 3, "S odd", 0, "odd", "causal:odd", 0.9)], "evidence_key string, commit int, message string, char_start int, quoted_text string, rule string, confidence double")
    changes = spark.createDataFrame([(1, "a", "shape"), (1, "b", "none"), (2, "a", "raw"), (3, "a", "raw")], "commit int, entity string, change_level string")
    deaths = spark.createDataFrame([(1, "d"), (1, "x")], "commit int, entity string")
    found = claims.candidates(e, changes, deaths)
    assert rows(claims.derive(found).select("commit", "subject", "entity", "claim_type")) == [(1, "change", "a", "why")]
    assert {(r["gate"], r["candidates"]) for r in claims.suppressed(found).collect()} == {("aggregate_message", 1), ("several_removals", 2), ("untyped_marker", 1)}


def test_lineages(spark):
    commits = [
        ("r", "c1", 1, [], [("A", "a", None), ("A", "b", None)]), ("r", "c2", 2, ["c1"], [("R", "b", "a"), ("R", "a", "b")]), ("r", "c3", 3, ["c2"], [("D", "a", None)]), ("r", "c4", 4, ["c3"], [("A", "a", None), ("C", "k", "b")]), ("r", "c5", 5, ["c4"], [("A", "b", None), ("D", "zz", None), ("M", "q", None)]),
    ]
    df = spark.createDataFrame(commits, "repo string, sha string, topo bigint, parents array<string>, changes array<struct<change_type:string,path:string,old_path:string>>")
    out = lineage.build(df).collect()
    at = {(r["sha"], r["path"]): r["lineage"] for r in out if r["kind"] == "event"}
    assert at["c2", "b"] == at["c1", "a"] and at["c2", "a"] == at["c1", "b"]
    assert at["c3", "a"] is None and at["c4", "a"] not in (at["c1", "a"], at["c1", "b"]) and at["c4", "k"] not in (at["c1", "a"], at["c1", "b"])
    assert sorted(r["detail"] for r in out if r["kind"] == "anomaly") == ["add_of_present", "delete_of_absent", "modify_of_absent"]


def test_lineages_through_a_merge(spark):
    commits = [("r", "m", 1, [], [("A", "a", None)]), ("r", "x", 2, ["m"], [("A", "new", None)]), ("r", "y", 3, ["m"], [("M", "a", None)]), ("r", "z", 4, ["y", "x"], [("A", "new", None)])]
    df = spark.createDataFrame(commits, "repo string, sha string, topo bigint, parents array<string>, changes array<struct<change_type:string,path:string,old_path:string>>")
    at = {(r["sha"], r["path"]): r["lineage"] for r in lineage.build(df).collect() if r["kind"] == "event"}
    assert at["z", "new"] == at["x", "new"]


def test_linear_lineages_agree_with_the_model(spark):
    rng = random.Random(8)
    events, live = [], set()
    for topo in range(1, 60):
        path = rng.choice("abcdef")
        if path in live and rng.random() < 0.3:
            events.append((topo, "D", path, None))
            live.discard(path)
        elif path not in live and live and rng.random() < 0.5:
            old = rng.choice(sorted(live))
            events.append((topo, "R", path, old))
            live = live - {old} | {path}
        elif path not in live:
            events.append((topo, "A", path, None))
            live.add(path)
        else:
            events.append((topo, "M", path, None))
    commits = [("r", f"c{t}", t, [f"c{t - 1}"] if t > 1 else [], [(k, p, o)]) for t, k, p, o in events]
    df = spark.createDataFrame(commits, "repo string, sha string, topo bigint, parents array<string>, changes array<struct<change_type:string,path:string,old_path:string>>")
    got = {(r["topo"], r["path"]): r["lineage"] for r in lineage.build(df).where("kind = 'event' and lineage is not null").collect()}
    assert got == {(t, p): x for t, p, x in lineage.linear_lineages(events)}


def test_incremental_equals_full_for_random_splits(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 5), t, rng.choice(["u", None, "v"])) for t in range(80)]
    df = spark.createDataFrame(data, "k int, topo int, name string")
    full, state = incremental.run_in_batches(df, [79], "v1", ["k"], ["name"])
    assert state.last_topo == 79
    for _ in range(2):
        cuts = sorted(rng.sample(range(79), 3)) + [79]
        assert rows(incremental.run_in_batches(df, cuts, "v1", ["k"], ["name"])[0]) == rows(full)
    with pytest.raises(VersionMismatch):
        incremental.pending(df, state, "v2")
    assert incremental.pending(df, state, "v1").count() == 0


def test_rules_find_planted_rows(spark):
    df = spark.createDataFrame([("birth", None, "n"), ("birth", "p", "n"), ("odd", "p", None), ("raw", None, None)], "change_level string, prev_key string, next_key string")
    assert dict(schemas.violations(df, schemas.rules()["revision_change"]).collect()) == {"known_level": 1, "birth_without_prev": 1, "death_without_next": 0, "some_side": 1}


def test_history_of_a_small_repository(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    (tmp_path / "one.py").write_text("def a():\n    return 1\n" * 5)
    git("add", ".")
    git("commit", "-qm", "first\n\nbecause")
    git("mv", "one.py", "zwei ü.py")
    git("commit", "-qm", "second")
    df = history.read_history(spark, str(tmp_path))
    got = [(r["topo"], len(r["parents"]), [(c["change_type"], c["path"], c["old_path"]) for c in r["changes"]]) for r in df.orderBy("topo").collect()]
    assert got == [(0, 0, [("A", "one.py", None)]), (1, 1, [("R", "zwei ü.py", "one.py")])]
    content = dict(history.read_blobs(str(tmp_path), ["HEAD:zwei ü.py", "HEAD:none"]))
    assert content["HEAD:zwei ü.py"].startswith(b"def a") and content["HEAD:none"] is None


def test_history_parsers():
    assert history.unquote_path(r'"a\303\274\t\"b"') == 'aü\t"b' and history.unquote_path("plain") == "plain"
    assert history.parse_status("T\tx")["change_type"] == "M"
    assert history.parse_status("R095\told\tnew") == {"change_type": "R", "path": "new", "old_path": "old", "score": 95}
    patch = b"--- a/f\n+++ b/f\n@@ -1,2 +1 @@\n-@@ -9 +9 @@\n---- x\n+y\n@@ -7,0 +6,2 @@\n+a\n+b\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n".split(b"\n")
    got = [(p, tuple(h.values())) for p, h in history.parse_hunks(iter(patch))]
    assert got == [("f", (1, 2, 1, 1)), ("f", (7, 0, 6, 2)), ("g", (1, 1, 0, 0))]
    assert history.blob_id(b"") == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


def test_plans_have_no_cartesian_product(spark):
    df = spark.createDataFrame([(1, [1, 2, 3])], "id int, grams array<int>")
    plan = matching.similar_pairs(df, df, 0.5, same_side=True)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert F is not None


def test_ancestors_of_some_commits(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (5, 4), (6, 5), (6, 3), (7, None)], "child long, parent long")
    got = {(r["node"], r["ancestor"]) for r in graph.ancestors_of(edges, spark.createDataFrame([(6,), (3,), (1,)], "node long")).collect()}
    assert got == {(6, k) for k in (1, 2, 3, 4, 5)} | {(3, 1), (3, 2)}
    pairs = spark.createDataFrame([(1, 6), (6, 1), (4, 3), (7, 7)], "ancestor long, node long")
    assert {(r["ancestor"], r["node"]): r["is_ancestor"] for r in graph.is_ancestor(edges, pairs).collect()} == {(1, 6): True, (6, 1): False, (4, 3): False, (7, 7): True}


def test_kinds_are_corrected_and_sets_kept_or_sketched(spark):
    refs = spark.createDataFrame([("issue", "1", 0.4), ("issue", "2", 0.9)], "kind string, to_key string, confidence double")
    fetched = spark.createDataFrame([("2", "pr")], "to_key string, kind string")
    assert {(r["to_key"], r["kind"]) for r in evolution.corrected_kinds(refs, fetched).collect()} == {("1", "issue"), ("2", "pr")}
    grams = F.transform(F.sequence(F.lit(1), F.col("id")), lambda x: x.cast("bigint"))
    got = {r["id"]: r["s"] for r in spark.createDataFrame([(3,), (201,)], "id int").select("id", sketch.signature_from_set(grams.cast("array<string>"), grams).alias("s")).collect()}
    assert got[3]["kind"] == "exact" and got[3]["values"] == [1, 2, 3] and got[201]["kind"] == "sketch" and len(got[201]["values"]) == sketch.PERMUTATIONS


def test_hot_keys_are_numbered_over_many_parts(spark):
    rows = spark.createDataFrame([("hot", None, k) for k in range(500)] + [("a", "x", 7), (None, None, 1), (None, None, 2)], "source string, lang string, doc_id long")
    got = {(r["source"], r["doc_id"]): r["occurrence"] for r in asof.occurrences(rows, ["source", "lang"], ["doc_id"]).collect()}
    assert got == {("hot", k): k for k in range(500)} | {("a", 7): 0, (None, 1): 0, (None, 2): 1}
