import json

import pytest
from pyspark.sql import functions as F

from lamina.sources import code, discussions, golden, sinks

SOURCE = '''import os

@dec
def one(a, b):
    """doc é"""
    c = a + b  # sum
    return c.a

class K:
    def m(self, x):
        return x
    def m(self, y):
        return y

f = lambda z: z
'''


def by_name(source):
    out = {}
    for d in code.declarations(source):
        out.setdefault(d["name"], []).append(d)
    return out


def test_declarations_and_ranges():
    d = by_name(SOURCE)
    assert {k: len(v) for k, v in d.items()} == {"one": 1, "K": 1, "K.m": 2, "f": 1}
    one = d["one"][0]
    assert (one["start_line"], one["end_line"], one["kind"], d["K.m"][0]["kind"]) == (3, 7, "function", "method")
    assert SOURCE.encode()[one["start_byte"] : one["end_byte"]].decode().startswith("@dec\ndef one") and SOURCE.encode()[one["start_byte"] : one["end_byte"]].decode().endswith("return c.a")


@pytest.mark.parametrize(("edit", "level"), [(("# sum", "# other"), "raw"), (("a + b", "a  +  b"), "raw"), (("c = a + b  # sum\n    return c.a", "d = a + b  # sum\n    return d.a"), "token"), (("a + b", "a - b"), "shape"), (("c.a", "c.b"), "alpha"), (("a + b", "a + os"), "alpha")])
def test_layers(edit, level):
    a, b = by_name(SOURCE)["one"][0], by_name(SOURCE.replace(*edit))["one"][0]
    same = [a[k] == b[k] for k in ("raw", "token", "alpha", "shape")]
    assert {"raw": [False, True, True, True], "token": [False, False, True, True], "alpha": [False, False, False, True], "shape": [False, False, False, False]}[level] == same


def test_two_methods_with_renamed_parameters_are_alike():
    a, b = by_name(SOURCE)["K.m"]
    assert a["alpha"] == b["alpha"] and a["token"] != b["token"]
    r, s = by_name("def g(x):\n    return g(x)")["g"][0], by_name("def h(x):\n    return h(x)")["h"][0]
    assert r["alpha"] != s["alpha"] and r["alpha_self"] == s["alpha_self"]


def test_observe(spark):
    df = spark.createDataFrame([("b1", SOURCE), ("b1", SOURCE), ("b2", "def ("), ("b3", None), ("b4", "")], "blob string, source string")
    out = code.observe(df).collect()
    assert sorted((r["name"], r["occurrence"]) for r in out) == [("K", 0), ("K.m", 0), ("K.m", 1), ("f", 0), ("one", 0)]
    assert all(r["grams"] for r in out)


def test_discussions(spark, tmp_path):
    def record(url, status, body):
        (tmp_path / discussions.file_name(url)).write_text(json.dumps({"version": 1, "request": {"url": url}, "response": {"status": status, "headers": {}, "body": json.dumps(body)}}))

    record("https://h/repos/o/n/issues/7", 200, {"title": "t", "body": "because x", "html_url": "u7", "created_at": "2024-01-01T00:00:00Z", "pull_request": {"url": "p"}})
    record("https://h/repos/o/n/issues/8/comments", 200, [{"body": "one", "html_url": "c1"}, {"body": None, "html_url": "c2"}])
    record("https://h/repos/o/n/issues/9", 404, {})
    assert sorted((r["doc_key"], r["url"], r["body"]) for r in discussions.documents(spark, str(tmp_path)).collect()) == [("issue:8", "c1", "one"), ("issue:8", "c2", ""), ("pr:7", "u7", "because x")]


def test_retries():
    answers, waits = iter([500, OSError(), 200]), []

    def fetch():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert discussions.with_retries(fetch, sleep=waits.append) == 200 and waits == [1.0, 2.0]
    assert discussions.with_retries(lambda: 404, sleep=waits.append) == 404
    assert discussions.with_retries(lambda: 503, sleep=lambda _: None) == 503


def test_golden_cases(spark, tmp_path):
    (tmp_path / "f.yaml").write_text("repo: {name: x}\ncases:\n- {id: a, kind: change_level, difficulty: hard, expect: raw, entity: {path: p, symbol: s}, at_commit: c1}\n- {id: b, kind: change_level, difficulty: easy, expect: raw, entity: {path: p, symbol: s}, at_commit: c2}\n- {id: c, kind: excursion, difficulty: hard, expect: absent, entity: {path: q, symbol: s}, introduce_at: c1, remove_at: c2}\n- {id: d, kind: construct, difficulty: easy}\n")
    cases = golden.read_cases(spark, str(tmp_path / "f.yaml"))
    changes = spark.createDataFrame([("c1", "p", "s", "shape")], "sha string, path string, symbol string, change_level string")
    levels = golden.evaluate_levels(cases, changes)
    assert {(r["id"], r["status"]) for r in levels.collect()} == {("a", "fail"), ("b", "missing")}
    none = spark.createDataFrame([], "introduce_at string, remove_at string, path string, symbol string, strength string")
    assert [(r["status"], r["polarity"]) for r in golden.evaluate_excursions(cases, none).collect()] == [("pass", "negative")]
    total = golden.report(levels).where("difficulty is null").first()
    assert (total["cases"], total["fail"], total["missing"], total["interpretable"]) == (2, 1, 1, False)
    before = spark.createDataFrame([("a", "hard", "pass"), ("b", "easy", "pass")], "id string, difficulty string, status string")
    assert [r["id"] for r in golden.regressions(before, levels).collect()] == ["a"]
    places = spark.createDataFrame([], "sha string, path string, symbol string")
    revisions = spark.createDataFrame([], "sha string, path string, symbol string, occurrence int, node string")
    matches = spark.createDataFrame([], "prev_node string, next_node string, tier string, ambiguity_size long")
    documents, quotes = spark.createDataFrame([], "doc_type string, external_id string"), spark.createDataFrame([], "doc_type string, external_id string, tier string, quoted_text string")
    everything = golden.evaluate(cases, changes, places, none, revisions, matches, documents, quotes)
    assert {(r["id"], r["status"]) for r in everything.collect()} == {("a", "fail"), ("b", "missing"), ("c", "pass"), ("d", "missing")}


@pytest.mark.parametrize("case", ["{id: a, kind: change_level, difficulty: easy, expect: raw, entity: {path: p}, at_commit: c}", "{id: a, kind: excursion, difficulty: easy, entity: {path: p, symbol: s}, introduce_at: c}", "{id: a, kind: lineage, difficulty: easy, chain: [{anchor: {commit: c, path: p, symbol: s}}]}", "{id: a, kind: lineage, difficulty: easy, chain: [{anchor: {commit: c, path: p}}]}", "{id: a, kind: evidence, difficulty: easy, expect_spans: []}"])
def test_a_broken_case_is_not_a_missing_one(spark, tmp_path, case):
    (tmp_path / "f.yaml").write_text(f"repo: {{name: x}}\ncases:\n- {case}\n")
    with pytest.raises(golden.BrokenCase):
        golden.read_cases(spark, str(tmp_path / "f.yaml"))


def test_golden_chains_and_quotes(spark, tmp_path):
    def anchor(sha, occurrence=0):
        return f"{{anchor: {{commit: {sha}, path: p, symbol: s, occurrence: {occurrence}}}, transition: {{expect_tier_at_most: L3b}}}}"

    def case(id, chain, more=""):
        return f"- {{id: {id}, kind: lineage, difficulty: hard, chain: [{', '.join(chain)}]{more}}}\n"

    text = "repo: {name: x}\ncases:\n" + case("sure", [anchor("a"), anchor("b"), anchor("c")]) + case("weak", [anchor("a"), anchor("c")]) + case("apart", [anchor("a"), anchor("b", 1)], ", expect: absent") + case("unseen", [anchor("a"), anchor("z")])
    for name, options in (("chosen", (0, 1)), ("unique", (2, 3)), ("none", (4, 5))):
        both = ", ".join(f"{{chain: [{anchor('a', k)}, {anchor('d', k)}]}}" for k in options)
        text += f"- {{id: {name}, kind: lineage, difficulty: hard, label_confidence: ambiguous, accept_any_of: [{both}]}}\n"
    for name, sha, spans in (("said", "m", "[{contains: slow, tier: stated}]"), ("unsaid", "m", "[{contains: slow, tier: stated}, {contains: fast, tier: stated}]"), ("linked", "m", "[{contains: slow, tier: linked}]"), ("quiet", "q", "[]"), ("loud", "m", "[]"), ("unread", "u", "[]")):
        text += f"- {{id: {name}, kind: evidence, difficulty: hard, at_commit: {sha}, expect_spans: {spans}}}\n"
    (tmp_path / "f.yaml").write_text(text)
    cases = golden.read_cases(spark, str(tmp_path / "f.yaml"))
    places = [("a", 0), ("b", 0), ("b", 1), ("c", 0), ("d", 0), *[(s, k) for s in "ad" for k in (1, 2, 3, 4, 5)]]
    revisions = spark.createDataFrame([(s, "p", "s", k, f"{s}{k}") for s, k in set(places)], "sha string, path string, symbol string, occurrence int, node string")
    found = [("a0", "b0", "L1", 1), ("b0", "c0", "L3b", 1), ("a0", "c0", "L4", 1), ("a0", "d0", "L2", 2), ("a2", "d2", "L2", 1)]
    matches = spark.createDataFrame(found, "prev_node string, next_node string, tier string, ambiguity_size long")
    got = {r["id"]: r["status"] for r in golden.evaluate_lineages(cases, revisions, matches).collect()}
    assert got == {"sure": "pass", "weak": "fail", "apart": "pass", "unseen": "missing", "chosen": "pass", "unique": "fail", "none": "missing"}
    assert golden.certain(golden.evaluate_lineages(cases, revisions, matches)).count() == 4
    documents = spark.createDataFrame([("commit_message", "m"), ("commit_message", "q")], "doc_type string, external_id string")
    quotes = spark.createDataFrame([("commit_message", "m", "stated", "because it is slow")], "doc_type string, external_id string, tier string, quoted_text string")
    got = {r["id"]: r["status"] for r in golden.evaluate_evidence(cases, documents, quotes).collect()}
    assert got == {"said": "pass", "unsaid": "fail", "linked": "fail", "quiet": "pass", "loud": "fail", "unread": "missing"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", 1), ("r", 2)], "repo string, v int")
    for _ in range(2):
        sinks.write_batch(df, str(tmp_path), "t", 1)
    sinks.write_batch(df, str(tmp_path), "t", 2)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    fresh = spark.createDataFrame([("r", 9)], "repo string, v int")
    assert [r["v"] for r in sinks.upserted(df, fresh, ["repo"]).collect()] == [9]
    a, b = spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, x string")
    assert sorted(map(tuple, sinks.reachable([a, b], "k").collect())) == [(1, "a"), (2, "b")]
    text = "\n".join(f"line {k}" for k in range(100))
    r = spark.createDataFrame([(text,)], "t string").select(sinks.snippet(F.col("t"), F.lit(2), F.lit(60)).alias("s")).first()["s"]
    assert r["lines"] == 59 and r["text"].split("\n") == [f"line {k}" for k in range(1, 25)]
    sinks.export_views({"coverage": df, "v": df}, str(tmp_path / "x"))
    assert spark.read.json(f"{tmp_path}/x/v").count() == 2
