import subprocess

import pytest

from lamina.plans import index
from lamina.sources import golden, history

BODY = "def {0}(x):\n    total = x + {1}\n    for k in range(total):\n        total += k * {1}\n        print(total, k, x, {1})\n    return total\n\n"


def test_life_of_declarations(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    def commit(message, **files):
        for name, text in files.items():
            (tmp_path / f"{name}.py").write_text(text)
        git("add", "-A")
        git("commit", "-qm", message)

    git("init", "-q", "-b", "main")
    commit("start", a=BODY.format("one", 1) + BODY.format("two", 2) + BODY.format("gone", 3))
    commit("comment", a="# note\n" + BODY.format("one", 1) + BODY.format("two", 2).replace("return", "# why\n    return") + BODY.format("gone", 3))
    commit("rename", a="# note\n" + BODY.format("uno", 1) + BODY.format("two", 2) + BODY.format("gone", 3))
    git("mv", "a.py", "b.py")
    commit("move")
    commit("Revert \"gone\"", b="# note\n" + BODY.format("uno", 1) + BODY.format("two", 2).replace("x + 2", "x - 2"))
    built, commits = index.index_repository(spark, str(tmp_path))
    changes = {(r["topo"], r["name"]): (r["change_level"], r["stable_key"]) for r in built.changes.collect()}
    level = {k: v[0] for k, v in changes.items()}
    assert {level[0, n] for n in ("one", "two", "gone")} == {"birth"}
    assert level[1, "two"] == "raw" and level[1, "one"] == "none"
    assert (2, "one") not in changes and changes[2, "uno"][1] == changes[0, "one"][1] and level[2, "uno"] == "alpha"
    assert level[4, "two"] == "shape" and changes[4, "two"][1] == changes[0, "two"][1]
    assert level[4, "gone"] == "death" and changes[4, "gone"][1] == changes[0, "gone"][1]
    assert {r["tier"] for r in built.matches.collect()} == {"L1", "L3b"}
    out = built.abandoned(commits).collect()
    assert [(r["entity"], r["strength"], r["method"]) for r in out] == [(changes[0, "gone"][1], "A", "git_revert")]
    assert built.hotspots().first()["stable_key"] == changes[0, "two"][1]
    assert [r["topo"] for r in built.timeline("b.py", "uno").collect()] == [0, 1, 2, 3, 4]


class Repo:
    def __init__(self, at):
        self.at = at
        at.mkdir()
        self.git("init", "-q", "-b", "main")

    def git(self, *args):
        return subprocess.run(["git", "-C", str(self.at), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True).stdout.decode()

    def commit(self, message, **files):
        for name, text in files.items():
            (self.at / f"{name}.py").write_text(text)
        self.git("add", "-A")
        self.git("commit", "-qm", message)
        return self.git("rev-parse", "HEAD").strip()


def test_repositories_share_no_identities(spark, tmp_path):
    """Two repositories with the same first commit, of which one removes what the other keeps."""
    first = Repo(tmp_path / "one")
    first.commit("start", a=BODY.format("kept", 1) + BODY.format("gone", 2))
    subprocess.run(["git", "clone", "-q", str(first.at), str(tmp_path / "two")], check=True)
    first.commit("drop", a=BODY.format("kept", 1))
    commits = history.read_history(spark, str(first.at)).union(history.read_history(spark, str(tmp_path / "two")))
    built = index.build(commits, lambda specs: index.read_sources(specs, str(first.at)))
    changes = [(r["repo"][-3:], r["topo"], r["name"], r["change_level"]) for r in built.changes.collect()]
    assert sorted(changes) == sorted([("one", 0, "kept", "birth"), ("one", 0, "gone", "birth"), ("two", 0, "kept", "birth"), ("two", 0, "gone", "birth"), ("one", 1, "kept", "none"), ("one", 1, "gone", "death")])
    assert built.abandoned(commits).count() == 1  # the same content in another repository is no guard


def test_a_side_branch_has_its_own_past(spark, tmp_path):
    """f is replaced on a branch while main goes on with it: each side's changes follow its own file, and the merge brings the branch's file in."""
    repo = Repo(tmp_path / "r")
    start = repo.commit("start", a=BODY.format("f", 1), c=BODY.format("c", 7))
    repo.git("checkout", "-qb", "side")
    repo.git("rm", "-q", "a.py")
    repo.commit("remove")
    back = repo.commit("again", a="import os\n\n" + BODY.format("other", 5).replace("print", "os.write"))
    repo.git("checkout", "-q", "main")
    on_main = repo.commit("main goes on", a=BODY.format("f", 2))
    repo.git("checkout", "-q", "side")
    later = repo.commit("side goes on", a="import os\n\n" + BODY.format("other", 6).replace("print", "os.write"), d=BODY.format("d", 9).replace("range", "list"))
    repo.git("checkout", "-q", "main")
    repo.git("merge", "-q", "-X", "ours", "-m", "merge", "side")
    after = repo.commit("after the merge", d=BODY.format("d", 10).replace("range", "list"))
    built, _ = index.index_repository(spark, str(repo.at))
    got = {(r["sha"], r["name"]): r["stable_key"] for r in built.revisions.collect()}
    assert got[on_main, "f"] == got[start, "f"] and got[later, "other"] == got[back, "other"] != got[start, "f"]
    assert got[after, "d"] == got[later, "d"]
    level = {(r["topo"], r["name"]): r["change_level"] for r in built.changes.collect()}
    assert "birth" not in {v for k, v in level.items() if k[1] == "f" and k[0] > 0}


def test_hunks_reach_the_ladder(spark, tmp_path):
    """Two equal records under new names: only their places tell which is which; what a hunk adds whole is born and matches nothing in its file."""
    repo = Repo(tmp_path / "r")
    twin = "def twin(x):\n    return x\n\n\n"
    repo.commit("start", a=twin + "VALUE = 1\n\n\n" + twin)
    repo.commit("grow", a=BODY.format("fresh", 4) + twin + "VALUE = 2\n\n\n" + twin)
    changes = {r["topo"]: r["changes"] for r in history.read_history(spark, str(repo.at)).collect()}
    assert [tuple(h) for h in changes[1][0]["hunks"]] == [(0, 0, 1, 7), (5, 1, 12, 1)] and changes[0][0]["hunks"][0]["old_count"] == 0
    built, _ = index.index_repository(spark, str(repo.at))
    level = sorted((r["topo"], r["name"], r["change_level"]) for r in built.changes.where("topo = 1").collect())
    assert (1, "fresh", "birth") in level and sum(x[2] == "birth" for x in level) == 1


def test_raw_and_patch_output_of_many_commits():
    sha = "0123456789abcdef0123456789abcdef01234567"
    one, two = "1" * 40, "2" * 40
    output = f"{sha}\n:100644 100644 {one} {two} M\ta.py\n:100644 100644 {one} {one} R100\told.py\tnew.py\n:100644 100644 {one} {two} M\tb.bin\n\ndiff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1,2 @@\n-x\n+--- a/none.py\n+{sha}\n@@ -9,0 +11 @@\n+y\nBinary files a/b.bin and b/b.bin differ\n"
    found = history.parse_commits(output.encode())
    assert list(found) == [sha]
    assert [(c["change_type"], c["path"], c["old_path"], None if c["hunks"] is None else len(c["hunks"])) for c in found[sha]] == [("M", "a.py", None, 2), ("R", "new.py", "old.py", 0), ("M", "b.bin", None, None)]


def test_a_path_taken_again(spark, tmp_path):
    repo = Repo(tmp_path / "r")
    repo.commit("start", a=BODY.format("f", 1) + BODY.format("g", 2), b=BODY.format("h", 3))
    repo.git("rm", "-q", "a.py")
    repo.commit("remove")
    repo.commit("again", a=BODY.format("f", 5).replace("print", "list"))
    repo.git("mv", "b.py", "c.py")
    repo.commit("move")
    built, commits = index.index_repository(spark, str(repo.at))
    found = built.discontinuities.collect()
    born = {(r["topo"], r["name"]): r["stable_key"] for r in built.changes.where("change_level = 'birth'").collect()}
    assert [(r["topo"], r["name"], r["stable_key"], r["previous_entity"]) for r in found] == [(2, "f", born[2, "f"], born[0, "f"])]
    assert [(r["stable_key"], r["revisions"]) for r in built.entities_for("a.py", "f").collect()] == sorted([(born[0, "f"], 1), (born[2, "f"], 1)])
    assert [r["topo"] for r in built.evolution_of(born[0, "f"]).collect()] == [0, 1] and built.survivors("f").first()["stable_key"] == born[2, "f"]
    moves = built.moves().collect()
    assert [(r["name"], r["moved_from"], r["path"], r["tier"]) for r in moves] == [("h", "b.py", "c.py", "L1")]


def test_golden_cases_of_a_repository(spark, tmp_path):
    repo = Repo(tmp_path / "r")
    first = repo.commit("start", a=BODY.format("one", 1) + BODY.format("gone", 3))
    second = repo.commit("name it, because one says nothing", a=BODY.format("uno", 1) + BODY.format("gone", 3))
    third = repo.commit('Revert "gone"', a=BODY.format("uno", 1))
    anchors = [f"{{anchor: {{commit: {sha}, path: a.py, symbol: {name}}}, transition: {{expect_tier_at_most: {tier}}}}}" for sha, name, tier in ((first, "one", "L1"), (second, "uno", "L3b"), (third, "uno", "L1"))]
    place = "difficulty: hard, entity: {path: a.py, symbol: %s}"
    text = f"""repo: {{name: r}}
cases:
- {{id: chain, kind: lineage, difficulty: hard, chain: [{", ".join(anchors)}]}}
- {{id: level, kind: change_level, expect: alpha, at_commit: {second}, {place % "uno"}}}
- {{id: excursion, kind: excursion, expect_strength_at_least: A, introduce_at: {first}, remove_at: {third}, {place % "gone"}}}
- {{id: stays, kind: excursion, expect: absent, introduce_at: {first}, remove_at: {third}, {place % "uno"}}}
- {{id: slot, kind: discontinuity, expect: absent, at_commit: {second}, {place % "uno"}}}
- {{id: stated, kind: evidence, difficulty: easy, at_commit: {second}, expect_spans: [{{contains: because one, tier: stated}}]}}
- {{id: silent, kind: evidence, difficulty: easy, at_commit: {first}, expect_spans: []}}
"""
    (tmp_path / "f.yaml").write_text(text)
    built, commits = index.index_repository(spark, str(repo.at))
    results = index.evaluate(built, commits, golden.read_cases(spark, str(tmp_path / "f.yaml")), *index.messages(commits))
    assert {r["id"]: r["status"] for r in results.collect()} == dict.fromkeys(("chain", "level", "excursion", "stays", "slot", "stated", "silent"), "pass")
    assert [(r["tier"], len(r["origins"])) for r in built.audited.collect()] == [("L3b", 0)]


def test_a_stored_index_is_whole_of_this_version_and_of_this_commit(spark, tmp_path, monkeypatch):
    repo = Repo(tmp_path / "r")
    repo.commit("start", a=BODY.format("one", 1))
    root = str(tmp_path / "store")
    built, _ = index.indexed(spark, str(repo.at), root)
    assert [r["change_level"] for r in built.changes.collect()] == ["birth"]
    tip = history.tip(str(repo.at))
    with monkeypatch.context() as m:
        m.setattr(index, "index_repository", None)  # nothing is built again
        again, commits = index.indexed(spark, str(repo.at), root)
    assert again.changes.collect() == built.changes.collect() and commits.count() == 1 and again.audited.count() == 0
    with monkeypatch.context() as m:
        m.setattr(index.versions, "EXCURSION", "other")
        with pytest.raises(index.versions.VersionMismatch):
            index.load(spark, root, tip)
    repo.commit("more", b=BODY.format("two", 2))
    assert index.load(spark, root, history.tip(str(repo.at))) is None
    later, _ = index.indexed(spark, str(repo.at), root)
    assert sorted(r["name"] for r in later.changes.collect()) == ["one", "two"] and index.load(spark, root, tip) is None
    spark.createDataFrame([], index.STATE).write.mode("overwrite").parquet(f"{root}/state")  # a pass that was stopped
    assert index.load(spark, root, history.tip(str(repo.at))) is None


def test_a_shallow_clone_is_refused(spark, tmp_path):
    repo = Repo(tmp_path / "r")
    for k in range(2):
        repo.commit(f"c{k}", a=BODY.format("one", k))
    subprocess.run(["git", "clone", "-q", "--depth", "1", f"file://{repo.at}", str(tmp_path / "s")], check=True)
    with pytest.raises(Exception, match="shallow clone"):
        history.read_history(spark, str(tmp_path / "s")).count()
