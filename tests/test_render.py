import pytest
from pyspark.sql import functions as F

from lamina import __main__ as command
from lamina import render
from lamina.functions import text
from lamina.sources import history
from lamina.versions import VersionMismatch

CHANGES = "stable_key string, topo int, commit string, change_level string, tier string, ambiguity_size long, path string, name string, moved_from string"


def test_timeline_text(spark):
    rows = [("k" * 40, 0, "r@aaa", "birth", None, None, "a.py", "f", None), ("k" * 40, 1, "r@bbb", "none", "L1", 1, "a.py", "f", None), ("k" * 40, 2, "r@ccc", "shape", "L4", 2, "b.py", "f", "a.py"), ("k" * 40, 3, "r@ddd", "death", None, None, "b.py", "f", None)]
    changes = spark.createDataFrame(rows, CHANGES)
    living = spark.createDataFrame([(f"e{k}" * 8,) for k in range(5)], "stable_key string")
    lines = render.timeline(changes, "a.py", "f", living).split("\n")
    assert lines[0] == "a.py:f: 3 changes of 1 entities, seen unchanged 1 times"
    assert lines[2:5] == ["  aaa born a.py:f", "  ccc structure [L4?] b.py:f, from a.py", "  ddd removed b.py:f"]
    assert "e0e0e0e0e0e0, e1e1e1e1e1e1, e2e2e2e2e2e2 and others" in lines[5]
    with pytest.raises(render.UnknownTarget):
        render.timeline(changes.where("false"), "a.py", "f")


def test_lists_hide_and_count_tests(spark):
    churn = spark.createDataFrame([("a", 2, 3, "f", "a.py"), ("b", 9, 9, "g", "tests/b.py"), ("c", 0, 4, "h", "c.py")], "stable_key string, structural long, changes long, name string, path string")
    assert render.hotspots(churn).split("\n") == ["1 declarations changed their structure; 1 in tests not shown", "   1. 2 of 3 changes a.py:f"]
    found = spark.createDataFrame([("a", "C", "trajectory", 2.0), ("b", "A", "git_revert", 1.0), ("t", "A", "git_revert", 1.0)], "entity string, strength string, method string, duration_days double")
    places = spark.createDataFrame([("a", 1, "a.py", "f"), ("a", 2, "b.py", "f"), ("b", 1, "b.py", "g"), ("t", 1, "test_b.py", "t")], "stable_key string, topo int, path string, name string")
    assert render.abandoned(found, places).split("\n") == ["2 removed after a while, 1 of them only suspected; 1 in tests not shown", "  A removed after 1.0 days (git_revert) b.py:g", "  C suspected after 2.0 days (trajectory) b.py:f"]


def test_known_failures_are_one_line(tmp_path, capsys):
    with pytest.raises(history.GitFailed) as failed:
        history._git(str(tmp_path / "no"), "log")
    assert render.explain(failed.value).endswith("(REPO doesn't exist)")
    assert render.explain(VersionMismatch("rebuild it")) == "rebuild it" and render.explain(KeyError("x")) is None
    assert command.main([]) == 2 and command.main(["why", "x"]) == 2
    assert command.main(["query", "nothing", "x"]) == 1 and command.main(["why", "x", "y"]) == 1
    assert "no such query" in capsys.readouterr().err


def test_addresses(spark):
    rows = [("a/b c", "d+e"), ("(é)*~!'", ""), ("k", None), ("100%", "x/y")]
    made = spark.createDataFrame(rows, "k string, s string").select("k", "s", text.timeline_address(F.col("k"), F.col("s")).alias("a")).withColumn("p", text.parse_address(F.col("a"))).collect()
    assert [r["a"] for r in made] == ["#a%2Fb%20c/d%2Be", "#(%C3%A9)*~!'", "#k", "#100%25/x%2Fy"]
    assert [(r["p"]["key"], r["p"]["sha"]) for r in made] == [(k, s or "") for k, s in rows]
    assert tuple(spark.range(1).select(text.parse_address(F.lit("old"))).first()[0]) == ("old", "")
