"""Column functions against plain Python models."""

import hashlib
import random

from pyspark.sql import functions as F

from lamina.functions import hashing, hunks, sketch, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first()["v"]


def test_change_level_is_the_first_layer_that_differs(spark):
    layers = ("profile", "raw", "token", "alpha", "shape")
    cases = {(): "none", ("raw",): "raw", ("raw", "token"): "token", ("raw", "token", "alpha"): "alpha", ("raw", "token", "alpha", "shape"): "shape", ("profile",): "shape"}
    for differ, level in cases.items():
        a = {k: F.lit("x") for k in layers}
        b = {k: F.lit("y" if k in differ else "x") for k in layers}
        assert one(spark, hashing.change_level(a, b)) == level


def test_alpha_tokens_rename_bindings_but_not_preserved_types(spark):
    tokens = F.expr("cast(array(struct('id', 'b'), struct('id', 'a'), struct('op', 'a'), struct('prop', 'a'), struct('id', 'free')) as array<struct<type:string,text:string>>)")
    out = one(spark, F.transform(hashing.alpha_tokens(tokens, F.expr("array('a', 'b')"), ("id", "prop"), ("prop",)), lambda t: t["text"]))
    assert out == ["$1", "$0", "a", "a", "free"]


def test_hash32_and_minhash_match_integers(spark):
    def h(s):
        return int.from_bytes(hashlib.sha1(s.encode()).digest()[:4], "big") % hashing.MERSENNE_31

    words = "a b c d e f g".split()
    grams = sorted({h("\x1e".join(words[k : k + 3])) for k in range(5)})
    column = sketch.ngram_set(F.split(F.col("t"), " "))
    assert sorted(one(spark, column, t=" ".join(words))) == grams
    signature = one(spark, sketch.minhash(column), t=" ".join(words))
    assert signature == [min((a * x + b) % hashing.MERSENNE_31 for x in grams) for a, b in sketch.coefficients()]
    assert one(spark, sketch.minhash(F.array().cast("array<bigint>"))) == [hashing.MERSENNE_31] * 128


def test_ngram_sets_of_few_tokens(spark):
    column = F.size(sketch.gram_texts(F.filter(F.split(F.col("t"), " "), lambda w: w != "")))
    assert [one(spark, column, t=t) for t in ("", "a", "a b", "a b c", "a b c d", "a a a a")] == [0, 1, 1, 1, 2, 1]


def test_jaccard_of_empty_sets_is_one(spark):
    empty = F.array().cast("array<int>")
    assert one(spark, sketch.exact_jaccard(empty, empty)) == 1.0
    assert one(spark, sketch.exact_jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == 1 / 3


def test_hunks_against_a_line_model(spark):
    """Old ranges agree with line numbers followed through a random edit."""
    rng = random.Random(5)
    rows, wanted = [], []
    for _ in range(150):
        old = list(range(1, 31))
        at, made, new = 1, [], []
        while at <= 30:
            if rng.random() < 0.12:
                gone, come = rng.randint(0, 2), rng.randint(0, 3)
                gone = min(gone, 31 - at)
                if gone or come:
                    start = len(new) + 1
                    made.append((at if gone else at - 1, gone, start if come else start - 1, come))
                    new += [None] * come
                    at += gone
                    if at <= 30:
                        new.append(at)
                        at += 1
                    continue
            new.append(at)
            at += 1
        if len(new) < 3:
            continue
        s = rng.randint(1, len(new))
        e = min(len(new), s + rng.randint(0, 4))
        rows.append((made, s, e))
        inside = new[s - 1 : e]
        cut = any(h[3] == 0 and s <= h[2] <= e for h in made)
        wanted.append(None if None in inside or cut else (inside[0], inside[-1]))
        del old
    df = spark.createDataFrame(rows, "hunks array<struct<old_start:bigint,old_count:bigint,new_start:bigint,new_count:bigint>>, s bigint, e bigint")
    got = df.select(hunks.old_range(F.col("hunks"), F.col("s"), F.col("e")).alias("r")).collect()
    for r, w, row in zip(got, wanted, rows, strict=True):
        if w is not None and w[1] - w[0] != row[2] - row[1]:
            continue  # a change without new lines inside is seen as a touch at its place only
        assert (tuple(r["r"]) if r["r"] else None) == w, row


def test_hunk_headers(spark):
    parse = hunks.parse_header(F.col("t"))
    assert tuple(one(spark, parse, t="@@ -3 +4,0 @@ def x")) == (3, 1, 4, 0)
    assert tuple(one(spark, parse, t="@@ -0,0 +1,7 @@")) == (0, 0, 1, 7)
    assert one(spark, parse, t="@@ nothing") is None


def test_references(spark):
    got = one(spark, text.references(F.col("t")), t="Fixes #12, see #3 and #12; closed #4. prefix#5 resolve  #6")
    assert [tuple(x) for x in got] == [("3", 0.4), ("4", 0.9), ("5", 0.4), ("6", 0.9), ("12", 0.9)]


def test_aggregate_messages_with_crlf(spark):
    is_aggregate = text.is_aggregate(F.col("t"))
    assert one(spark, is_aggregate, t="Merge\r\n\r\n* one (#1)\r\n- two (#2)\r\n") is True
    assert one(spark, is_aggregate, t="Merge\n* one (#1)\n* again (#1)") is False
    assert one(spark, is_aggregate, t="Merge #1 #2\nplain #3\nplain #4") is False
    attributable = text.attributable(F.col("t"), F.lit(2))
    assert one(spark, attributable, t="Merge because x\n* one (#1)\n* two (#2)") is True
    assert one(spark, text.attributable(F.col("t"), F.lit(None).cast("int")), t="M\n* one (#1)\n1. two (#2)") is False


def test_verify_span_reasons(spark):
    body = "a😀bcd"
    digest = hashlib.sha256(body.encode()).hexdigest()
    check = text.verify_span(F.col("b"), F.col("sha"), F.col("s"), F.col("e"), F.col("q"), F.col("want"))
    for (s, e, q, want), reason in {
        (1, 3, "😀b", digest): "verified", (1, 3, "", digest): "empty_quote", (3, 3, "b", digest): "malformed_range", (-1, 2, "b", digest): "malformed_range", (1, 9, "😀b", digest): "out_of_range", (1, 3, "😀b", "old"): "stale_document", (0, 2, "bc", digest): "offset_mismatch", (0, 2, "zz", digest): "text_not_found",
    }.items():
        assert one(spark, check, b=body, sha=digest, s=s, e=e, q=q, want=want) == reason


def test_small_text_rules(spark):
    assert one(spark, text.unwrap_quote(F.col("t")), t="one \r\n  two\nthree") == "one two three"
    assert one(spark, text.marker_of(F.col("t")), t="causal:instead of/result") == "instead of"
    assert [one(spark, text.is_test_path(F.col("t")), t=t) for t in ("a/tests/x.md", "a/x.spec.ts", "test_a.py", "conftest.py", "src/contest.ts", "a_test.py")] == [True, True, True, False, False, True]
    assert one(spark, text.github_origin(F.col("t")), t="git@github.com:own/name.git") == "own/name"
    assert one(spark, text.quote_rules(F.col("t")), t="because this.") == ["R1", "R5"]
    assert one(spark, text.days_between(F.to_timestamp(F.lit("2024-01-03")), F.to_timestamp(F.lit("2024-01-01")))) == 0.0
