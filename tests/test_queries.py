"""Queries on odd tables against their SQL."""

import random
from collections import Counter

import duckdb

from __spark_entry__ import oracle_sql, queries
from lamina.operators import matching

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def both(spark, folder, name, documents):
    path = f"{folder}/documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in documents], DOCUMENTS).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return Counter(map(tuple, queries()[name](spark, str(folder)).collect())), Counter(c.execute(oracle_sql()[name]).fetchall())


def test_span_verify_of_empty_short_and_odd_texts(spark, tmp_path):
    texts = ["", "a", "ab", " ", "~", "a~", "é́", "👩‍🚀 x", "\r\n", "a\0b", "one two three four five six seven eight nine ten ~"]
    documents = [(i, t) for i, t in enumerate(t for t in texts for _ in range(56))] + [(-9, "below zero"), (-1, ""), (5, None)]
    got, want = both(spark, tmp_path, "span_verify", documents)
    assert got == want and len({v for _, v in got}) == 7


def test_greedy_similarity_match_of_copies_ties_and_frequent_grams(spark, tmp_path, monkeypatch):
    # small bounds, so that frequent grams, split cells and the rounds of large components all occur
    for name, value in (("OFTEN", 2), ("HOT_GRAMS", 20), ("CELL", 3), ("LARGEST_COMPONENT", 30), ("FEW_IDS", 5), ("MOST_IDS", 3)):
        monkeypatch.setattr(matching, name, value)
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh")
    bases = [[word() for _ in range(rng.randint(0, 30))] for _ in range(12)]
    texts = [" ".join(w if rng.random() < 0.96 else word() for w in rng.choice(bases)) for _ in range(150)]
    texts += texts[:10] + ["", "A", "a", "a b", None, "the same line every time " * 3, "the same line every time " * 4]
    got, want = both(spark, tmp_path, "greedy_similarity_match", list(enumerate(texts)))
    assert got == want and len(want) > 20
    monkeypatch.undo()
    assert Counter(map(tuple, queries()["greedy_similarity_match"](spark, str(tmp_path)).collect())) == want
