"""The stages of the pipeline, each on what the one before kept."""

import random

import corpus_pipeline
from lamina.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + ".\n"

    good = [prose(60) for _ in range(60)]
    good += [good[0], good[1].replace(" ", "  "), "Key token=abcdefghijklmnop0123 " + prose(50)]
    texts = good + [("LOUD " + prose(4).upper() + "!! ") * 12 for _ in range(40)] + [None, ""]
    rows = [(k, t, "en", "ab"[k % 2], len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < len(good)), 0) for k in range(len(texts) - 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)))
        kept[name] = docs
        assert name == "packing" or docs.columns == COLUMNS
    ids = {n: {r["doc_id"] for r in df.collect()} for n, df in kept.items()}
    assert ids["quality"] >= set(range(len(good))) and not ids["quality"] & set(range(len(good), len(good) + 40))
    assert 60 not in ids["near_copies"] and 61 not in ids["near_copies"] and set(range(60)) <= ids["near_copies"]
    masked = {r["doc_id"]: r["text"] for r in kept["secrets"].collect()}
    assert masked[62].startswith("Key <SECRET> ") and masked[5] == texts[5]
    assert ids["packing"] == ids["mixing"] <= ids["secrets"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["packing"].count()


def test_stages_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, base string, row int, rec string, hash long"
    odd = [(None, "some words without an id", "en", None, 24, "b", 1, "r", 5), (None, "some words without an id", "en", None, 24, "b", 1, "r", 5), (None, None, None, "a", 0, None, None, None, None)]
    odd += [(1, "", "en", "a", 0, "b", 1, "r", 5), (2, "x" * 5000 + " token=abcdefghijklmnop0123", "en", "b", 5027, "b", 1, "r", 5), (2, "two rows of one id", "en", "b", 18, "b", 1, "r", 5)]
    for rows in ([], odd):
        at = str(tmp_path / str(len(rows)))
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs, counts = spark.read.parquet(f"{at}/documents.parquet"), []
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, at))
            counts.append(docs.count())
            assert name == "packing" or docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert corpus_pipeline.run(spark, at).count() == counts[-1]
        # without labels nothing is rejected; one of the two copies goes; all sources meet their targets somehow
        assert counts[:3] == ([0, 0, 0] if not rows else [6, 5, 5]) and (counts[-1] > 0) == bool(rows)
