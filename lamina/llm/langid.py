"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts, for every training row, the hashed 1- to 3-grams of the lower-cased text. Each task adds up its rows in
dense vectors first, so that a language with a third of all rows costs no more than any other; Spark adds them up by language and bucket, so
no task holds the vectors of many others. The driver gets one vector of BUCKETS counts per language and turns them into a log-probability matrix. The matrix (languages x buckets,
float32) is broadcast: its size depends on the number of languages and not on the input.

Scoring gathers matrix rows for the n-grams of a batch and sums them per document in numpy, in slices of SLICE characters,
so that a very long text needs no more memory than a batch of short ones.

Defined results: a text that is null or has no letter gets `und` and score 0; so does every text if nothing could be learned.
The score is the posterior probability of lang_pred. Ties go to the language that comes first by code point. Rows with a null lang teach nothing, and a null doc_id is
kept as it is. Repeated
rows count as often as they occur. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import held_out, small_batches, table, tidy

BUCKETS = 1 << 15
SMOOTHING = 0.1
SLICE = 1 << 16
UNDETERMINED = "und"
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


class Grams:
    """Hashed 1-, 2- and 3-grams of many texts at once. Texts are lower-cased and set between blanks, so that the grams of one
    don't depend on its neighbours; a text longer than SLICE is spread over several parts."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.bounds: list[int] = []  # start and end of the positions that count, alternately
        self.owners: list[int] = []
        self.size = 0

    def add(self, owner: int, text: str) -> Iterator[None]:
        """Yields whenever enough is gathered to be worked off."""
        text = f"  {text.lower()}   "
        last = len(text) - 2
        for at in range(0, last, SLICE):
            part = text[at : min(at + SLICE, last) + 2]
            self.parts.append(part)
            self.bounds += (self.size, self.size + len(part) - 2)
            self.owners.append(owner)
            self.size += len(part)
            if self.size >= SLICE:
                yield

    def take(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Owners, bounds and, for every position, the bucket of the 1-, 2- and 3-gram that starts there."""
        c = np.frombuffer("".join([*self.parts, "  "]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        h1 = c * _MUL[0]
        h2 = (h1[:-1] ^ (c[1:] + np.uint32(0x165667B1))) * _MUL[1]
        h3 = (h2[:-1] ^ (c[2:] + np.uint32(0x27D4EB2F))) * _MUL[2]
        ids = [(h[: self.size] >> np.uint32(17)).astype(np.intp) for h in (h1, h2, h3)]
        out = np.array(self.owners, dtype=np.intp), np.array(self.bounds, dtype=np.intp), ids
        self.__init__()
        return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    gathered: dict[str, Grams] = {}

    def settle(lang: str) -> None:
        _, bounds, ids = gathered[lang].take()
        counted = np.ones(len(ids[0]), dtype=bool)
        counted[bounds[1::2]] = counted[bounds[1::2] + 1] = False
        for h in ids:
            counts[lang] += np.bincount(h[counted], minlength=BUCKETS)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            if not has_letter(text):
                continue
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, dtype=np.int64)
                gathered[lang] = Grams()
            docs[lang] = docs.get(lang, 0) + 1
            for _ in gathered[lang].add(0, text):
                settle(lang)
    for lang, own in counts.items():
        if gathered[lang].size:
            settle(lang)
        held = np.flatnonzero(own)
        bucket, n = np.append(held, BUCKETS), np.append(own[held], docs[lang])  # the last stands for the number of texts
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix (languages x BUCKETS) and log priors, from all rows (lang, text)."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    summed = rows.mapInArrow(tidy(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row for each language, of at most BUCKETS + 1 entries; so much reaches the driver
    total = {}
    for r in summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("own")).collect():
        vector = np.zeros(BUCKETS + 1, dtype=np.int64)
        for bucket, n in r["own"]:
            vector[bucket] = n
        total[r["lang"]] = vector[BUCKETS], vector[:BUCKETS]
    langs = sorted(total)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32), np.zeros(0)
    counts = np.stack([total[x][1] for x in langs], axis=1) + SMOOTHING
    docs = np.array([total[x][0] for x in langs], dtype=np.float64)
    return langs, np.ascontiguousarray(np.log(counts / counts.sum(axis=0)).astype(np.float32).T), np.log(docs / docs.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, prior = shared.value
        columns = [column.astype(np.float64) for column in matrix]
        for batch in batches:
            total = np.tile(prior, (batch.num_rows, 1))
            known = np.zeros(batch.num_rows, dtype=bool)
            grams = Grams()

            def settle(grams: Grams = grams, total: np.ndarray = total) -> None:
                owners, bounds, (h1, h2, h3) = grams.take()
                for k, column in enumerate(columns):
                    own = column.take(h1) + column.take(h2) + column.take(h3)
                    np.add.at(total[:, k], owners, np.add.reduceat(own, bounds)[::2])

            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                if langs and text is not None and has_letter(text):
                    known[k] = True
                    for _ in grams.add(k, text):
                        settle()
            if grams.size:
                settle()
            best = [langs[j] if ok else UNDETERMINED for j, ok in zip(total.argmax(axis=1), known, strict=True)] if langs else [UNDETERMINED] * batch.num_rows
            chance = np.where(known, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0) if langs else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(chance, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(tidy(score), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~held_out())))
