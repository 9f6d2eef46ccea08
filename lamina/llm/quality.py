"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

statistics() turns every whole text into NAMES numbers: logs of lengths, and log-odds-like ratios of kinds of characters, of distinct
words, word pairs and lines. They are small next to the text, so they are staged once and both the fit and the scores read them.

The fit gathers, per class, the count, the sum and the sum of outer products of the statistics in each task, so the driver gets
two short rows per task's partial sum, added up by Spark. A class covariance is drawn towards the
diagonal of the pooled one by `shrinkage`, plus a small ridge, then factored once (Cholesky). A score is the logistic of the
difference of the two Gaussian log densities, from Mahalanobis distances by the cached factors, plus the log prior odds.

Defined results: a null text counts as empty and gets a score like any other. If only one class has labels, every score is
that class (0 or 1); without labels, every score is 0.5; a class of a single label has no covariance, so every score is that of the class with more
labels, or 0.5. A text longer than SLICE is worked off in slices, with the same statistics. Labels that are null or not 0 or 1 are left out; a doc_id with
several labels takes their mean, rounded, ties to 1. Repeated documents count as often as they occur. Inputs of a score are statistics of the
text only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import held_out, small_batches, staged, table, tidy

NAMES = ("chars", "words", "word_length", "letters", "upper", "digits", "stops", "calls", "symbols", "lines", "distinct_words", "distinct_pairs", "distinct_lines", "capitalised", "longest_word", "kinds")
SHRINKAGE = 0.02
RIDGE = 1e-4
SLICE = 1 << 20
_LOWER, _UPPER, _DIGIT, _BLANK, _STOP, _CALL, _SYMBOL = range(7)


def _kinds() -> np.ndarray:
    """Kind of every code point of the basic plane; the last entry serves all others."""
    kinds = np.full(0x10001, _SYMBOL, dtype=np.uint8)
    for k in range(0x10000):
        c = chr(k)
        category = unicodedata.category(c)
        if c in ".,;:'\"-()":
            kinds[k] = _STOP
        elif c in "!?":
            kinds[k] = _CALL
        elif category == "Lu":
            kinds[k] = _UPPER
        elif category[0] in "LM":
            kinds[k] = _LOWER
        elif category[0] == "N":
            kinds[k] = _DIGIT
        elif c.isspace():
            kinds[k] = _BLANK
    kinds[0x10000] = _LOWER
    return kinds


def text_statistics(text: str, kinds: np.ndarray) -> list[float]:
    counts = np.zeros(7)
    words = capitalised = longest = 0
    lines = 1
    seen_words, seen_pairs, seen_lines = set(), set(), set()  # of hashes, over all slices
    seen_kinds = np.zeros(256, dtype=bool)
    before: str | None = None
    open_line: list[str] = []
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and not text[end - 1].isspace():  # no word lies in two slices
            end += 1
        part, at = text[at:end], end
        codes = np.minimum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 0x10000)
        counts += np.bincount(kinds.take(codes.astype(np.intp)), minlength=7)
        seen_kinds[codes[codes < 256]] = True
        own = part.split()
        words += len(own)
        seen_words.update(map(hash, own))
        seen_pairs.update(map(hash, zip(own if before is None else [before, *own], own[before is None :], strict=False)))
        before = own[-1] if own else before
        capitalised += sum(map(str.istitle, own))
        longest = max(longest, max(map(len, own), default=0))
        head, *rest = part.split("\n")
        open_line.append(head)
        if rest:
            seen_lines.add(hash("".join(open_line)))
            seen_lines.update(map(hash, rest[:-1]))
            open_line = [rest[-1]]
            lines += len(rest)
    seen_lines.add(hash("".join(open_line)))
    lines = lines if text else 0
    distinct, distinct_pairs, distinct_lines, pairs = len(seen_words), len(seen_pairs), len(seen_lines) if text else 0, max(0, words - 1)
    n = counts.sum()
    letters = counts[_LOWER] + counts[_UPPER]

    def share(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (whole + 1)))

    return [
        float(np.log1p(n)), float(np.log1p(words)), share(letters, words), share(letters, n), share(counts[_UPPER], letters), share(counts[_DIGIT], n), share(counts[_STOP], n), share(counts[_CALL], n),
        share(counts[_SYMBOL], n), share(lines, n), share(distinct, words), share(distinct_pairs, pairs), share(distinct_lines, lines), share(capitalised, words), float(np.log1p(longest)), share(float(seen_kinds.sum()), n),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of every text, for all rows of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in batches:
            rows = [text_statistics(t.as_py() or "", kinds) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(tidy(measure), f"doc_id {kind}, x array<double>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    rows = [(k, i, v) for k in (0, 1) if total[k, 0] for i, v in enumerate(total[k].tolist())]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["y", "i", "v"])


class Discriminant:
    """Means, Cholesky factors, log determinants and log priors of the two classes."""

    def __init__(self, sums: np.ndarray, shrinkage: float) -> None:
        d = len(NAMES)
        n = sums[:, 0]
        self.n = n
        if (n < 2).any():
            return
        self.means = sums[:, 1 : 1 + d] / n[:, None]
        covariances = sums[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - self.means[:, :, None] * self.means[:, None, :]
        pooled = np.diag(np.diag((n[:, None, None] * covariances).sum(axis=0) / n.sum()))
        fixed = (1 - shrinkage) * covariances + shrinkage * pooled + RIDGE * np.eye(d)
        self.factors = np.linalg.cholesky(fixed)
        self.inverse = np.linalg.inv(self.factors)
        self.constant = np.log(n / n.sum()) - np.log(np.diagonal(self.factors, axis1=1, axis2=2)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if (self.n < 2).any():
            return np.full(len(x), 0.5 if not self.n.any() or self.n[0] == self.n[1] else float(self.n[1] > self.n[0]))
        density = [c - 0.5 * np.square((x - m) @ w.T).sum(axis=1) for m, w, c in zip(self.means, self.inverse, self.constant, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(measured: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From all rows of measured (doc_id, x) that labels (doc_id, quality) marks and fold 1 doesn't hold."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = measured.where(~held_out()).join(marks, "doc_id").select("x", "y")
    sums = rows.mapInArrow(tidy(_sums), "y long, i long, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for r in sums:
        total[r["y"], r["i"]] = r["v"]
    return Discriminant(total, shrinkage)


def scores(measured: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = measured.sparkSession.sparkContext.broadcast(model)
    kind = measured.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            p = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return measured.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(tidy(score), f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> DataFrame:
    measured = staged(statistics(docs))
    return scores(measured, fit(measured, labels, shrinkage))


def accepted(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject. Texts are measured in place and never shuffled; to fit, only
    those outside fold 1 are measured before."""
    model = fit(statistics(docs.where(~held_out())), labels, shrinkage)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in batches:
            if batch.num_rows:
                x = np.array([text_statistics(t.as_py() or "", kinds) for t in batch.column("text")])
                yield batch.filter(pa.array(shared.value.score(x) >= 0.5))

    return docs.mapInArrow(tidy(keep), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
