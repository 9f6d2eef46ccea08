"""Substring deduplication: sliding spans of consecutive sentences.

A text falls into sentences. A sentence ends with a word that ends in one of MARKS, and also after any word whose hash, taken together
with the next word's, is divisible by CUT; so a passage that starts or ends amid a sentence of its host, or has no marks at
all, falls into the same sentences in every text, however its lines are broken. The shortest run of at least SENTENCES sentences and
LEAST_WORDS words from each sentence on is hashed, and the shortest that ends the text. Spark counts equal hashes over all texts, with a partial aggregation before the shuffle. Only runs whose hash
occurs again go on: each hash's first occurrence is its least (doc_id, place), and a sentence that any other occurrence covers goes.
What remains keeps its characters and order. LEAST_WORDS is below the fifty words that make a passage because sentences at its edges may belong to
the host in part, and above what chance or a common line repeats.

Only hashes and places are shuffled, and the texts once, to meet their removals. A passage that a third of all documents share is one
row for each map task in the counts; in the joins back it has one row on one side, so the other side can be split.

Words are compared, not the white space between them. A run's hash is a polynomial over 64-bit hashes of its words: of two different runs among n,
about one pair in 2**64 / n**2 is taken for equal. Defined results: a null text stays null, and a text with nothing to remove stays as it is,
byte for byte; a document whose every sentence occurred before becomes empty; later copies of a run within a document go as well; a text
of under LEAST_WORDS words or SENTENCES sentences has no run and stays, even where it repeats another text. Rows that
repeat a doc_id and a text are one document to this operator and each get its result. A null doc_id orders before all others. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import scratch, small_batches, staged, table, tidy

SENTENCES = 3
LEAST_WORDS = 40
MARKS = b".!?,;:"
CUT = 5
_WORD = re.compile(rb"[^ \t\n\r\f\v]+")
_CACHE = 1 << 17
_BASE = 0x9E3779B97F4A7C15


class Runs:
    """Sentences and hashed runs of texts. Word hashes and powers are kept between texts, both bounded: words by _CACHE, powers by the longest text."""

    def __init__(self, least: int = LEAST_WORDS, count: int = SENTENCES, cut: int = CUT) -> None:
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.least, self.count, self.cut = least, count, np.uint64(cut)
        self.known: dict[bytes, int] = {}
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _words(self, words: list[bytes]) -> np.ndarray:
        """Hashes of words; the lowest bit tells whether the word ends a sentence."""
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > _CACHE:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.digest(w) & ~1 | (w[-1] in MARKS)
            return np.array([known[w] for w in words], dtype=np.uint64)

    def starts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, and the number of the first word of each sentence, with the number of words at the end."""
        h = self._words(text.split())
        if not len(h):
            return h, np.zeros(1, dtype=np.int64)
        ends = (h & np.uint64(1)).astype(bool)
        mixed = (h * np.uint64(3) + np.append(h[1:], h[-1:])) * np.uint64(0xD6E8FEB86659FD93)
        ends |= (mixed >> np.uint64(32)) % self.cut == 0
        ends[-1] = True
        return h, np.append(0, np.flatnonzero(ends) + 1)

    def runs(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first sentence, sentence after) of the runs: the shortest from each sentence, and as the last one the shortest that ends the text."""
        n = len(starts) - 1
        after = np.maximum(np.searchsorted(starts, starts[:-1] + self.least), np.arange(n) + self.count)
        after = after[after <= n]
        if not len(after):
            return after, after
        ending = min(int(np.searchsorted(starts, starts[-1] - self.least, side="right")) - 1, n - self.count)
        if after[ending] == n:  # it is one of them
            return np.arange(len(after)), after
        return np.append(np.arange(len(after)), ending), np.append(after, n)

    def hashes(self, text: bytes) -> np.ndarray:
        """The hashes of runs(), in order."""
        h, starts = self.starts(text)
        first, after = self.runs(starts)
        if not len(after):
            return np.zeros(0, dtype=np.int64)
        if len(self.powers) < len(h):
            size = max(1 << 14, 2 * len(h))
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            self.powers, self.inverses = (np.cumprod(np.append(np.uint64(1), np.full(size, b, dtype=np.uint64))) for b in (np.uint64(_BASE), inverse))
        sums = np.append(np.uint64(0), np.cumsum(h * self.powers[: len(h)]))
        value = (sums[starts[after]] - sums[starts[first]]) * self.inverses[starts[first]]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        return value.view(np.int64)

    def sentences(self, text: bytes) -> list[tuple[int, int]]:
        """Byte ranges of the sentences of a text with words, each with the white space that follows it; together they are the text."""
        _, starts = self.starts(text)
        places = [m.start() for m in _WORD.finditer(text)]
        bounds = [0, *[places[k] for k in starts[1:-1].tolist()], len(text)]
        return list(zip(bounds[:-1], bounds[1:], strict=True)) if places else []


def _hashed(least: int, count: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(least, count)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes = [runs.hashes(text.as_py()) for text in part.column("text")]
                sizes = [len(x) for x in hashes]
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                run = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("key").take(row), pa.array(run), pa.array(np.concatenate(hashes))], names=["doc_id", "key", "run", "hash"])

    return work


def occurrences(docs: DataFrame, least: int = LEAST_WORDS, count: int = SENTENCES) -> DataFrame:
    """doc_id, key (hash of the text), run (its number) and hash of every run of every text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(_hashed(least, count)), f"doc_id {kind}, key long, run int, hash long")


def _cut(least: int, count: int):
    def cut(runs: Runs, text: str, gone: list[int]) -> tuple[str, int, list[list[int]]]:
        raw = text.encode()
        bounds = runs.sentences(raw)
        first, after = runs.runs(runs.starts(raw)[1])
        covered = [False] * len(bounds)
        for k in gone:
            covered[first[k] : after[k]] = [True] * int(after[k] - first[k])
        merged: list[list[int]] = []
        at = 0
        for (a, b), c in zip(bounds, covered, strict=True):
            size = len(raw[a:b].decode())
            if c and merged and merged[-1][1] == at:
                merged[-1][1] = at + size
            elif c:
                merged.append([at, at + size])
            at += size
        kept = b"".join(raw[a:b] for (a, b), c in zip(bounds, covered, strict=True) if not c)
        return kept.decode(), sum(covered), merged

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(least, count)
        for batch in batches:
            done = [cut(runs, t.as_py(), g.as_py()) if g.is_valid and t.is_valid else (t.as_py(), 0, []) for t, g in zip(batch.column("text"), batch.column("gone"), strict=True)]
            texts, removed, spans = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int32()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "text", "removed_sentences", "removed_spans"])

    return work


def deduplicated(docs: DataFrame, least: int = LEAST_WORDS, count: int = SENTENCES) -> DataFrame:
    """doc_id, text without the sentences that occurred before, removed_sentences, and removed_spans: [start, end) in code points."""
    gone = scratch(lambda: _later(docs, least, count))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    own = gone.withColumnsRenamed({"doc_id": "_doc_id", "key": "_key"})
    same = keyed["doc_id"].eqNullSafe(own["_doc_id"]) & (keyed["key"] == own["_key"])
    joined = keyed.join(own, same, "left").select("doc_id", "text", "gone")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(tidy(_cut(least, count)), f"doc_id {kind}, text string, removed_sentences int, removed_spans array<array<int>>")


def _later(docs: DataFrame, least: int, count: int) -> DataFrame:
    """doc_id, key, gone: of each text the numbers of its runs that aren't the first of their hash."""
    found = staged(occurrences(docs, least, count))
    repeated = staged(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    shared = staged(found.join(repeated, "hash", "left_semi"))
    place = F.struct("doc_id", "key", "run")
    origin = staged(shared.groupBy("hash").agg(F.min(place).alias("origin")))
    later = shared.join(origin, "hash").where(~place.eqNullSafe(F.col("origin")))
    return staged(later.groupBy("doc_id", "key").agg(F.collect_set("run").alias("gone")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "removed_sentences", "text", F.array_join(F.transform("removed_spans", lambda s: F.concat_ws(":", s[0], s[1])), ",").alias("removed_spans"))
