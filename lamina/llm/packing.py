"""Packing of tokenised documents into fixed-length training sequences: bounded-space online best-fit.

A document becomes its token ids and one closing id, cut into pieces of at most `capacity` ids. Pieces are dealt by hash to
packers of about PIECES_PER_PACKER pieces, so that a packer's work is bounded and their number follows the input. A
packer keeps at most `open_bins` bins open. A bitset, one bit per amount of free space, tells the open bin with the
least sufficient space in a few integer operations. If no open bin fits, a new one opens; if that would be one too many,
the fullest closes first. Every packer leaves at most `open_bins` bins unfilled, however long the input is.

Tokenising goes word by word: the vocabulary drops white space and never merges across it, so the ids of a text are the ids of
its blank-separated parts in order. Each worker keeps the ids of parts it has met, of two generations of CACHE_WORDS short ones at most.

A packed row holds the ids themselves, little-endian uint32 as in `encode`, so the rows of a sequence in order of offset are its
tokens: sequences() joins them. The query gives a length and a crc32 in place of the ids.

Defined results: a null text counts as empty and yields the single closing id; texts of any length are cut, never
truncated; repeated rows are packed once each; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import small_batches, staged, table, tidy, trim

CAPACITY = 2048
OPEN_BINS = 512
PIECES_PER_PACKER = 16_384
CLOSING_ID = 0
CACHE_WORDS = 300_000
LONGEST_CACHED = 48
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in plain else free))
        free += byte not in plain
    return out


class WordEncoder(dict):
    """Blank-separated part of a text -> its little-endian uint32 ids, as bytes. What is missing is worked out and kept; of two
    generations of CACHE_WORDS entries at most, the older one goes when the younger is full, but for what was used again."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._fresh(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _fresh(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0250":
            # one word of Latin letters: no need to go through the text pipeline
            lower = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            if lower.isalpha():  # a capital may become a letter and a mark
                coded = self.model.tokenize(lower.encode().decode("latin-1").translate(self.letters))
                return np.array([t.id for t in coded], dtype="<u4").tobytes()
        if text[-1] in ".,;:" and text[-2:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """Splits at ASCII white space, which the vocabulary drops."""
        if b"<|" not in text:
            text = text.lower()  # of ASCII letters, as the vocabulary does; names of special tokens are as they are
        return b"".join(map(self.__getitem__, text.split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that later tasks find the words of earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids: the documents' token sequences, cut. Without a path each worker finds its own vocabulary file."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or tokenizer_path())
        closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [b"" if t is None else t for t in part.column("text").cast(pa.binary()).to_pylist()]
                row, piece, start, length, crc, held = [], [], [], [], [], []
                for k, text in enumerate(texts):
                    ids = coder.encode(text) + closing
                    for n, first in enumerate(range(0, len(ids), step)):
                        own = ids[first : first + step]
                        row.append(k)
                        piece.append(n)
                        start.append(first // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        held.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(held, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin number and offset of every piece, in the order given."""
    free_bits = 0  # bit f is set if an open bin has f free places
    at: list[list[int]] = [[] for _ in range(capacity + 1)]  # the open bins by free space
    n_open = made = 0
    bins, offsets = [], []
    for length in lengths:
        if fitting := free_bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            own = at[free].pop()
            if not at[free]:
                free_bits ^= 1 << free
        else:
            if n_open == open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                at[fullest].pop(0)
                if not at[fullest]:
                    free_bits ^= 1 << fullest
                n_open -= 1
            own, free = made, capacity
            made += 1
            n_open += 1
        bins.append(own)
        offsets.append(capacity - free)
        left = free - length
        if left:
            at[left].append(own)
            free_bits |= 1 << left
        else:
            n_open -= 1
    return bins, offsets


def _packer(capacity: int, open_bins: int) -> Callable[[pa.Table], pa.Table]:
    def pack_one(rows: pa.Table) -> pa.Table:
        if _ENCODERS:  # all pieces are cut by now, and this worker needs no vocabulary to pack them
            _ENCODERS.clear()
            trim()
        ordered = rows.select(["order", "doc_id", "piece", "ids_crc32"])
        rows = rows.take(pc.sort_indices(ordered, sort_keys=[(c, "ascending") for c in ordered.column_names]))
        bins, offsets = best_fit(rows.column("length").to_pylist(), capacity, open_bins)
        packer = rows.column("packer")[0].as_py()
        sequence = pa.array(packer * (1 << 32) + np.array(bins, dtype=np.int64))
        return rows.drop_columns(["packer", "order"]).append_column("sequence_id", sequence).append_column("offset", pa.array(offsets, pa.int64()))

    return pack_one


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32, ...). cut is read twice: stage it first."""
    packers = max(1, round(cut.count() / per_packer))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cut.withColumn("order", order).withColumn("packer", F.pmod(F.xxhash64("order"), F.lit(packers)).cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("packer").applyInArrow(_packer(capacity, open_bins), schema)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(staged(pieces(docs, path)))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the tokens of every sequence, from the rows of pack_documents()."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.aggregate("own", F.unhex(F.lit("")), lambda s, x: F.concat(s, x["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    length = F.expr("octet_length(ids) div 4").alias("length")
    return packed.select("doc_id", "piece", "start", length, F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
