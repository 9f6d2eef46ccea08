"""From raw documents to packed training sequences: five stages, each one operator of lamina.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and hands it on. All
stages but the last return the columns of documents:

1. quality      the discriminant is fitted on the labelled rows that the fold leaves; documents that it rejects go;
2. near_copies  one document of each class of near copies stays, the one with the least doc_id;
3. secrets      spans found in a text are replaced by a mask;
4. mixing       documents are repeated or left out so that sources meet their target weights, and shuffled within shards;
5. packing      documents become pieces of token ids with their places in sequences of 2048 tokens.

Defined results: empty tables give empty results; rows with a null text or a null doc_id go through every stage like others (copies of one
text without an id count as copies); without labels nothing is rejected; other columns are kept, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import jaccard, mixing, packing, quality, secrets
from lamina.llm.common import scratch, staged, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, seeded draws and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # what a stage wrote on its way goes as soon as its result is written; release() removes the results themselves
        docs = scratch(lambda stage=stage, docs=docs: staged(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
