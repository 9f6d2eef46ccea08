"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks of documents.

1. Each source's documents fall by hash into a fixed number of blocks. Only (source, block) -> words reaches the driver: at most
   MAX_BLOCKS rows in all, whatever the input, because sources share that number.
2. Targets: the total is shared by weight; a source stops at `max_repeats` times its size, and the excess is shared again (targets()).
3. A source's quota: every block floor(target/size) times, and further blocks from a permutation for the rest: those that still fit,
   then the one that comes nearest. This leaves at most half a block (about 1/1000 of a large source) to the target.
4. The tree: the root holds the quotas of all sources and all regions of the output. A node splits its regions in two halves and draws the
   left half's quotas from a multivariate hypergeometric distribution; the right half gets what is left. So quotas are exact
   at every node, and a region is composed like a random part of the whole. A region holds DRAWS_PER_REGION draws or more, however
   large the blocks are.
5. A source's drawn blocks, permuted, are cut into disjoint runs by the regions' quotas: a document is taken once for each region whose run
   holds its block, and only so. Below the leaf a region's blocks are split among its shards by hash, so shards stay at about SHARD_WORDS words
   and their number follows the words. mix() sends each copy of a document to its shard and shuffles there locally.

The same seed gives the same result. Defined results: a null text has size 0; documents of size 0 are taken as their block
is and count nothing; null is a source of its own, after all others; a source without words has target 0; repeated rows share a block
and are each taken; rows with a null doc_id share one block of their source; an empty table gives no rows. Very long texts are one
document like others. mix() keeps all columns whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import staged, table

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (1, 2, 3)
MAX_REPEATS = 3
MAX_BLOCKS = 1 << 17
BLOCKS = 1024
DRAWS_PER_REGION = 64
SHARD_WORDS = 1_000_000
SEED = 20_240_601


def sizes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, source, size, and hash, which fixes a document's block."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(SEED), "doc_id").alias("hash"))


def targets(size: list[float], weight: list[float], max_repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of the total size by weight. What is above max_repeats times a source's own size is shared among the others by
    weight, again and again until none is above."""
    total = float(sum(size))
    capped = [s <= 0 for s in size]
    while True:
        left = total - sum(max_repeats * s for s, c in zip(size, capped, strict=True) if c)
        open_weight = sum(w for w, c in zip(weight, capped, strict=True) if not c)
        share = [max_repeats * s if c else left * w / open_weight for s, w, c in zip(size, weight, capped, strict=True)]
        above = [not c and t > max_repeats * s for s, t, c in zip(size, share, capped, strict=True)]
        if not any(above):
            return share
        capped = [c or a for c, a in zip(capped, above, strict=True)]


def draws(words: np.ndarray, target: float, max_repeats: int, rng: np.random.Generator) -> np.ndarray:
    """How often each block is taken, so that the taken words come nearest to target."""
    total = int(words.sum())
    if total <= 0:
        return np.zeros(len(words), dtype=np.int64)
    base = min(max_repeats, int(target // total))
    times = np.full(len(words), base, dtype=np.int64)
    rest = target - base * total
    if base < max_repeats:
        order = rng.permutation(len(words))
        for k in order:
            if 0 < words[k] <= rest or words[k] == 0 and base == 0:
                times[k] += 1
                rest -= words[k]
        out = [k for k in order if times[k] == base and words[k]]
        nearest = min(out, key=lambda k: words[k], default=None)
        if nearest is not None and words[nearest] - rest < rest:
            times[nearest] += 1
    return times


def split_quotas(quotas: np.ndarray, regions: int, rng: np.random.Generator) -> np.ndarray:
    """regions x sources: how many block draws of each source a region gets. Sums over regions are exactly the quotas."""
    out = np.zeros((regions, len(quotas)), dtype=np.int64)
    nodes = [(0, regions, quotas.astype(np.int64))]
    while nodes:
        first, n, own = nodes.pop()
        if n == 1:
            out[first] = own
            continue
        half = n // 2
        take = int(own.sum()) * half // n
        left = rng.multivariate_hypergeometric(own, take, method="marginals") if take else np.zeros_like(own)
        nodes += [(first, half, left), (first + half, n - half, own - left)]
    return out


@dataclass(frozen=True)
class Deal:
    """rows: _source, _block, source_size, target and regions, those that take the block, one entry for each time."""

    rows: DataFrame
    blocks: int
    regions: int
    shards: int


def deal(measured: DataFrame, weights: tuple[int, ...] = CYCLE, max_repeats: int = MAX_REPEATS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> Deal:
    """The draw of all blocks of measured (sizes()). It has at most MAX_BLOCKS rows, or 16 for each source where there are more than MAX_BLOCKS / 16."""
    spark = measured.sparkSession
    n_sources = max(1, measured.select("source").distinct().count())
    n_blocks = max(16, min(BLOCKS, MAX_BLOCKS // n_sources))
    block = F.pmod(F.col("hash"), F.lit(n_blocks)).cast("int")
    rows = measured.groupBy("source", block.alias("block")).agg(F.sum("size").alias("words")).collect()
    by_source: dict[str | None, dict[int, int]] = {}
    for r in rows:
        by_source.setdefault(r["source"], {})[r["block"]] = r["words"]
    sources = sorted(by_source, key=lambda s: (s is None, s or ""))  # Python compares text by code point
    size = [sum(by_source[s].values()) for s in sources]
    target = targets(size, [weights[k % len(weights)] for k in range(len(sources))], max_repeats) if sources else []
    rng = np.random.default_rng(seed)
    blocks = [np.array(sorted(by_source[s]), dtype=np.int64) for s in sources]
    times = [draws(np.array([by_source[s][b] for b in own]), t, max_repeats, rng) for s, own, t in zip(sources, blocks, target, strict=True)]
    drawn = np.array([t.sum() for t in times], dtype=np.int64)
    shards = max(1, math.ceil(sum(size) / shard_words))
    regions = max(1, min(shards, int(drawn.sum()) // DRAWS_PER_REGION))
    quotas = split_quotas(drawn, regions, rng)
    dealt = []
    for k, source in enumerate(sources):
        permuted = rng.permutation(np.repeat(np.arange(len(blocks[k])), times[k]))
        runs = np.split(permuted, np.cumsum(quotas[:, k])[:-1])
        taken: dict[int, list[int]] = {}
        for region, run in enumerate(runs):
            for b in run.tolist():
                taken.setdefault(b, []).append(region)
        dealt += [(source, int(b), size[k], float(target[k]), taken.get(j, [])) for j, b in enumerate(blocks[k])]
    schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_block", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("regions", T.ArrayType(T.IntegerType()))])
    made = spark.createDataFrame(dealt, schema)
    return Deal(F.broadcast(made) if len(dealt) <= MAX_BLOCKS else made, n_blocks, regions, shards)


def _dealt(rows: DataFrame, dealt: Deal, key: Column) -> DataFrame:
    """rows with source_size, target and copies (shard, order): one entry for each time that the document is taken. key is the hash that sizes() made."""
    block = F.pmod(key, F.lit(dealt.blocks)).cast("int")
    same = rows["source"].eqNullSafe(dealt.rows["_source"]) & (block == dealt.rows["_block"])

    def edge(region: Column) -> Column:
        return F.floor(region.cast("long") * dealt.shards / dealt.regions)

    def place(region: Column, copy: Column) -> Column:
        within = F.pmod(F.xxhash64(F.lit(SEED + 1), key, copy), edge(region + 1) - edge(region))
        return F.struct((edge(region) + within).alias("shard"), F.xxhash64(F.lit(SEED + 2), key, copy).alias("order"))

    return rows.join(dealt.rows, same).withColumn("copies", F.transform("regions", place)).drop("_source", "_block", "regions")


def plan(measured: DataFrame, **options: object) -> DataFrame:
    """measured (sizes()) with source_size, target and copies: shard and order of each copy of the document in the mix."""
    return _dealt(measured, deal(measured, **options), measured["hash"])


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed corpus: rows of docs, all columns, once for each copy, dealt to shards and shuffled within each. docs is read twice."""
    key = F.xxhash64(F.lit(SEED), docs["doc_id"])
    own = docs.select(F.struct(*docs.columns).alias("_row"), docs["source"].alias("source"), key.alias("_key"))
    dealt = _dealt(own, deal(staged(sizes(docs)), **options), own["_key"])
    copies = dealt.select("_row", F.explode("copies").alias("_copy")).select("_row", F.col("_copy.shard").alias("_shard"), F.col("_copy.order").alias("_order"))
    return copies.repartition("_shard").sortWithinPartitions("_shard", "_order").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(staged(sizes(table(spark, sf_dir, "documents"))))
    shards, orders = [F.array_join(F.col(f"copies.{name}").cast("array<string>"), ",") for name in ("shard", "order")]
    return planned.select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).alias("taken"), shards.alias("shards"), orders.alias("orders"))
