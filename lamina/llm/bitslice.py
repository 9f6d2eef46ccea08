"""Exact top-k by inner product with a bit-sliced index.

The index holds blocks of BLOCK_ROWS vectors. Per component of a block, the values less the block's least value, without their DROPPED
lowest bits, stand as bit slices: one bitmap over the block's rows for each bit. A query adds the slices of all components, each as often
shifted as its own component has bits, with bitmap adders (three bitmaps of one weight become a sum and a carry), which gives the slices
of a coarse score. From the most significant slice downward, the rows split into those surely above, tied and below, until the
TOP + 1 best coarse scores are fixed. All dropped parts together can lift a row by at most `slack`, so the rows whose coarse
score is within that of the least chosen one are the boundary; they are resolved by their exact integer products. So results are exact.

A task takes one block of rows, builds its slices once and works off a part of the queries, of QUERY_BLOCK at most; there are more parts only where
blocks alone would leave cores idle. Each block returns TOP + 1 rows for a query, and Spark takes the best.

Arithmetic is that of 64-bit integers: a component beyond 2**63 / 1024 counts as the largest one, and a score beyond 64 bits wraps. Defined results: vectors that are null, empty, or hold null or non-finite components take no part; only vectors of one length meet.
Repeated rows and equal vectors are candidates each; fewer than TOP candidates give all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import vectors as V
from lamina.llm.common import staged, table

SCALE = 1024
BLOCK_ROWS = 16_384
QUERY_BLOCK = 16_384
LEAST_QUERIES = 32
DROPPED = 2


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of every component as a long."""
    ready = V.valid(rows, zero=True)
    return ready.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


class SliceIndex:
    """Bit slices of one block: of component j the bitmaps slices[j], by weight from DROPPED up, above lows[j]."""

    def __init__(self, values: np.ndarray, dropped: int = DROPPED) -> None:
        self.rows = len(values)
        self.values = values
        self.dropped = dropped
        self.lows = values.min(axis=0)
        above = (values - self.lows) >> dropped
        self.width = [int(x).bit_length() for x in above.max(axis=0)]
        pad = -self.rows % 64
        self.slices = []
        for j, width in enumerate(self.width):
            bits = np.zeros((width, self.rows + pad), dtype=bool)
            for b in range(width):
                bits[b, : self.rows] = (above[:, j] >> b) & 1
            self.slices.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        full = np.ones(self.rows + pad, dtype=bool)
        full[self.rows :] = False
        self.full = np.packbits(full, bitorder="little").view(np.uint64)

    def coarse(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices, least significant first, of the sum over components of |q| * slices, where a negative q takes the complement of the
        slices; and how far an exact product can lie above what this sum, scaled, says."""
        stacks: dict[int, list[np.ndarray]] = {}
        for j, q in enumerate(query.tolist()):
            n = abs(q)
            for b in range(self.width[j]):
                bitmap = self.slices[j][b] if q > 0 else self.full & ~self.slices[j][b]
                shift = 0
                while n >> shift:
                    if n >> shift & 1:
                        stacks.setdefault(b + shift, []).append(bitmap)
                    shift += 1
        out, weight = [], 0
        while any(w >= weight for w in stacks):
            own = stacks.pop(weight, [])
            above = stacks.setdefault(weight + 1, [])
            while len(own) > 2:
                a, b, c = own.pop(), own.pop(), own.pop()
                half = a ^ b
                own.insert(0, half ^ c)
                above.append((a & b) | (half & c))
            if len(own) == 2:
                a, b = own
                own = [a ^ b]
                above.append(a & b)
            if not above:
                del stacks[weight + 1]
            out.append(own[0] if own else np.zeros_like(self.full))
            weight += 1
        return out, int(np.abs(query).sum()) * ((1 << self.dropped) - 1)

    def top(self, query: np.ndarray, count: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the count best rows, ties to the smaller id."""
        if self.rows <= count:
            rows = np.arange(self.rows)
        else:
            slices, slack = self.coarse(query)
            above, tied, least = np.zeros_like(self.full), self.full, 0
            for k in range(len(slices) - 1, -1, -1):
                more = above | (tied & slices[k])
                if int(np.bitwise_count(more).sum()) >= count:
                    tied = tied & slices[k]
                    least |= 1 << k
                else:
                    above, tied = more, tied & ~slices[k]
            # rows of a coarse score from least - slack' on may still belong to the best
            bound = least - -(-slack // (1 << self.dropped)) - 1
            chosen = self._at_least(slices, bound)
            rows = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little")[: self.rows])
        scores = self.values[rows] @ query
        best = np.lexsort((ids[rows], -scores))[:count]
        return rows[best], scores[best]

    def _at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        if bound <= 0:
            return self.full
        if bound >> len(slices):
            return np.zeros_like(self.full)
        above, tied = np.zeros_like(self.full), self.full
        for k in range(len(slices) - 1, -1, -1):
            if bound >> k & 1:
                tied = tied & slices[k]
            else:
                above = above | (tied & slices[k])
                tied = tied & ~slices[k]
        return above | tied


def _search(count: int):
    def work(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "vec": [], "score": []}
        if len(data) and len(queries):
            data = data.sort_values("vec")
            ids = data["vec"].to_numpy()
            index = SliceIndex(np.stack(data["v"].to_numpy()))
            for q, v in zip(queries["vec"].tolist(), queries["v"], strict=True):
                rows, scores = index.top(np.asarray(v), count, ids)
                out["q"].append(np.full(len(rows), q))
                out["vec"].append(ids[rows])
                out["score"].append(scores)
        if not out["q"]:
            return pd.DataFrame({k: pd.Series(dtype="int64") for k in out})
        return pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    return work


def search(rows: DataFrame, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of all queries among rows (vec_id, v: integer vectors)."""
    own = staged(V.keyed(rows, "v"))
    different = staged(V.distinct_vectors(own))
    n, asked = different.agg(F.count("*"), F.coalesce(F.sum("asked"), F.lit(0))).first()
    n_blocks = max(1, round(n / block_rows))
    tasks = 2 * own.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-asked // query_block), min(-(-tasks // n_blocks), asked // LEAST_QUERIES))
    row = F.pmod(F.xxhash64("vec"), F.lit(n_blocks)).cast("int")
    query = F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(q_blocks)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    size = F.size("v").alias("d")
    data = different.select(size, row.alias("block"), every(q_blocks).alias("part"), "vec", "v")
    asking = different.where("asked = 1").select(size, query.alias("part"), every(n_blocks).alias("block"), "vec", "v")
    keys = ("d", "block", "part")
    hits = data.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(_search(V.TOP + 1), "q long, vec long, score long")
    best = V.limited(hits, "q", [F.desc("score"), F.asc("vec")], V.TOP + 1)
    return V.answers(own, different, V.best_ids(best, different, descending=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(quantised(table(spark, sf_dir, "embeddings")))


ORACLE_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % {V.QUERY_EVERY} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {V.TOP}
"""
