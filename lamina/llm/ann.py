"""Approximate nearest neighbours by Euclidean distance: an inverted file of coarse centroids with product-quantised residuals.

Fit, on a bounded sample (those of the least hash; 16 vectors for each list, SAMPLE to MAX_LISTS * 16 in all): k-means centroids, as many as the
square root of the rows up to MAX_LISTS, and per subspace a codebook of residuals. Every vector, not just the sample, is then put into the list of its nearest
centroid, with its codes.

How much a search looks at is measured on the whole table and not assumed: for CALIBRATION of the queries the exact neighbours among
all rows are found by brute force; the share of lists to probe is what holds RECALL of these neighbours' lists, and the shortlist what holds
RECALL of their places by estimate, both with a margin. So both follow the table and its distribution.

A search probes a query's nearest lists, further ones until they hold MIN_PROBED vectors, and estimates distances from a query's table of
products with the codewords (asymmetric): ||q - c - b||^2 = ||q - c||^2 - 2 q.b + (||b||^2 + 2 c.b), of which the last part is kept with each
vector. The best estimates of a query are reranked by exact distances of the original vectors, in double precision.

Lists are gathered into groups of about GROUP vectors, so that a query leaves one shortlist for each group and not for each list; a
longer list is a group of its own, cut by hash into parts of that size, and the queries of a group are cut into parts of
QUERY_PART, so no task holds a large list. The model (centroids, codebooks, list sizes) is broadcast; its size is bounded by MAX_LISTS.

Defined results: vectors that are null, empty or all zero, or hold null or non-finite components, take no part; only vectors of one
length meet. Repeated rows and equal vectors are candidates each; fewer than TOP candidates give all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import vectors as V
from lamina.llm.common import staged, table, tidy

SAMPLE = 8192
MAX_LISTS = 4096
ROUNDS = 8
CODEWORDS = 256
PARTS_OF_VECTOR = 16
CALIBRATION = 128
RECALL = 0.98
MARGIN = 1.1
MIN_PROBED = 512
LEAST_SHORTLIST = 64
GROUP = 16_384
QUERY_PART = 512
SEED = 7


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, in slices of bounded size."""
    out = np.empty(len(x), dtype=np.int64)
    norms = np.square(centroids).sum(axis=1)
    step = max(1, (1 << 22) // max(1, len(centroids)))
    for at in range(0, len(x), step):
        out[at : at + step] = (norms - 2 * x[at : at + step] @ centroids.T).argmin(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centroids)
        counts = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        held = counts > 0
        sums = np.add.reduceat(x[order], starts[held], axis=0)
        centroids[held] = sums / counts[held, None]
        if not held.all():  # an empty cluster starts anew at some vector
            centroids[~held] = x[rng.choice(len(x), int((~held).sum()))]
    return centroids


@dataclass
class Model:
    centroids: np.ndarray  # lists x d
    books: list[np.ndarray]  # per subspace: codewords x width
    share: float = 1.0  # of the lists to probe
    shortlist: int = LEAST_SHORTLIST
    sizes: np.ndarray | None = None  # vectors in each list

    def rebuilt(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        return self.centroids[lists] + np.hstack([book[codes[:, j]] for j, book in enumerate(self.books)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and ||b||^2 + 2 c.b of each row."""
        own = _nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        at = 0
        for j, book in enumerate(self.books):
            codes[:, j] = _nearest(rest[:, at : at + book.shape[1]], book)
            at += book.shape[1]
        b = self.rebuilt(own, codes) - self.centroids[own]
        return own, codes, (b * (b + 2 * self.centroids[own])).sum(axis=1)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """The lists of each row, nearest first."""
        return np.argsort(np.square(self.centroids).sum(axis=1) - 2 * x @ self.centroids.T, axis=1, kind="stable")

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists to search for each row: the nearest ones, at least MIN_PROBED vectors in all."""
        least = max(1, math.ceil(self.share * len(self.centroids)))
        order = self.ranked(x)
        enough = (np.cumsum(self.sizes[order], axis=1) < MIN_PROBED).sum(axis=1) + 1
        return [row[: max(least, n)] for row, n in zip(order, enough.tolist(), strict=True)]

    def products(self, query: np.ndarray) -> np.ndarray:
        """The asymmetric table of a query: -2 q.b for each part and codeword."""
        out, at = np.zeros((len(self.books), CODEWORDS)), 0
        for j, book in enumerate(self.books):
            out[j, : len(book)] = -2 * book @ query[at : at + book.shape[1]]
            at += book.shape[1]
        return out


def fit(vectors: DataFrame, rows: int) -> Model:
    """From the sample of vectors (vec, v) of one length; rows is the number of vectors, on which the number of lists depends."""
    lists = max(1, min(MAX_LISTS, round(math.sqrt(rows))))
    sample = max(SAMPLE, 16 * lists)
    share = min(1.0, 1.2 * sample / max(1, rows))
    drawn = vectors.where(F.pmod(F.xxhash64("vec", F.lit(SEED)), F.lit(1 << 20)) <= int(share * (1 << 20)))
    taken = drawn.orderBy(F.xxhash64("vec", F.lit(SEED))).limit(sample).select("v").toPandas()
    x = np.stack(taken["v"].to_numpy()).astype(np.float64)
    rng = np.random.default_rng(SEED)
    centroids = kmeans(x, min(lists, max(1, len(x) // 16)), rng)
    rest = x - centroids[_nearest(x, centroids)]
    bounds = np.linspace(0, x.shape[1], min(PARTS_OF_VECTOR, x.shape[1]) + 1).astype(int)
    books = [kmeans(rest[:, a:b], CODEWORDS, rng) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return Model(centroids, books)


def _exact(shared):
    """Of each calibration query its TOP nearest in each slice of a batch, by brute force."""

    def work(batches):
        ids, queries = shared.value
        for frame in batches:
            for at in range(0, len(frame), 8192):
                part = frame.iloc[at : at + 8192]
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                vec = part["vec"].to_numpy()
                far = np.square(x).sum(axis=1) - 2 * queries @ x.T
                far[ids[:, None] == vec[None, :]] = np.inf
                near = np.argsort(far, axis=1, kind="stable")[:, : V.TOP]
                q = np.repeat(np.arange(len(ids)), near.shape[1])
                out = pd.DataFrame({"q": q, "vec": vec[near].ravel(), "far": np.take_along_axis(far, near, axis=1).ravel()})
                yield out[np.isfinite(out["far"])]

    return work


def _places(shared, queries: np.ndarray, bounds: np.ndarray, probed: np.ndarray):
    """(q, k, n): how many vectors of a batch, in the lists that query q probes, are estimated nearer than its k-th bound."""

    def work(batches):
        model = shared.value
        for frame in batches:
            if len(frame):
                lists = frame["list"].to_numpy()
                codes = np.frombuffer(b"".join(frame["codes"]), dtype=np.uint8).reshape(len(frame), -1)
                x = model.rebuilt(lists, codes)
                far = np.square(x).sum(axis=1) - 2 * queries @ x.T
                rows = [(q, k, int((own < b).sum())) for q in range(len(queries)) for own in [far[q, probed[q, lists]]] for k, b in enumerate(bounds[q])]
                yield pd.DataFrame(rows, columns=["q", "k", "n"])

    return work


def calibrate(model: Model, different: DataFrame, index: DataFrame, recall: float = RECALL) -> None:
    """Sets share and shortlist so that they hold `recall` each of the exact neighbours of CALIBRATION queries among all rows."""
    spark = different.sparkSession
    asked = different.where("asked = 1").orderBy(F.xxhash64("vec", F.lit(SEED + 1))).limit(CALIBRATION).select("vec", "v").toPandas()
    if not len(asked):
        return
    queries = np.stack(asked["v"].to_numpy()).astype(np.float64)
    shared = spark.sparkContext.broadcast((asked["vec"].to_numpy(), queries))
    hits = different.select("vec", "v").mapInPandas(tidy(_exact(shared)), "q int, vec long, far double")
    near = F.broadcast(V.limited(hits, "q", [F.asc("far"), F.asc("vec")], V.TOP).select("q", "vec"))  # at most CALIBRATION * TOP rows
    found = index.join(near, "vec").select("q", "list", "codes").toPandas().sort_values("q")
    if not len(found):
        return
    q, lists = found["q"].to_numpy(), found["list"].to_numpy()
    rank = np.argsort(model.ranked(queries), axis=1)
    model.share = min(1.0, MARGIN * (_quantile(rank[q, lists], recall) + 1) / len(model.centroids))
    probed = rank < max(1, math.ceil(model.share * len(model.centroids)))
    x = model.rebuilt(lists, np.frombuffer(b"".join(found["codes"]), dtype=np.uint8).reshape(len(found), -1))
    far = np.square(x).sum(axis=1) - 2 * (queries[q] * x).sum(axis=1)
    bounds = np.full((len(queries), V.TOP), -np.inf)
    place = found.groupby("q").cumcount().to_numpy()
    bounds[q, place] = far
    counts = index.select("list", "codes").mapInPandas(tidy(_places(spark.sparkContext.broadcast(model), queries, bounds, probed)), "q int, k int, n long")
    nearer = {(r["q"], r["k"]): r["n"] for r in counts.groupBy("q", "k").agg(F.sum("n").alias("n")).collect()}  # at most CALIBRATION * TOP rows
    model.shortlist = max(LEAST_SHORTLIST, math.ceil(MARGIN * (_quantile(np.array([nearer[a, b] for a, b in zip(q.tolist(), place.tolist(), strict=True)]), recall) + 1)))


def _quantile(values: np.ndarray, share: float) -> int:
    return int(np.sort(values)[min(len(values) - 1, math.ceil(share * len(values)) - 1)])


def _encoder(shared):
    def work(batches):
        for frame in batches:
            if len(frame):
                own, codes, term = shared.value.encode(np.stack(frame["v"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"vec": frame["vec"], "list": own.astype(np.int32), "codes": [c.tobytes() for c in codes], "term": term})

    return work


def groups(sizes: np.ndarray, group: int = GROUP) -> tuple[list[int], list[int]]:
    """Of each list its group, and of each group the number of parts that it is cut into."""
    own, parts, held = [], [0], 0
    for n in sizes.tolist():
        if held and held + n > group:
            parts.append(0)
            held = 0
        held += n
        own.append(len(parts) - 1)
        parts[-1] = max(1, math.ceil(held / group))
    return own, parts


def _prober(shared, own: list[int]):
    def work(batches):
        for frame in batches:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                lists = shared.value.probes(np.stack(part["v"].to_numpy()).astype(np.float64))
                rows = []
                for vec, v, probed in zip(part["vec"], part["v"], lists, strict=True):
                    by_group: dict[int, list[int]] = {}
                    for k in probed.tolist():
                        by_group.setdefault(own[k], []).append(k)
                    rows += [(vec, v, g, x) for g, x in by_group.items()]
                yield pd.DataFrame(rows, columns=["vec", "v", "group", "lists"])

    return work


def _scanner(shared):
    def work(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "vec": [], "estimate": []}
        if len(data) and len(queries):
            model = shared.value
            number, vec, term = (data[c].to_numpy() for c in ("list", "vec", "term"))
            columns = np.ascontiguousarray(np.frombuffer(b"".join(data["codes"]), dtype=np.uint8).reshape(len(data), -1).T)
            for q, v, lists in zip(queries["vec"].tolist(), queries["v"], queries["lists"], strict=True):
                query = np.asarray(v, dtype=np.float64)
                far = np.full(len(model.centroids), np.inf)
                far[lists] = np.square(query - model.centroids[lists]).sum(axis=1)
                estimate = far.take(number) + term
                for table_row, codes in zip(model.products(query), columns, strict=True):
                    estimate += table_row.take(codes)
                best = np.argpartition(estimate, model.shortlist)[: model.shortlist] if len(estimate) > model.shortlist else np.arange(len(estimate))
                best = best[np.isfinite(estimate[best])]
                out["q"].append(np.full(len(best), q))
                out["vec"].append(vec[best])
                out["estimate"].append(estimate[best])
        if not out["q"]:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "vec": pd.Series(dtype="int64"), "estimate": pd.Series(dtype="float64")})
        return pd.DataFrame({k: np.concatenate(x) for k, x in out.items()})

    return work


def _distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def _search_one_length(different: DataFrame) -> DataFrame:
    """q, vec, score: for each query vector its TOP + 1 nearest of those that the index finds."""
    spark = different.sparkSession
    model = fit(different, different.count())
    shared = spark.sparkContext.broadcast(model)
    index = staged(different.select("vec", "v").mapInPandas(tidy(_encoder(shared)), "vec long, list int, codes binary, term double"))
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MAX_LISTS rows
    model.sizes = np.array([sizes.get(k, 0) for k in range(len(model.centroids))])
    calibrate(model, different, index)
    shared = spark.sparkContext.broadcast(model)
    group_of, parts_of = groups(model.sizes)
    probed = different.where("asked = 1").select("vec", "v").mapInPandas(tidy(_prober(shared, group_of)), "vec long, v array<float>, group int, lists array<int>")
    asking = staged(probed)
    asked = {r["group"]: r["n"] for r in asking.groupBy("group").agg(F.count("*").alias("n")).collect()}  # at most MAX_LISTS rows
    group = F.array(*map(F.lit, group_of))[F.col("list")]
    parts = F.array(*map(F.lit, parts_of))[F.col("group")]
    query_parts = F.array(*[F.lit(max(1, math.ceil(asked.get(k, 0) / QUERY_PART))) for k in range(len(parts_of))])[F.col("group")]
    hashed = F.xxhash64("vec")
    data = index.withColumn("group", group).select("group", F.pmod(hashed, parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), query_parts - 1)).alias("asked"), "list", "vec", "codes", "term")
    queries = asking.select("group", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.pmod(hashed, query_parts).cast("int").alias("asked"), "vec", "v", "lists")
    keys = ("group", "part", "asked")
    near = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_scanner(shared), "q long, vec long, estimate double")
    short = staged(V.limited(near, "q", [F.asc("estimate"), F.asc("vec")], model.shortlist).select("q", "vec"))
    candidates = short.join(different.select("vec", F.col("v").alias("cv")), "vec")
    exact = candidates.join(different.where("asked = 1").select(F.col("vec").alias("q"), F.col("v").alias("qv")), "q")
    scored = exact.select("q", "vec", _distance(F.col("qv"), F.col("cv")).alias("score"))
    return V.limited(scored, "q", [F.asc("score"), F.asc("vec")], V.TOP + 1)


def search(rows: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score of all queries among rows (vec_id, embedding)."""
    own = staged(V.keyed(V.valid(rows), "embedding"))
    different = staged(V.distinct_vectors(own))
    hits = None
    for d in V.dimensions(different):
        found = _search_one_length(different.where(F.size("v") == d))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = different.sparkSession.createDataFrame([], "q long, vec long, score double")
    return V.answers(own, different, V.best_ids(hits, different, descending=False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
