"""N-gram Jaccard join: chosen-path join over word shingles, exact in what it reports.

Equal texts become one record with a count of copies. A record is a set of hashed 5-word shingles with a signature of SLOTS minimum
hashes; a slot's value is a token that two sets share with a probability equal to their similarity.

1. Paths: in each run a node samples TOKENS slots, the same for all its records, and splits its records by those slots' values. A
   node with more than LEAF records splits again, unless a child holds over half of it: such a node is dense, for its records are
   alike, and is a leaf as it is. After DEPTH levels every node is a leaf. runs() repeats this until the target recall.
2. Leaves are compared by brute force. A leaf that is large, in records or shingles, is cut into blocks and worked off as cells, one
   for each pair of blocks, so that no task holds a large group. A pair that meets in several leaves counts in its first
   one only; blocks whose records all share an earlier leaf make no cell, so repeated runs add little work to a dense group.
3. A cell first compares signatures; records with a likely partner then get their full sets, and intersections are counted with bit sets.
   It emits, per record, the number of its links and the least record that it is linked to, not the pairs.
4. Classes are connected components of the links, by least labels and pointer jumping.

Words are what lies between ASCII white space; a text of fewer words than a shingle is one shingle. Defined results: a null text is a class
of its own with no link; a text without words links to none but its equal copies; n_copies counts the rows with an equal text, and
n_links the different texts with a similarity of at least 0.8. Repeated rows count as copies. The class id is the least doc_id of the class.
A row with a null doc_id is compared and counted like any other; a class has a null id only if all its rows have none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import scratch, small_batches, staged, table, tidy

WIDTH = 5
THRESHOLD = (4, 5)  # similarity as a fraction, so that the test is exact
SLOTS = 64
TOKENS = 2
DEPTH = 4
LEAF = 256
BLOCK_SHINGLES = 1 << 20
TARGET_RECALL = 0.9999
#: A pair of similarity 0.8 agrees in fewer slots with a probability of about 1e-6.
LEAST_SLOTS = 36
_BIG = 1 << 61
_CACHE = 1 << 17
_VOCABULARY = 1 << 16


def runs(recall: float = TARGET_RECALL, depth: int = DEPTH, similarity: float = THRESHOLD[0] / THRESHOLD[1]) -> int:
    """Runs after which a pair at the threshold has met with the given probability even if each path is depth nodes long."""
    met = (1 - (1 - similarity) ** TOKENS) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


class Shingler:
    """Sets of hashed word n-grams, as sorted uint64 arrays."""

    def __init__(self, width: int = WIDTH) -> None:
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.width = width
        self.known: dict[bytes, int] = {}
        self.factors = [np.uint64(x) for x in np.random.default_rng(width).integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)]

    def words(self, text: bytes) -> np.ndarray:
        known = self.known
        words = text.split()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > _CACHE:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.digest(w)
            return np.array([known[w] for w in words], dtype=np.uint64)

    def set(self, text: bytes) -> np.ndarray:
        words = self.words(text)
        width = min(self.width, len(words))
        if not width:
            return np.zeros(0, dtype=np.uint64)
        n = len(words) - width + 1
        total = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            total += words[k : k + n] * self.factors[k]
            total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
        return np.unique(total)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(64)
    a = rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
    return a[:, None], b[:, None]


def minima(tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(SLOTS, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(tokens), 1024):
        np.minimum(out, ((tokens[at : at + 1024] * a + b) >> np.uint64(32)).min(axis=1), out=out)
    return out.astype("<u4")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    a, b = _coefficients()
    for batch in batches:
        n, sig, short = [], [], []
        for text in batch.column("text"):
            tokens = shingler.set(text.as_py())
            n.append(len(tokens))
            least = minima(tokens, a, b) if len(tokens) else np.zeros(0, dtype="<u4")
            sig.append(least.tobytes())
            short.append((least & 0xFF).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rec"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(short, pa.binary())], names=["rec", "doc_id", "n", "sig", "short"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and rec, the digest that stands for the text; null texts are left out."""
    text = F.col("text").cast("binary")
    return docs.where("text is not null").select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("rec"))


def _row_key(doc_id: Column, rec: Column) -> Column:
    """One digest for an id, null or not, and a text. A join by it can't meet a hot group of copies, and one exchange serves whatever is keyed by it."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")).cast("binary"), rec)))


def records(docs: DataFrame) -> DataFrame:
    """rec, first (the least doc_id), copies, n (shingles), sig and short (one byte a slot) of each different text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = _keyed(docs).mapInArrow(tidy(_signatures), f"rec binary, doc_id {kind}, n long, sig binary, short binary")
    return signed.groupBy("rec").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("short").alias("short"))


def _slot(sig: Column, slot: Column | int) -> Column:
    return F.substring(sig, slot * 4 + 1, 4) if isinstance(slot, int) else sig.substr(slot * 4 + 1, F.lit(4))


def leaves(recs: DataFrame, n_runs: int) -> tuple[DataFrame, DataFrame]:
    """(leaf, rec) and (leaf, size, shingles) of all leaves with at least two records. Ids of large leaves are below those of others."""
    sets = recs.where("n > 0").select("rec", "n", "sig")
    rng = np.random.default_rng(n_runs)
    children = [F.xxhash64(F.lit(r), F.lit(int(s)), _slot(F.col("sig"), int(s))) for r in range(n_runs) for s in rng.choice(SLOTS, TOKENS, replace=False)]
    rows = sets.select("rec", "n", F.explode(F.array(*children)).alias("node"))
    members, stats = [], []

    def counted(df: DataFrame, *by: str) -> DataFrame:
        return staged(df.groupBy(*by).agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1"))

    counts = counted(rows, "node")
    for level in range(1, DEPTH + 1):
        large = counts.where(F.col("size") > LEAF)
        small = counts.where(F.col("size") <= LEAF)
        members.append(rows.join(small.hint("merge"), "node", "left_semi").select("node", "rec"))
        stats.append(small)
        if not large.take(1):
            break
        if level == DEPTH:
            members.append(rows.join(large, "node", "left_semi").select("node", "rec"))
            stats.append(large)
            break
        held = staged(rows.join(large.select("node"), "node", "left_semi").select("node", "rec"))
        slots = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(SLOTS)).cast("int") for k in range(TOKENS)]
        child = F.explode(F.array(*[F.xxhash64("node", F.lit(k), _slot(F.col("sig"), s)) for k, s in enumerate(slots)]))
        split = staged(held.join(sets, "rec").select("rec", "n", "node", child.alias("child")))
        below = counted(split, "node", "child")
        dense = below.groupBy("node").agg(F.max("size").alias("most")).join(large, "node").where(F.col("most") * 2 > F.col("size")).select("node", "size", "shingles")
        dense = staged(dense)
        members.append(held.join(dense, "node", "left_semi"))
        stats.append(dense)
        open_children = below.join(dense, "node", "left_anti")
        rows = split.join(dense, "node", "left_anti").select("rec", "n", F.col("child").alias("node"))
        counts = staged(open_children.select(F.col("child").alias("node"), "size", "shingles"))
    all_stats, all_members = stats[0], members[0]
    for s, m in zip(stats[1:], members[1:], strict=False):
        all_stats = all_stats.unionByName(s)
    for m in members[1:]:
        all_members = all_members.unionByName(m)
    return all_members.withColumnRenamed("node", "leaf"), all_stats.withColumnRenamed("node", "leaf")


def cells(recs: DataFrame, members: DataFrame, stats: DataFrame) -> DataFrame:
    """leaf, cell, block and rec with its n, sig (one byte a slot) and leaves: who meets whom."""
    big = (F.col("size") > LEAF) | (F.col("shingles") > BLOCK_SHINGLES)
    rank = F.when(big, F.pmod(F.col("leaf"), F.lit(_BIG))).otherwise(F.pmod(F.col("leaf"), F.lit(_BIG)) + _BIG)
    ranked = staged(stats.select("leaf", rank.alias("rank")))
    own = members.join(ranked, "leaf").groupBy("rec").agg(F.sort_array(F.collect_set("rank")).alias("leaves"))
    at = staged(own.join(recs.select("rec", "n", F.col("short").alias("sig")), "rec").select("rec", "n", "sig", "leaves", F.explode("leaves").alias("leaf")))
    small = at.where(F.col("leaf") >= _BIG).select("leaf", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("block"), "rec", "n", "sig", "leaves")
    large = at.where(F.col("leaf") < _BIG).withColumn("cover", F.when(F.col("leaves")[0] < F.col("leaf"), F.col("leaves")[0]).otherwise(F.lit(-1)))
    per = large.groupBy("leaf", "cover").agg(F.greatest(F.ceil(F.count("*") / LEAF), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # at most one entry for each leaf that a record can be in besides this one
    layout = staged(per.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("cover", "blocks"))).alias("layout")))
    dealt = large.join(layout, "leaf")

    def before(cover: Column) -> Column:
        return F.aggregate(F.filter("layout", lambda x: x["cover"] < cover), F.lit(0), lambda s, x: s + x["blocks"])

    mine = F.filter("layout", lambda x: x["cover"] == F.col("cover"))[0]["blocks"]
    block = before(F.col("cover")) + F.pmod(F.xxhash64("rec", "leaf"), mine).cast("int")
    partners = F.flatten(F.transform(F.filter("layout", lambda x: (x["cover"] != F.col("cover")) | (x["cover"] == -1)), lambda x: F.transform(F.sequence(F.lit(1), x["blocks"]), lambda k: before(x["cover"]) + k - 1)))
    spread = dealt.withColumn("block", block).withColumn("other", F.explode(partners))
    cell = F.least("block", "other").cast("long") * (1 << 31) + F.greatest("block", "other")
    return small.unionByName(spread.select("leaf", cell.alias("cell"), "block", "rec", "n", "sig", "leaves"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (leaf, cell), from rows that come sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((leaf[1:] != leaf[:-1]) | (cell[1:] != cell[:-1])) + 1
        bounds = [0, *edges.tolist(), batch.num_rows]
        if rest and (rest[-1].column("leaf")[-1].as_py(), rest[-1].column("cell")[-1].as_py()) != (leaf[0], cell[0]):
            yield pa.Table.from_batches(rest)
            rest = []
        for k in range(len(bounds) - 1):
            part = batch.slice(bounds[k], bounds[k + 1] - bounds[k])
            if k < len(bounds) - 2:
                yield pa.Table.from_batches([*rest, part])
                rest = []
            else:
                rest.append(part)
    if rest:
        yield pa.Table.from_batches(rest)


def likely(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a cell that are in one of its blocks each, count in this leaf and may be similar."""
    size = group.num_rows
    none = np.zeros(0, dtype=np.intp)
    if size < 2:
        return none, none
    n = group.column("n").to_numpy()
    block = group.column("block").to_numpy()
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint8).reshape(size, SLOTS)
    cell = group.column("cell")[0].as_py()
    apart = cell >> 31 != cell & ((1 << 31) - 1)  # two blocks meet, of which one may have no rows
    left, right = [], []
    for i in range(size - 1):
        j = np.arange(i + 1, size)
        near = THRESHOLD[1] * np.minimum(n[i], n[j]) >= THRESHOLD[0] * np.maximum(n[i], n[j])
        if apart:
            near &= block[j] != block[i]
        j = j[near]
        j = j[(sig[j] == sig[i]).sum(axis=1) >= LEAST_SLOTS]
        if len(j):
            left.append(np.full(len(j), i))
            right.append(j)
    if not left:
        return none, none
    i, j = np.concatenate(left), np.concatenate(right)
    own = group.column("leaves").to_pylist()
    leaf = group.column("leaf")[0].as_py()
    width = max(map(len, own))
    before = np.full((size, width), -1, dtype=np.int64)
    for k, x in enumerate(own):
        x = [y for y in x if y < leaf]
        before[k, : len(x)] = x
    first = np.ones(len(i), dtype=bool)
    for at in range(0, len(i), 4096):
        a, b = before[i[at : at + 4096]], before[j[at : at + 4096]]
        first[at : at + 4096] = ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2))
    return i[first], j[first]


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        i, j = likely(group)
        if len(i):
            yield from group.take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j)."""
    if len(i) <= 2 * len(sets) or len(sets) < 8:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    fresh = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    twice = ~(fresh & np.concatenate([fresh[1:], [True]]))  # tokens of one set only count nowhere
    tokens, owner = tokens[twice], owner[twice]
    number = np.cumsum(np.concatenate([[True], tokens[1:] != tokens[:-1]])) - 1 if len(tokens) else np.zeros(0, dtype=np.intp)
    out = np.zeros(len(i), dtype=np.int64)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, _VOCABULARY):
        lo, hi = np.searchsorted(number, [at, at + _VOCABULARY])
        width = -(-(int(number[hi - 1]) - at + 1) // 64) * 64
        present = np.zeros((len(sets), width), dtype=bool)
        present[owner[lo:hi], number[lo:hi] - at] = True
        bits = np.packbits(present, axis=1).view(np.uint64)
        for first in range(0, len(i), 2048):
            a, b = bits[i[first : first + 2048]], bits[j[first : first + 2048]]
            out[first : first + 2048] += np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rec, links and least: the links a record has in a cell, and the least record of its component there."""
    recs, links, least = [], [], []
    for group in _groups(batches):
        i, j = likely(group)
        if not len(i):
            continue
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("tokens").to_pylist()]
        n = np.array([len(s) for s in sets])
        both = shared_counts(sets, i, j)
        found = THRESHOLD[1] * both >= THRESHOLD[0] * (n[i] + n[j] - both)
        i, j = i[found], j[found]
        if not len(i):
            continue
        own = group.column("rec").to_pylist()
        counts = np.bincount(np.concatenate([i, j]), minlength=len(own))
        label = np.argsort(np.argsort(np.array(own, dtype=object), kind="stable"), kind="stable")
        while True:  # least labels within the cell
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            if (low == label).all():
                break
            label = low
        ordered = sorted(own)
        for k in np.flatnonzero(counts):
            recs.append(own[k])
            links.append(int(counts[k]))
            least.append(ordered[label[k]])
        if len(recs) > 4096:
            yield _links_batch(recs, links, least)
            recs, links, least = [], [], []
    if recs:
        yield _links_batch(recs, links, least)


def _links_batch(recs: list[bytes], links: list[int], least: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(recs, pa.binary()), pa.array(links, pa.int64()), pa.array(least, pa.binary())], names=["rec", "links", "least"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            tokens = [shingler.set(t.as_py()).tobytes() for t in part.column("text")]
            names = [x for x in part.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(x) for x in names], pa.array(tokens, pa.binary())], names=[*names, "tokens"])


_CELL = "leaf long, cell long, block int, rec binary, n long, sig binary, leaves array<long>"


def _by_cell(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return rows.repartition("leaf", "cell").sortWithinPartitions("leaf", "cell", "rec").mapInArrow(tidy(work), schema)


def links(docs: DataFrame, recs: DataFrame, n_runs: int) -> DataFrame:
    """rec, links, least for each cell in which a record has links; each link between different texts counts once."""
    members, stats = leaves(recs, n_runs)
    active = staged(_by_cell(cells(recs, members, stats), _active, _CELL))
    named = recs.select("rec", _row_key(F.col("first"), F.col("rec")).alias("key"))
    wanted = staged(active.join(named, "rec").select("key", *active.columns))
    # the same plan at every size: texts meet the records that ask for them by key, which no group of copies makes hot
    keyed = _keyed(docs).select(_row_key(F.col("doc_id"), F.col("rec")).alias("key"), "text")
    texts = keyed.join(wanted.select("key").hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    sets = texts.join(wanted.hint("merge"), "key").select(*active.columns, "text").mapInArrow(tidy(_sets), f"{_CELL}, tokens binary")
    return staged(_by_cell(sets, _linked, "rec binary, links long, least binary"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component of edges (a, b). Labels move along edges and then along labels, so the
    number of rounds grows with the logarithm of a component's diameter."""
    pairs = edges.where("a <> b").select("a", "b").distinct()
    both = staged(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        sent = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        spread = staged(sent.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")))
        up = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = staged(spread.join(up, "label", "left").select("node", F.coalesce("further", "label").alias("label")))
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old")
        done = not changed.take(1)
        labels = jumped
        if done:
            return labels


def _labelled(docs: DataFrame, recall: float) -> DataFrame:
    """rec, first, copies, n_links (null for none) and label, the least rec of its class, of each different text."""
    return scratch(lambda: _label(docs, recall))


def _label(docs: DataFrame, recall: float) -> DataFrame:
    recs = staged(records(docs))
    found = links(docs, recs, runs(recall))
    labels = components(found.select(F.col("rec").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("rec").agg(F.sum("links").alias("n_links"))
    marked = recs.select("rec", "first", "copies").join(labels.withColumnRenamed("node", "rec"), "rec", "left").join(counts, "rec", "left")
    return staged(marked.withColumn("label", F.coalesce("label", "rec")))


def classes(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, rec, class_id, n_links, n_copies for every row of docs (doc_id, text)."""
    marked = _labelled(docs, recall)
    least = staged(marked.where("n_links > 0").groupBy("label").agg(F.min("first").alias("class_id")))
    final = staged(marked.join(least, "label", "left").select("rec", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("copies").alias("n_copies")))
    own = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("rec"))
    joined = own.join(final, "rec", "left")
    return joined.select("doc_id", "rec", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def deduplicated(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """One row of docs, all columns, for each class: the one with the least doc_id, or any if all are null. Rows with a null text all stay."""
    best = F.min(F.struct(F.col("first").isNull().alias("no_id"), "first", "rec"))
    kept = _labelled(docs, recall).groupBy("label").agg(best.alias("best")).select(_row_key(F.col("best.first"), F.col("best.rec")).alias("key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), _row_key(F.col("doc_id"), F.unhex(F.md5(F.col("text").cast("binary")))).alias("key"))
    stay = rows.where("key is not null").join(kept, "key", "left_semi").dropDuplicates(["key"])
    return stay.select("row.*").unionByName(docs.where("text is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("rec")


ORACLE_SQL = f"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS rep, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT rep, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
g AS (SELECT DISTINCT rep, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WIDTH} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {WIDTH - 2}), lambda i: array_to_string(ws[i:i + {WIDTH - 1}], ' ')) END) AS s FROM w),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE {THRESHOLD[1]} * m >= {THRESHOLD[0]} * (x.n + y.n - m)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
k AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
l AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(l.n_links, 0)::BIGINT AS n_links, coalesce(t.copies, 1)::BIGINT AS n_copies
FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN k ON k.node = t.rep LEFT JOIN l ON l.rep = t.rep
"""
