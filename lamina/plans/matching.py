"""Queries that match records of two sides, and follow what is matched from birth to death."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.functions import hashing, sketch, text
from lamina.operators import asof, graph, lifecycle, matching
from lamina.plans.records import _CHANGES_SQL
from lamina.sources import tables

GRAM_LIST = r"[\x20\x09-\x0D]+"


def words(column: str = "text") -> Column:
    return F.filter(F.split(F.lower(column), GRAM_LIST), lambda w: w != "")


def _sides(spark: SparkSession, d: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """Documents with an even id as the version before, with an odd one as the version after; a language is a commit."""
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("commit"), key.alias("key"))
    return docs.where("id % 2 = 0"), docs.where("id % 2 = 1")


def bucket_unique_match(spark: SparkSession, d: str) -> DataFrame:
    prev, next = _sides(spark, d, hashing.sha(F.col("text")))
    return matching.unique_matches(prev, next, ["commit", "key"]).select("commit", "prev_id", "next_id")


def bucket_ambiguities(spark: SparkSession, d: str) -> DataFrame:
    prev, next = _sides(spark, d, hashing.sha(F.col("text")))
    return matching.ambiguous(prev, next, ["commit", "key"])


def match_l3_normalised(spark: SparkSession, d: str) -> DataFrame:
    prev, next = _sides(spark, d, hashing.sha(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")))
    return matching.unique_matches(prev, next, ["commit", "key"]).select("commit", "prev_id", "next_id")


def _gram_sets(spark: SparkSession, d: str) -> DataFrame:
    """Different texts as sets of word 3-grams, hashed to 64 bits; equal texts are one set with the least id."""
    texts = tables.read(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("id"))
    grams = F.transform(sketch.gram_texts(words()), lambda g: F.xxhash64(g))
    return texts.where("text is not null").select("id", F.array_distinct(grams).alias("grams"))


def ngram_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    sets = graph.settled(_gram_sets(spark, d))
    return matching.similar_pairs(sets, sets, 0.7, same_side=True).select("left_id", "right_id", "shared", F.round("score", 6).alias("score"))


def greedy_similarity_match(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    sets = docs.select("id", sketch.hashed_grams(words()).alias("grams"))
    digests = graph.settled(docs.select("id", F.unhex(F.sha2("text", 256)).alias("digest")))
    first = digests.groupBy("digest").agg(F.min("id").alias("first"))
    copies = graph.settled(digests.join(first, "digest").where("id <> first").select("id"))
    pairs = matching.similar_sets(sets, 0.5, F.col("id") % 2 == 0, F.col("id") % 2 == 1, copies)
    chosen = matching.greedy_pairs(pairs.select(F.col("left_id").alias("prev_id"), F.col("right_id").alias("next_id"), "score"))
    return chosen.select("prev_id", "next_id", F.round("score", 6).alias("score"), "ambiguity_size")


def benchmark_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of the 3-grams of a benchmark item."""
    docs = tables.read(spark, d, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    items = tables.read(spark, d, "benchmark").select("item_id", F.array_distinct(sketch.gram_texts(words())).alias("grams"))
    own = items.select("item_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    rows = docs.select("doc_id", "copies", F.explode(F.array_distinct(sketch.gram_texts(words()))).alias("gram"))
    shared = rows.join(own, "gram").groupBy("doc_id", "copies", "item_id", "n").agg(F.count("*").alias("shared"))
    return shared.where("shared * 2 >= n").select("doc_id", "item_id", "shared", "copies")


_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _ladder_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each turn as it is, and as one of six things happened to it: nothing, a new name, wider blanks, capitals, more words, or another text."""
    t = tables.read(spark, d, "conversations").withColumn("name", F.concat_ws("#", "role", "turn"))
    k = (F.col("conv_id") + F.col("turn")) % 6
    after = F.when(k == 2, F.replace("text", F.lit(" "), F.lit("  "))).when(k == 3, F.translate("text", _SMALL, _LARGE)).when(k == 4, F.concat("text", F.lit(" one two three"))).when(k == 5, F.lit("gone")).otherwise(F.col("text"))
    changed = t.withColumns({"text": after, "name": F.when(k == 0, F.col("name")).otherwise(F.concat(F.lit("n"), "turn"))})
    return _ladder_rows(t).drop("hunks"), _ladder_rows(changed)


def _ladder_rows(t: DataFrame) -> DataFrame:
    own = words()
    return t.select(
        F.col("conv_id").alias("commit"), (F.col("turn") * 3 + F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)).alias("id"), "name", F.lit(1).alias("lineage"), F.lit("turn").alias("kind"), F.lit("text").alias("profile"),
        hashing.sha(F.col("text")).alias("raw"), hashing.sha(F.array_join(F.split("text", GRAM_LIST), " ")).alias("token"), hashing.sha(F.array_join(own, " ")).alias("alpha"), hashing.sha(F.array_join(own, " ")).alias("alpha_self"), F.size(own).alias("node_count"),
        (F.col("turn") + 1).cast("bigint").alias("start_line"), (F.col("turn") + 1).cast("bigint").alias("end_line"), F.transform(sketch.gram_texts(own), lambda g: F.xxhash64(g)).alias("grams"), F.lit(None).cast("array<struct<old_start:bigint,old_count:bigint,new_start:bigint,new_count:bigint>>").alias("hunks"),
    )

def full_ladder(spark: SparkSession, d: str) -> DataFrame:
    prev, next = _ladder_sides(spark, d)
    found, _ = matching.ladder(graph.settled(prev), graph.settled(next))
    return found.select("commit", "prev_id", "next_id", "tier", F.round("score", 6).alias("score"), "ambiguity_size")


def ladder_stats(spark: SparkSession, d: str) -> DataFrame:
    prev, next = _ladder_sides(spark, d)
    found, _ = matching.ladder(graph.settled(prev), graph.settled(next))
    stats = found.groupBy("tier").agg(F.count("*").alias("matches"), F.sum((F.col("ambiguity_size") > 1).cast("bigint")).alias("ambiguous"), F.sum(F.col("score").isNotNull().cast("bigint")).alias("verified"))
    return stats.withColumn("meaning", text.ambiguity_meaning(F.col("tier"))).withColumn("verified", F.when(F.col("tier").isin("L4", "L5"), F.col("verified")))


def ladder_audit(spark: SparkSession, d: str) -> DataFrame:
    """Matches below L1, and how many refused buckets each came out of."""
    prev, next = map(graph.settled, _ladder_sides(spark, d))
    audited = matching.audit(prev, next, *map(graph.settled, matching.ladder(prev, next)))
    return audited.select("commit", "prev_id", "next_id", "tier", F.size("origins").cast("bigint").alias("origins"))


def _lives(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities of the event stream: a death event removes one, any other event is a revision. Carried content is the event's kind and whole value."""
    c = tables.event_changes(spark, d).withColumn("raw", F.concat_ws(":", "name", F.floor("value").cast("string")))
    return c.where("change_level <> 'death'"), c.where("change_level = 'death'")


def birth_death_spans(spark: SparkSession, d: str) -> DataFrame:
    revisions, deaths = _lives(spark, d)
    return lifecycle.spans(revisions, deaths, ["entity"])


def move_guard(spark: SparkSession, d: str) -> DataFrame:
    revisions, deaths = _lives(spark, d)
    spans = graph.settled(lifecycle.spans(revisions, deaths, ["entity"]))
    last = lifecycle.first_last(revisions, ["entity"], "topo", "raw").select("entity", F.col("last_raw").alias("hash"))
    carriers = revisions.select("entity", F.col("raw").alias("hash")).distinct().join(spans.select("entity", "death"), "entity")
    candidates = spans.where("death is not null").select("entity", "death").join(last, "entity")
    return lifecycle.move_guard(carriers.withColumn("repo", F.lit(1)), candidates.withColumn("repo", F.lit(1)), ["repo"]).select("entity", F.col("guarded").cast("bigint").alias("guarded"))


def _excursions(spark: SparkSession, d: str) -> DataFrame:
    revisions, deaths = _lives(spark, d)
    spans = graph.settled(lifecycle.spans(revisions, deaths, ["entity"]))
    times = tables.event_changes(spark, d).select("topo", "at", "k")
    ends = lifecycle.first_last(revisions, ["entity"], "topo", "raw").drop("revisions")
    lives = spans.join(ends, "entity").join(times.select(F.col("topo").alias("birth"), F.col("at").alias("born_at")), "birth").join(times.select(F.col("topo").alias("death"), F.col("at").alias("died_at"), "k"), "death")
    message = F.when(F.col("k") % 5 == 0, F.lit('Revert "step"')).otherwise(F.lit("drop step"))
    return lifecycle.excursions(lives.withColumn("message", message).withColumn("guarded", F.lit(False)))


def excursion_graded(spark: SparkSession, d: str) -> DataFrame:
    return _excursions(spark, d).withColumn("duration_days", F.round("duration_days", 6))


def abandoned_strength_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _excursions(spark, d).rollup("strength", "method").agg(F.count("*").alias("excursions"))


def abandoned_list(spark: SparkSession, d: str, strength: str | None = None) -> DataFrame:
    """The removed entities with the record that each had last."""
    found = _excursions(spark, d)
    found = found if strength is None else found.where(F.col("strength") == strength)
    revisions, _ = _lives(spark, d)
    latest = asof.latest_by(revisions, ["entity"], ["topo"], ["topo", "name", "raw"])
    return found.join(latest, "entity").select("entity", "strength", "method", F.col("topo").alias("last_topo"), F.col("name").alias("last_name"), F.col("raw").alias("last_raw"))


def surviving_namesakes(spark: SparkSession, d: str) -> DataFrame:
    """For each removed entity, how many others of its user live on."""
    revisions, deaths = _lives(spark, d)
    spans = lifecycle.spans(revisions, deaths, ["entity"]).withColumn("user", F.split("entity", "/")[0])
    counts = spans.groupBy("user").agg(F.sum(F.col("death").isNull().cast("bigint")).alias("alive"))
    return spans.where("death is not null").join(counts, "user").select("entity", "alive")


def discontinuity_occupant(spark: SparkSession, d: str) -> DataFrame:
    """Turns that replace the same role's turn before without being alike; a missing side is no evidence."""
    t = tables.turns(spark, d)
    grams = lambda c: F.transform(sketch.gram_texts(F.filter(F.split(c, GRAM_LIST), lambda w: w != "")), lambda g: F.xxhash64(g))
    similarity = F.when(F.col("prev").isNotNull(), sketch.exact_jaccard(F.array_distinct(grams(F.col("alpha"))), F.array_distinct(grams(F.col("prev.alpha")))))
    pairs = t.select("conv_id", "role", "turn", F.col("prev.turn").alias("prev_turn"), similarity.alias("similarity"))
    return lifecycle.replaced(pairs).withColumn("similarity", F.round("similarity", 6))


def resurrections(spark: SparkSession, d: str) -> DataFrame:
    c = tables.event_changes(spark, d).withColumn("kind", F.when(F.col("change_level") == "death", "D").when(F.col("change_level") == "alpha", "A").otherwise("M"))
    return graph.resurrections(c, ["lineage"], ["topo"], "kind").select("lineage", "topo")


def format_only_changes(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation, the share of changed lines that vanishes without white space and case, where over 0.2."""
    t = tables.turns(spark, d).where("prev is not null")
    bare = lambda c: F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(F.lower(x), "[^a-z]+", ""))
    changed = F.size(F.array_except(F.split("raw", "\n", -1), F.split("prev.raw", "\n", -1)))
    real = F.size(F.array_except(bare(F.col("raw")), bare(F.col("prev.raw"))))
    per = t.groupBy("conv_id").agg(F.sum(changed).alias("lines"), F.sum(real).alias("real_lines"))
    return per.where("lines > 0").select("conv_id", "lines", "real_lines", F.round(1 - F.col("real_lines") / F.col("lines"), 6).alias("collapse"))


def content_distances(spark: SparkSession, d: str) -> DataFrame:
    """Events between a record and the next record of its entity."""
    c = tables.event_changes(spark, d)
    return c.select("topo", (F.lead("topo").over(W.partitionBy("entity").orderBy("topo")) - F.col("topo")).alias("gap"))


QUERIES = {
    "bucket_unique_match": bucket_unique_match, "bucket_ambiguities": bucket_ambiguities, "match_l3_normalised": match_l3_normalised, "ngram_jaccard_pairs": ngram_jaccard_pairs, "greedy_similarity_match": greedy_similarity_match, "benchmark_contamination": benchmark_contamination, "full_ladder_conversations": full_ladder, "ladder_stats": ladder_stats, "ladder_audit": ladder_audit,
    "birth_death_spans": birth_death_spans, "move_guard": move_guard, "excursion_graded": excursion_graded, "abandoned_strength_histogram": abandoned_strength_histogram, "abandoned_list": abandoned_list, "surviving_namesakes": surviving_namesakes, "discontinuity_occupant": discontinuity_occupant, "resurrections": resurrections, "format_only_changes": format_only_changes, "content_distances": content_distances,
}


def _side_sql(key: str) -> str:
    return f"s AS (SELECT doc_id AS id, coalesce(lang, '') AS commit, {key} AS key FROM documents), p AS (SELECT commit, key, count(*) AS n, min(id) AS id FROM s WHERE id % 2 = 0 GROUP BY 1, 2), q AS (SELECT commit, key, count(*) AS n, min(id) AS id FROM s WHERE id % 2 = 1 GROUP BY 1, 2)"


_WS = "list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _grams_sql(ws: str) -> str:
    return f"CASE WHEN len({ws}) = 0 THEN [] WHEN len({ws}) < 3 THEN [array_to_string({ws}, chr(30))] ELSE list_distinct(list_transform(range(1, len({ws}) - 1), lambda i: array_to_string({ws}[i:i + 2], chr(30)))) END"


_LIFE_SQL = f"""WITH {_CHANGES_SQL}, x AS (SELECT *, name || ':' || floor(value)::BIGINT::VARCHAR AS raw FROM c),
rv AS (SELECT entity, min(topo) AS birth, max(topo) AS last_revision, count(*) AS revisions, arg_min(raw, topo) AS first_raw, arg_max(raw, topo) AS last_raw FROM x WHERE change_level <> 'death' GROUP BY 1),
dd AS (SELECT entity, max(topo) AS last_death FROM x WHERE change_level = 'death' GROUP BY 1),
sp AS (SELECT rv.*, CASE WHEN last_death > last_revision THEN last_death END AS death FROM rv LEFT JOIN dd USING (entity)),
ex AS (SELECT sp.entity, birth, death, CASE WHEN y.k % 5 = 0 OR first_raw = last_raw THEN 'A' ELSE 'C' END AS strength,
  CASE WHEN y.k % 5 = 0 THEN 'git_revert' WHEN first_raw = last_raw THEN 'inverse_diff' WHEN revisions <= 1 THEN 'short_lifecycle' ELSE 'trajectory' END AS method,
  round(greatest(0, (epoch_us(y.at_ts) - epoch_us(b.at_ts)) / 86400000000.0), 6) AS duration_days, last_revision, last_raw FROM sp JOIN x b ON b.topo = birth JOIN x y ON y.topo = death WHERE death IS NOT NULL AND birth <> death)"""

def _greedy_sql(pairs: str) -> str:
    """Takes the best pair that is still free again and again, from pairs (commit, prev_id, next_id, score): a recursion over each commit's pairs in
    order, which carries the ends already taken."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY commit ORDER BY score DESC, prev_id, next_id) AS i, list(prev_id) OVER (PARTITION BY commit, next_id, score) AS rivals FROM {pairs}),
    st AS (SELECT commit, 0::BIGINT AS i, []::BIGINT[] AS ps, []::BIGINT[] AS ns, NULL::BIGINT AS prev_id, NULL::BIGINT AS next_id, NULL::DOUBLE AS score, 0::BIGINT AS ambiguity_size, false AS took FROM (SELECT DISTINCT commit FROM o)
        UNION ALL SELECT o.commit, o.i, CASE WHEN f THEN list_append(ps, o.prev_id) ELSE ps END, CASE WHEN f THEN list_append(ns, o.next_id) ELSE ns END, o.prev_id, o.next_id, o.score, len(list_filter(o.rivals, lambda x: NOT list_contains(ps, x)))::BIGINT, f
        FROM (SELECT st.commit AS c, st.i AS k, ps, ns FROM st) s JOIN (SELECT * FROM o) o ON o.commit = s.c AND o.i = s.k + 1, LATERAL (SELECT NOT list_contains(ps, o.prev_id) AND NOT list_contains(ns, o.next_id) AS f)),
    gr AS (SELECT commit, prev_id, next_id, score, ambiguity_size FROM st WHERE took)"""


def _tier_sql(k: int, key: str, where: str = "true") -> str:
    """What tier k matches of p and n, one to one by key, and what it leaves."""
    one = "(SELECT commit, {0} AS key, min(id) AS id FROM {1}{2} WHERE {0} IS NOT NULL AND {3} GROUP BY 1, 2 HAVING count(*) = 1)"
    left = "{0}{1} AS (SELECT * FROM {0}{2} x WHERE NOT EXISTS (SELECT 1 FROM m{1} m WHERE m.commit = x.commit AND m.{3}_id = x.id))"
    return f"""m{k} AS (SELECT a.commit, a.id AS prev_id, b.id AS next_id FROM {one.format(key, "p", k - 1, where)} a JOIN {one.format(key, "n", k - 1, where)} b USING (commit, key)),
    {left.format("p", k, k - 1, "prev")}, {left.format("n", k, k - 1, "next")}"""


def _origin_sql(k: int, key: str, later: str, where: str = "true") -> str:
    """Matches of later tiers whose ends shared a key of tier k that wasn't one to one."""
    bucket = f"(SELECT commit, {key} AS key, count(*) AS n FROM {{0}}{k - 1} WHERE {key} IS NOT NULL AND {where} GROUP BY 1, 2)"
    ends = " ".join(f"JOIN (SELECT commit AS c, id, {key} AS key FROM {s}{k - 1} WHERE {where}) {s} ON {s}.c = l.commit AND {s}.id = l.{side}_id" for s, side in (("p", "prev"), ("n", "next")))
    return f"""SELECT l.commit, l.prev_id, l.next_id FROM ld l {ends} JOIN {bucket.format("p")} x ON x.commit = l.commit AND x.key = p.key JOIN {bucket.format("n")} y ON y.commit = l.commit AND y.key = p.key
        WHERE p.key = n.key AND x.n + y.n > 2 AND l.tier IN {later}"""


_LADDER_SQL = f"""WITH RECURSIVE sd AS (SELECT conv_id, turn, role, false AS later, role || '#' || turn AS name, text FROM conversations UNION ALL
        SELECT conv_id, turn, role, true, CASE WHEN (conv_id + turn) % 6 = 0 THEN role || '#' || turn ELSE 'n' || turn END,
        CASE (conv_id + turn) % 6 WHEN 2 THEN replace(text, ' ', '  ') WHEN 3 THEN translate(text, '{_SMALL}', '{_LARGE}') WHEN 4 THEN text || ' one two three' WHEN 5 THEN 'gone' ELSE text END FROM conversations),
    tx AS (SELECT *, {_WS} AS ws FROM sd),
    rw AS (SELECT conv_id AS commit, later, turn * 3 + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS id, name, text AS raw, array_to_string(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), ' ') AS token, array_to_string(ws, ' ') AS alpha, len(ws) AS size, {_grams_sql("ws")} AS g FROM tx),
    p0 AS (SELECT * FROM rw WHERE NOT later), n0 AS (SELECT * FROM rw WHERE later),
    {_tier_sql(1, "name")}, {_tier_sql(2, "raw")}, {_tier_sql(3, "token")}, {_tier_sql(4, "alpha")}, {_tier_sql(5, "alpha", f"size >= {matching.LEAST_NODES}")},
    sc AS (SELECT commit, a.id AS prev_id, b.id AS next_id, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) AS sizes FROM p5 a JOIN n5 b USING (commit)),
    pr AS (SELECT commit, prev_id, next_id, shared / (sizes - shared)::DOUBLE AS score FROM sc WHERE shared > 0 AND shared / (sizes - shared)::DOUBLE >= {matching.SAME_FILE}),
    {_greedy_sql("pr")},
    ld AS ({" UNION ALL ".join(f"SELECT commit, prev_id, next_id, '{t}' AS tier, NULL::DOUBLE AS score, 1::BIGINT AS ambiguity_size FROM m{k}" for k, t in enumerate(("L1", "L2", "L2", "L3", "L3b"), 1))} UNION ALL SELECT commit, prev_id, next_id, 'L4', round(score, 6), ambiguity_size FROM gr)"""

ORACLE_SQL = {
    "bucket_unique_match": f"WITH {_side_sql('sha256(text)')} SELECT commit, p.id AS prev_id, q.id AS next_id FROM p JOIN q USING (commit, key) WHERE p.n = 1 AND q.n = 1",
    "bucket_ambiguities": f"WITH {_side_sql('sha256(text)')} SELECT commit, key, p.n AS prev_count, q.n AS next_count FROM p JOIN q USING (commit, key) WHERE p.n > 1 OR q.n > 1",
    "match_l3_normalised": "WITH " + _side_sql("regexp_replace(lower(text), '[^a-z]+', ' ', 'g')") + " SELECT commit, p.id AS prev_id, q.id AS next_id FROM p JOIN q USING (commit, key) WHERE p.n = 1 AND q.n = 1",
    "ngram_jaccard_pairs": f"""WITH t AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text), w AS (SELECT id, {_WS} AS ws FROM t), g AS (SELECT id, unnest({_grams_sql("ws")}) AS g FROM w), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
        c AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
        SELECT left_id, right_id, shared, round(shared / (x.n + y.n - shared)::DOUBLE, 6) AS score FROM c JOIN n x ON x.id = left_id JOIN n y ON y.id = right_id WHERE shared / (x.n + y.n - shared)::DOUBLE >= 0.7""",
    "greedy_similarity_match": f"""WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text), w AS (SELECT id, {_WS} AS ws FROM t), g AS (SELECT id, unnest({_grams_sql("ws")}) AS g FROM w), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
        c AS (SELECT a.id AS prev_id, b.id AS next_id, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1, 2),
        pr AS (SELECT 0 AS commit, prev_id, next_id, shared / (x.n + y.n - shared)::DOUBLE AS score FROM c JOIN n x ON x.id = prev_id JOIN n y ON y.id = next_id WHERE shared / (x.n + y.n - shared)::DOUBLE >= 0.5),
        {_greedy_sql("pr")} SELECT prev_id, next_id, round(score, 6) AS score, ambiguity_size FROM gr""",
    "full_ladder_conversations": _LADDER_SQL + " SELECT commit, prev_id, next_id, tier, score, ambiguity_size FROM ld",
    "ladder_audit": _LADDER_SQL + f""", og AS ({_origin_sql(1, "name", "('L2', 'L3', 'L3b', 'L4')")} UNION ALL {_origin_sql(2, "raw", "('L3', 'L3b', 'L4')")} UNION ALL {_origin_sql(3, "token", "('L3', 'L3b', 'L4')")} UNION ALL {_origin_sql(4, "alpha", "('L3b', 'L4')")} UNION ALL {_origin_sql(5, "alpha", "('L4')", f"size >= {matching.LEAST_NODES}")}),
        oc AS (SELECT commit, prev_id, next_id, count(*) AS n FROM og GROUP BY 1, 2, 3) SELECT commit, prev_id, next_id, tier, coalesce(n, 0) AS origins FROM ld LEFT JOIN oc USING (commit, prev_id, next_id) WHERE tier <> 'L1'""",
    "ladder_stats": _LADDER_SQL + """ SELECT tier, count(*) AS matches, count(*) FILTER (ambiguity_size > 1)::BIGINT AS ambiguous, CASE WHEN tier = 'L4' THEN count(score)::BIGINT END AS verified, CASE WHEN tier = 'L4' THEN 'tied-candidates' ELSE 'unique-by-construction' END AS meaning FROM ld GROUP BY tier""",
    "benchmark_contamination": f"""WITH t AS (SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text), w AS (SELECT doc_id, copies, {_WS} AS ws FROM t), g AS (SELECT doc_id, copies, unnest({_grams_sql("ws")}) AS g FROM w),
        iw AS (SELECT item_id, {_WS} AS ws FROM benchmark), ig AS (SELECT item_id, unnest({_grams_sql("ws")}) AS g FROM iw), n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1)
        SELECT doc_id, item_id, count(*) AS shared, copies FROM g JOIN ig USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, copies, n HAVING count(*) * 2 >= n""",
    "birth_death_spans": _LIFE_SQL + " SELECT entity, birth, last_revision, revisions, death FROM sp",
    "move_guard": _LIFE_SQL + """, ca AS (SELECT DISTINCT x.entity, x.raw, sp.death FROM x JOIN sp USING (entity) WHERE change_level <> 'death')
        SELECT s.entity, CASE WHEN EXISTS (SELECT 1 FROM ca WHERE ca.raw = s.last_raw AND ca.entity <> s.entity AND (ca.death IS NULL OR ca.death > s.death)) THEN 1 ELSE 0 END::BIGINT AS guarded FROM sp s WHERE death IS NOT NULL""",
    "excursion_graded": _LIFE_SQL + " SELECT entity, birth, death, strength, method, duration_days FROM ex",
    "abandoned_strength_histogram": _LIFE_SQL + " SELECT strength, method, count(*) AS excursions FROM ex GROUP BY ROLLUP (strength, method)",
    "abandoned_list": _LIFE_SQL + " SELECT ex.entity, strength, method, last_revision AS last_topo, x.name AS last_name, ex.last_raw FROM ex JOIN x ON x.topo = ex.last_revision",
    "surviving_namesakes": _LIFE_SQL + ", u AS (SELECT split_part(entity, '/', 1) AS usr, count(*) FILTER (death IS NULL) AS alive FROM sp GROUP BY 1) SELECT entity, alive FROM sp JOIN u ON u.usr = split_part(entity, '/', 1) WHERE death IS NOT NULL",
    "discontinuity_occupant": f"""WITH b AS (SELECT conv_id, role, turn, lag(turn) OVER w AS prev_turn, text, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn, text)),
        s AS (SELECT conv_id, role, turn, prev_turn, {_WS} AS a, {_WS.replace("text", "before")} AS p FROM b WHERE prev_turn IS NOT NULL), g AS (SELECT conv_id, role, turn, prev_turn, {_grams_sql("a")} AS a, {_grams_sql("p")} AS p FROM s),
        j AS (SELECT conv_id, role, turn, prev_turn, CASE WHEN len(a) + len(p) = 0 THEN 1.0 ELSE len(list_intersect(a, p)) / (len(a) + len(p) - len(list_intersect(a, p)))::DOUBLE END AS similarity FROM g)
        SELECT conv_id, role, turn, prev_turn, round(similarity, 6) AS similarity FROM j WHERE similarity <= 0.25""",
    "resurrections": f"WITH {_CHANGES_SQL}, k AS (SELECT lineage, topo, change_level, lag(change_level) OVER (PARTITION BY lineage ORDER BY topo) AS b FROM c) SELECT lineage, topo FROM k WHERE change_level = 'alpha' AND b = 'death'",
    "format_only_changes": """WITH b AS (SELECT conv_id, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS before FROM conversations),
        l AS (SELECT conv_id, list_distinct(string_split(text, chr(10))) AS a, string_split(before, chr(10)) AS p FROM b WHERE before IS NOT NULL),
        m AS (SELECT conv_id, len(list_filter(a, lambda x: NOT list_contains(p, x))) AS lines, len(list_filter(list_distinct(list_transform(a, lambda x: regexp_replace(lower(x), '[^a-z]+', '', 'g'))), lambda x: NOT list_contains(list_transform(p, lambda y: regexp_replace(lower(y), '[^a-z]+', '', 'g')), x))) AS real_lines FROM l),
        t AS (SELECT conv_id, sum(lines)::BIGINT AS lines, sum(real_lines)::BIGINT AS real_lines FROM m GROUP BY 1) SELECT conv_id, lines, real_lines, round(1 - real_lines / lines::DOUBLE, 6) AS collapse FROM t WHERE lines > 0""",
    "content_distances": f"WITH {_CHANGES_SQL} SELECT topo, lead(topo) OVER (PARTITION BY entity ORDER BY topo) - topo AS gap FROM c",
}
