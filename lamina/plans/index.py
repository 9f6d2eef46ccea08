"""From commits to the life of declarations: observe both sides of each change, match them, and follow identities along the matches.

Merges bring no changes of their own here; a history is worked off along first parents: the lineage of a path, and the commit that last changed it, are those
on the chain of a commit's first parents, and what a merge brought in was changed on its branch. All joins are by commit or by a declaration's key
(repository, lineage, name, occurrence), so a repository's history is spread over its commits and not held in one place, and repositories that
share commits or paths share nothing else. commit is the repository and the commit's id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import versions
from lamina.functions import hashing, rationale
from lamina.functions.text import subject_end
from lamina.operators import asof, evolution, lifecycle, lineage, matching
from lamina.operators.graph import chain_roots, settled
from lamina.sources import code, golden, history

STATE = "scope string, tip string, version string"
LAYERS = ("profile", "raw", "token", "alpha", "shape")


@dataclass(frozen=True)
class Index:
    revisions: DataFrame  # repo, commit, sha, topo, id, node, stable_key, lineage, name, path, and the hash vector
    matches: DataFrame  # commit, prev_id, next_id, tier, score, ambiguity_size, and both revisions: prev_node, next_node
    changes: DataFrame  # repo, commit, topo, stable_key, name, path, change_level, sig_changed
    ambiguities: DataFrame
    discontinuities: DataFrame  # repo, commit, topo, stable_key, name, path, previous_entity: a path that is taken again
    audited: DataFrame  # matches below L1 with the refused buckets that they came out of

    def entities_for(self, path: str, name: str) -> DataFrame:
        """Entities that ever were name at path, those with most revisions first."""
        own = self.revisions.groupBy("repo", "stable_key").agg(F.count("*").alias("revisions"), F.max(((F.col("path") == path) & (F.col("name") == name)).cast("int")).alias("_was"))
        return own.where("_was = 1").select("repo", "stable_key", "revisions").orderBy(F.desc("revisions"), "repo", "stable_key")

    def evolution_of(self, stable_key: str) -> DataFrame:
        """Changes of an entity with the tier and ambiguity of their matches, where it moved from, and how many others its commit really changes."""
        real = self.changes.where("change_level <> 'none'").groupBy("commit").agg(F.count_distinct("stable_key").alias("reach"))
        return self.changes.where(F.col("stable_key") == stable_key).join(real, "commit", "left").withColumn("reach", F.coalesce("reach", F.lit(0))).orderBy("repo", "topo")

    def moves(self) -> DataFrame:
        return self.changes.where("moved_from is not null")

    def survivors(self, name: str) -> DataFrame:
        """Entities called name that live on, for a verdict on one that is gone: repo, stable_key."""
        last = self.changes.groupBy("repo", "stable_key").agg(F.max_by("change_level", F.struct("topo", F.col("change_level") == "death")).alias("last"), F.max_by("name", "topo").alias("name"))
        return last.where((F.col("last") != "death") & (F.col("name") == name)).select("repo", "stable_key")

    def timeline(self, path: str, name: str) -> DataFrame:
        """Changes of every entity that ever was name at path, in order."""
        wanted = self.revisions.where((F.col("path") == path) & (F.col("name") == name)).select("stable_key").distinct()
        return self.changes.join(wanted, "stable_key", "left_semi").orderBy("stable_key", "topo")

    def churn(self) -> DataFrame:
        real = self.changes.where("change_level not in ('none', 'birth', 'death')")
        counted = real.groupBy("stable_key").agg(F.sum((F.col("change_level") == "shape").cast("bigint")).alias("structural"), F.count("*").alias("changes"), F.max_by("name", "topo").alias("name"), F.max_by("path", "topo").alias("path"))
        return counted

    def hotspots(self, limit: int = 20) -> DataFrame:
        return self.churn().orderBy(F.desc("structural"), F.desc("changes"), "stable_key").limit(limit)

    def abandoned(self, commits: DataFrame) -> DataFrame:
        """Entities that were born and removed, graded; not those whose content lives on in another entity."""
        keys = ["repo", "stable_key"]
        deaths = self.changes.where("change_level = 'death'").select(*keys, "topo")
        spans = settled(lifecycle.spans(self.revisions, deaths, keys).withColumnRenamed("stable_key", "entity"))
        ends = lifecycle.first_last(self.revisions, keys, "topo", "raw").withColumnRenamed("stable_key", "entity").drop("revisions")
        guarded = None
        for layer in ("raw", "alpha"):
            carriers = self.revisions.select("repo", F.col("stable_key").alias("entity"), F.col(layer).alias("hash")).distinct().join(spans.select("repo", "entity", "death"), ["repo", "entity"])
            last = self.revisions.groupBy("repo", F.col("stable_key").alias("entity")).agg(F.max_by(layer, "topo").alias("hash"))
            asked = spans.where("death is not null").select("repo", "entity", "death").join(last, ["repo", "entity"])
            own = lifecycle.move_guard(carriers, asked, ["repo"]).select("repo", "entity", F.col("guarded").alias(f"by_{layer}"))
            guarded = own if guarded is None else guarded.join(own, ["repo", "entity"])
        at = commits.select("repo", "topo", F.to_timestamp("committed_at").alias("at"), "message")
        lives = spans.join(ends, ["repo", "entity"]).join(guarded, ["repo", "entity"]).withColumn("guarded", F.col("by_raw") | F.col("by_alpha"))
        subject = F.substring("message", F.lit(1), subject_end(F.col("message"))).alias("message")
        lives = lives.join(at.select("repo", F.col("topo").alias("birth"), F.col("at").alias("born_at")), ["repo", "birth"]).join(at.select("repo", F.col("topo").alias("death"), F.col("at").alias("died_at"), subject), ["repo", "death"])
        return lifecycle.excursions(lives)


def _placed(df: DataFrame, *more: str) -> DataFrame:
    """sha, path, symbol and occurrence of rows with commit, path and name, and more columns."""
    occurrence = F.coalesce(F.nullif(F.split_part("name", F.lit("#"), F.lit(2)), F.lit("")).cast("int"), F.lit(0))
    return df.select(F.substring_index("commit", "@", -1).alias("sha"), "path", F.split_part("name", F.lit("#"), F.lit(1)).alias("symbol"), occurrence.alias("occurrence"), *more)


def evaluate(built: Index, commits: DataFrame, cases: DataFrame, documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """Golden cases held against an index of one repository; documents and quotes as golden.evaluate_evidence takes them."""
    ends = commits.select("topo", "sha")
    out = built.abandoned(commits).select("entity", "birth", "death", "strength")
    out = out.join(ends.select(F.col("topo").alias("birth"), F.col("sha").alias("introduce_at")), "birth").join(ends.select(F.col("topo").alias("death"), F.col("sha").alias("remove_at")), "death")
    places = _placed(built.revisions, F.col("stable_key").alias("entity")).select("entity", "path", "symbol").distinct()
    found = [_placed(built.changes, "change_level"), _placed(built.discontinuities), out.join(places, "entity"), _placed(built.revisions, "node"), built.matches]
    return golden.evaluate(cases, *found, documents, quotes)


def messages(commits: DataFrame, markdown: bool = False) -> tuple[DataFrame, DataFrame]:
    """Commit messages as documents, and the reasons that they state as quotes."""
    documents = commits.select(F.lit("commit_message").alias("doc_type"), F.col("sha").alias("external_id"), "message")
    spans = documents.select("doc_type", "external_id", F.explode(rationale.rationale_spans(F.col("message"), markdown)).alias("s"))
    return documents.drop("message"), spans.select("doc_type", "external_id", F.lit("stated").alias("tier"), "s.quoted_text")


def read_sources(specs: DataFrame, repo: str) -> DataFrame:
    """specs (sha, path) with the source of each file; null where there is none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            names = [f"{s}:{p}" for s, p in zip(frame["sha"], frame["path"], strict=True)]
            got = dict(history.read_blobs(repo, names)) if names else {}
            frame = frame[["sha", "path"]].copy()
            frame["source"] = [None if got[n] is None else got[n].decode("utf-8", "replace") for n in names]
            yield frame

    return specs.select("sha", "path").mapInPandas(read, "sha string, path string, source string")


def build(commits: DataFrame, sources: Callable[[DataFrame], DataFrame]) -> Index:
    """commits as read_history gives them; sources maps (sha, path) to (sha, path, source)."""
    supported = F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*code.EXTENSIONS)
    commit = F.concat_ws("@", "repo", "sha").alias("commit")
    changed = commits.where("not is_merge").select("repo", "sha", commit, "topo", F.get("parents", F.lit(0)).alias("parent"), F.explode("changes").alias("c"))
    changed = settled(changed.select("repo", "sha", "commit", "topo", "parent", "c.change_type", "c.path", F.coalesce("c.old_path", "c.path").alias("old_path"), "c.hunks").where(supported))
    walked = settled(lineage.build(commits).where("kind in ('before', 'after', 'recreated')").select("repo", "sha", "kind", "path", "lineage", "detail").distinct())
    after = changed.where("change_type <> 'D'").select("repo", "sha", "commit", "topo", F.col("sha").alias("at"), "path", "hunks")
    before = changed.where("change_type not in ('A', 'C') and parent is not null").select("repo", "sha", "commit", "topo", F.col("parent").alias("at"), F.col("old_path").alias("path"), F.lit(None).cast(changed.schema["hunks"].dataType).alias("hunks"))
    asked = after.select(F.col("at").alias("sha"), "path").union(before.select(F.col("at").alias("sha"), "path")).distinct()
    files = settled(sources(asked).withColumn("blob", F.sha1("source")))
    seen = settled(code.observe(files.where("source is not null")))

    def side(places: DataFrame, kind: str) -> DataFrame:
        named = places.join(walked.where(F.col("kind") == kind).drop("kind"), ["repo", "sha", "path"])
        rows = named.join(files.select(F.col("sha").alias("at"), "path", "blob"), ["at", "path"]).join(seen, "blob")
        key = F.concat_ws("\x1f", "repo", F.coalesce(F.col("lineage").cast("string"), F.lit("")), "name", F.col("occurrence").cast("string"))
        return settled(rows.withColumn("id", key).withColumn("name", F.concat_ws("#", "name", F.nullif(F.col("occurrence").cast("string"), F.lit("0")))))

    prev, next = side(before, "before"), side(after, "after")
    matches, refused = matching.ladder(prev.drop("hunks"), next)
    matches = settled(matches)

    node = F.concat_ws("@", "commit", "id")
    revisions = next.select("repo", "commit", "sha", "topo", "id", node.alias("node"), "lineage", "name", "path", "signature", *LAYERS)
    # a record before a change was last seen where its file was last changed; or, if a merge itself changed it, where its key was seen last
    was = prev.select("repo", "commit", F.col("id").alias("prev_id"), F.col("topo"), F.concat_ws("@", "repo", "detail", "id").alias("expected"))
    known = was.join(revisions.select(F.col("node").alias("expected"), F.col("node").alias("found")), "expected", "left")
    last = revisions.select(F.col("id").alias("prev_id"), F.col("topo").alias("seen_topo"), F.col("node").alias("seen"))
    known = settled(asof.asof_join(known, last, ["prev_id"], "topo", "seen_topo", ["seen"]).select("commit", "prev_id", F.coalesce("found", "asof_seen").alias("before_node")))
    linked = revisions.join(matches.select("commit", F.col("next_id").alias("id"), "prev_id"), ["commit", "id"], "left").join(known, ["commit", "prev_id"], "left")
    roots = chain_roots(linked.select("node", F.col("before_node").alias("prev")))
    born = revisions.select(F.col("node").alias("root"), hashing.stable_key(F.col("sha"), F.col("path"), F.col("name")).alias("stable_key"))
    revisions = settled(revisions.join(roots.select("node", "root"), "node").join(born, "root").drop("root"))

    both = revisions.join(matches.select("commit", F.col("next_id").alias("id"), "prev_id", "tier", "ambiguity_size"), ["commit", "id"], "left")
    old = prev.select("commit", F.col("id").alias("prev_id"), F.col("path").alias("old_path"), F.col("signature").alias("old_signature"), *[F.col(k).alias(f"old_{k}") for k in LAYERS])
    compared = both.join(old, ["commit", "prev_id"], "left")
    level = F.when(F.col("prev_id").isNull(), "birth").otherwise(hashing.change_level({k: F.col(f"old_{k}") for k in LAYERS}, {k: F.col(k) for k in LAYERS}))
    lived = compared.select("repo", "commit", "topo", "stable_key", "name", "path", level.alias("change_level"), (F.col("signature") != F.col("old_signature")).alias("sig_changed"), "tier", "ambiguity_size", F.when(F.col("old_path") != F.col("path"), F.col("old_path")).alias("moved_from"))
    gone = prev.join(matches.select("commit", F.col("prev_id").alias("id")), ["commit", "id"], "left_anti").select("repo", "commit", "topo", F.col("id").alias("prev_id"), "name", "path")
    whose = revisions.select(F.col("node").alias("before_node"), "stable_key")
    died = gone.join(known, ["commit", "prev_id"]).join(whose, "before_node").select("repo", "commit", "topo", "stable_key", "name", "path", F.lit("death").alias("change_level"), F.lit(None).cast("boolean").alias("sig_changed"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("bigint").alias("ambiguity_size"), F.lit(None).cast("string").alias("moved_from"))
    changes = settled(lived.unionByName(died))
    # a path that is taken again: who was there when its last lineage was removed
    taken = walked.where("kind = 'recreated'").select("repo", "sha", "path", F.concat_ws("/", "repo", F.col("lineage").cast("string")).alias("previous_key"))
    fresh = revisions.join(taken, ["repo", "sha", "path"]).select("repo", "commit", "topo", "stable_key", "name", "path", "previous_key")
    key = F.concat_ws("/", "repo", F.col("lineage").cast("string")).alias("key")
    ended = revisions.groupBy(key).agg(F.max("topo").alias("topo"))
    occupants = revisions.select(key, "topo", "name", F.col("stable_key").alias("entity")).join(ended, ["key", "topo"])
    discontinuities = evolution.resurrected(fresh, occupants).drop("previous_key")
    both_ends = matches.join(known.withColumnRenamed("before_node", "prev_node"), ["commit", "prev_id"], "left").withColumn("next_node", F.concat_ws("@", "commit", "next_id"))
    return Index(revisions, settled(both_ends), changes, refused, settled(discontinuities), matching.audit(prev, next, matches, refused))


def index_repository(spark: SparkSession, repo: str, until: str = "HEAD") -> tuple[Index, DataFrame]:
    commits = settled(history.read_history(spark, repo, until))
    return build(commits, lambda specs: read_sources(specs, repo)), commits


def save(built: Index, commits: DataFrame, root: str, tip: str) -> None:
    """The tables of an index of a repository's whole history up to tip. Its state is removed first and written last: an index is there as a whole or not at all."""
    spark = commits.sparkSession
    spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{root}/state")
    for name, df in {**{f.name: getattr(built, f.name) for f in fields(built)}, "commits": commits}.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    spark.createDataFrame([("repository", tip, versions.index_version())], STATE).coalesce(1).write.mode("overwrite").parquet(f"{root}/state")


def load(spark: SparkSession, root: str, tip: str) -> tuple[Index, DataFrame] | None:
    """The stored index, None where there is none or it ends elsewhere; one that another version wrote is refused."""
    try:
        state = spark.read.schema(STATE).parquet(f"{root}/state").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if state is None:
        return None
    versions.require(state["version"], versions.index_version(), f"the index in {root}")
    if (state["scope"], state["tip"]) != ("repository", tip):
        return None
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in [*(f.name for f in fields(Index)), "commits"]}
    commits = tables.pop("commits")
    return Index(**tables), commits


def indexed(spark: SparkSession, repo: str, root: str | None, until: str = "HEAD") -> tuple[Index, DataFrame]:
    """The index of a repository from root if it ends at the same commit; else it is built, and stored there."""
    if root is None:
        return index_repository(spark, repo, until)
    tip = history.tip(repo, until)
    if found := load(spark, root, tip):
        return found
    built, commits = index_repository(spark, repo, tip)
    save(built, commits, root, tip)
    return load(spark, root, tip)
