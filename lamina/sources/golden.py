"""Golden cases: expectations about a history, from YAML, held against the engine's tables.

Every case is named by git coordinates only: commits, paths, symbols, occurrences. It passes, fails, or is missing where the history doesn't cover what
it asks about. A case without a field that its kind needs is a broken file and not a missing one: reading it raises."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.schemas import TIERS

_ANCHOR = "struct<sha:string,path:string,symbol:string,occurrence:int>"
CASES = (
    "fixture string, id string, kind string, difficulty string, confidence string, polarity string, expect string, path string, symbol string, at_commit string, introduce_at string, remove_at string, strength string, "
    f"steps array<struct<alternative:int,step:int,prev:{_ANCHOR},next:{_ANCHOR},tier:string>>, doc_type string, doc_id string, spans array<struct<contains:string,tier:string>>"
)
STRENGTHS = ("A", "B", "C")
NEEDS = {
    "change_level": ("expect", "path", "symbol", "at_commit"),
    "discontinuity": ("expect", "path", "symbol", "at_commit"),
    "excursion": ("path", "symbol", "introduce_at", "remove_at"),
    "lineage": ("steps",),
    "evidence": ("doc_id",),
}
_CASE = ("fixture", "id", "kind", "difficulty", "confidence", "polarity")


class BrokenCase(ValueError):
    """A case that lacks what its kind needs."""


def _polarity(kind: str, expect: Any, spans: list) -> str:
    if expect == "absent" or (kind == "evidence" and not spans):
        return "negative"
    return "neutral" if kind == "change_level" else "positive"


def _steps(case: dict) -> list[dict]:
    """Neighbouring anchors of the chain, or of each chain that is accepted."""
    chains = [a["chain"] for a in case.get("accept_any_of") or []] or [case.get("chain") or []]
    out = []
    for k, chain in enumerate(chains):
        anchors = []
        for link in chain:
            a = link.get("anchor") or {}
            if missing := [f for f in ("commit", "path", "symbol") if not a.get(f)]:
                raise BrokenCase(f"{case['id']}: an anchor has no {missing[0]}")
            anchors.append({"sha": str(a["commit"]), "path": a["path"], "symbol": a["symbol"], "occurrence": a.get("occurrence") or 0})
        tiers = [(link.get("transition") or {}).get("expect_tier_at_most") for link in chain]
        out += [{"alternative": k, "step": s, "prev": anchors[s - 1], "next": anchors[s], "tier": tiers[s]} for s in range(1, len(anchors))]
    return out


def _row(fixture: str, case: dict) -> dict:
    place = case.get("entity") or case.get("slot") or {}
    spans = case.get("expect_spans") or []
    source = (spans[0].get("source") if spans else None) or {}
    row = {k: case.get(k) for k in ("id", "kind", "difficulty", "at_commit", "introduce_at", "remove_at")} | {"fixture": fixture, "path": place.get("path"), "symbol": place.get("symbol")}
    row |= {"confidence": case.get("label_confidence"), "expect": case.get("expect"), "strength": case.get("expect_strength_at_least"), "polarity": _polarity(case["kind"], case.get("expect"), spans)}
    row |= {"doc_type": source.get("type") or "commit_message", "doc_id": source.get("external_id") or case.get("at_commit"), "spans": [{"contains": s.get("contains"), "tier": s.get("tier")} for s in spans], "steps": _steps(case) if case["kind"] == "lineage" else []}
    if missing := [f for f in NEEDS.get(case["kind"], ()) if not row[f]]:
        raise BrokenCase(f"{case['id']}: a case of kind {case['kind']} needs {missing[0]}")
    return row


def read_cases(spark: SparkSession, *files: str) -> DataFrame:
    import yaml

    rows = []
    for file in files:
        with open(file, encoding="utf-8") as f:
            fixture = yaml.safe_load(f)
        rows += [_row(fixture["repo"]["name"], case) for case in fixture.get("cases") or []]
    return spark.createDataFrame(rows, CASES)


def _rank(values: tuple[str, ...], c: Column) -> Column:
    """Place among values from 1; null for a null, 0 for a stranger."""
    return F.array_position(F.array(*map(F.lit, values)), c)


def _status(known: Column, passed: Column) -> Column:
    return F.when(~known, "missing").when(passed, "pass").otherwise("fail").alias("status")


def evaluate_levels(cases: DataFrame, changes: DataFrame) -> DataFrame:
    """Change-level cases; changes: sha, path, symbol, change_level. One of several changes at a place is enough."""
    own = cases.where("kind = 'change_level'").join(changes.select(F.col("sha").alias("at_commit"), "path", "symbol", "change_level"), ["at_commit", "path", "symbol"], "left")
    found = own.groupBy(*_CASE).agg(F.count("change_level").alias("n"), F.max(F.coalesce(F.col("change_level") == F.col("expect"), F.lit(False))).alias("ok"))
    return found.select(*_CASE, _status(F.col("n") > 0, F.col("ok")))


def evaluate_discontinuities(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Whether a place was taken by another entity; found: sha, path, symbol. There is nothing between present and absent."""
    at = ["at_commit", "path", "symbol"]
    seen = found.select(F.col("sha").alias("at_commit"), "path", "symbol").distinct().withColumn("present", F.lit("present"))
    own = cases.where("kind = 'discontinuity'").join(seen, at, "left")
    return own.select(*_CASE, _status(F.lit(True), F.coalesce("present", F.lit("absent")) == F.col("expect")))


def evaluate_excursions(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Excursions by both commits; found: introduce_at, remove_at, path, symbol, strength. At least the wanted strength, any where none is named, no
    excursion where it should be absent."""
    at = ["introduce_at", "remove_at", "path", "symbol"]
    best = found.groupBy(*at).agg(F.min("strength").alias("got"))
    own = cases.where("kind = 'excursion'").join(best, at, "left")
    strong = F.coalesce(_rank(STRENGTHS, F.col("got")) <= _rank(STRENGTHS, F.coalesce("strength", F.lit(STRENGTHS[-1]))), F.lit(False))
    return own.select(*_CASE, _status(F.lit(True), F.when(F.coalesce(F.col("expect") == "absent", F.lit(False)), F.col("got").isNull()).otherwise(strong)))


def evaluate_lineages(cases: DataFrame, revisions: DataFrame, matches: DataFrame) -> DataFrame:
    """Chains of anchors; revisions: sha, path, symbol, occurrence, node; matches: prev_node, next_node, tier, ambiguity_size.

    Each step needs a match of the wanted tier or a surer one, or none where the chain should be absent. A case that is ambiguous by its label passes
    if exactly one of its chains was chosen and the match owns up to other candidates; without a chosen chain it is missing."""
    rows = cases.where("kind = 'lineage'").select(*_CASE, "expect", F.inline("steps"))
    for end in ("prev", "next"):
        keys = [f"_{k}" for k in ("sha", "path", "symbol", "occurrence")]
        nodes = revisions.select(*[F.col(k[1:]).alias(k) for k in keys], F.col("node").alias(f"{end}_node"))
        rows = rows.withColumns({k: F.col(f"{end}.{k[1:]}") for k in keys}).join(nodes, keys, "left").drop(*keys)
    rows = rows.join(matches.select("prev_node", "next_node", F.col("tier").alias("got"), "ambiguity_size"), ["prev_node", "next_node"], "left")
    known = F.col("prev_node").isNotNull() & F.col("next_node").isNotNull()
    near = F.coalesce(_rank(TIERS, F.col("got")) <= _rank(TIERS, F.col("tier")), F.lit(False))
    met = F.when(F.coalesce(F.col("expect") == "absent", F.lit(False)), F.col("got").isNull()).otherwise(near)
    chains = rows.groupBy(*_CASE, "alternative").agg(F.bool_and(known).alias("known"), F.bool_and(known & met).alias("met"), F.max_by("ambiguity_size", "step").alias("size"))
    found = chains.groupBy(*_CASE).agg(F.bool_or("known").alias("known"), F.count_if("met").alias("met"), F.max(F.when(F.col("met"), F.col("size"))).alias("size"))
    ambiguous = F.coalesce(F.col("confidence") == "ambiguous", F.lit(False))
    covered = F.when(ambiguous, F.col("size").isNotNull()).otherwise(F.col("known"))
    return found.select(*_CASE, _status(covered, (F.col("met") == 1) & (~ambiguous | (F.col("size") > 1))))


def evaluate_evidence(cases: DataFrame, documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes of a document; documents: doc_type, external_id; quotes: these, tier, quoted_text. All wanted quotes must be there, and others may be;
    where none is wanted there must be none. A document that was never taken in is missing."""
    at = ["doc_type", "doc_id"]
    read = documents.select("doc_type", F.col("external_id").alias("doc_id")).distinct().withColumn("read", F.lit(True))
    said = quotes.select("doc_type", F.col("external_id").alias("doc_id"), F.col("tier").alias("got"), "quoted_text")
    rows = cases.where("kind = 'evidence'").join(read, at, "left").join(said, at, "left").select(*_CASE, "read", "got", "quoted_text", F.posexplode_outer("spans").alias("span", "wanted"))
    hit = F.coalesce((F.col("got") == F.col("wanted.tier")) & F.contains("quoted_text", F.col("wanted.contains")), F.lit(False))
    spans = rows.groupBy(*_CASE, "span").agg(F.bool_or(hit).alias("hit"), F.count("quoted_text").alias("quotes"), F.max("read").alias("read"))
    found = spans.groupBy(*_CASE).agg(F.bool_and("hit").alias("hit"), F.max("quotes").alias("quotes"), F.max("read").alias("read"), F.count("span").alias("wanted"))
    return found.select(*_CASE, _status(F.col("read").isNotNull(), F.when(F.col("wanted") == 0, F.col("quotes") == 0).otherwise(F.col("hit"))))


def evaluate(cases: DataFrame, changes: DataFrame, discontinuities: DataFrame, excursions: DataFrame, revisions: DataFrame, matches: DataFrame, documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """All cases with their status. Kinds that nothing evaluates are missing, never failed."""
    found = evaluate_levels(cases, changes).union(evaluate_discontinuities(cases, discontinuities)).union(evaluate_excursions(cases, excursions))
    found = found.union(evaluate_lineages(cases, revisions, matches)).union(evaluate_evidence(cases, documents, quotes))
    return found.union(cases.where(~F.col("kind").isin(*NEEDS)).select(*_CASE, F.lit("missing").alias("status")))


def report(results: DataFrame) -> DataFrame:
    """Counts and rates by difficulty and over all; rates mean nothing where over a fifth is missing."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    rolled = results.rollup("difficulty").agg(F.count("*").alias("cases"), n("pass"), n("fail"), n("missing"))
    return rolled.withColumn("rate", F.try_divide("pass", F.col("pass") + F.col("fail"))).withColumn("interpretable", F.col("missing") * 5 <= F.col("cases"))


def certain(results: DataFrame) -> DataFrame:
    """Results of the cases whose label isn't ambiguous."""
    return results.where("confidence is null or confidence <> 'ambiguous'")


def regressions(baseline: DataFrame, results: DataFrame) -> DataFrame:
    """Cases, but easy ones, that passed before and don't now."""
    now = results.select("id", F.col("status").alias("now"))
    return baseline.where("status = 'pass' and difficulty <> 'easy'").join(now, "id", "left").where("now is null or now <> 'pass'").select("id", "difficulty", F.coalesce("now", F.lit("missing")).alias("now"))
