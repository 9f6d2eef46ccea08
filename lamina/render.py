"""Plain text of small views for the command line, and one line for the failures that a user can mend. Only rows that are shown reach the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.text import is_test_path
from lamina.versions import VersionMismatch

LEVELS = {"none": "unchanged", "raw": "comments or layout", "token": "names", "alpha": "literals or calls", "shape": "structure", "birth": "born", "death": "removed"}
SURE = "A"
NAMESAKES = 3

# what git says, and what to do about it
ADVICE = {
    "unknown revision": "the commit or branch doesn't exist, or the repository has no commits yet",
    "ambiguous argument": "the commit or branch doesn't exist, or the repository has no commits yet",
    "not a git repository": "REPO has to be the root of a git repository",
    "cannot change to": "REPO doesn't exist",
}


def explain(error: BaseException) -> str | None:
    """One line for a known failure of the user's; None for anything else, which keeps its trace."""
    text = str(error) + "\n" + str(getattr(error, "stderr", None) or "")
    if fatal := re.search(r"fatal: [^\n\\]*", text):
        advice = next((f" ({a})" for said, a in ADVICE.items() if said in fatal[0]), "")
        return fatal[0].rstrip("'\"") + advice
    if "[PATH_NOT_FOUND]" in text:
        return text.strip().splitlines()[0]
    return str(error) if isinstance(error, (VersionMismatch, UnknownTarget)) else None


class UnknownTarget(ValueError):
    """A target that isn't PATH:NAME, or that the history doesn't know."""


def target(text: str) -> tuple[str, str]:
    path, colon, name = text.rpartition(":")
    if not (path and colon and name):
        raise UnknownTarget(f"{text}: a target is PATH:NAME")
    return path, name


def timeline(changes: DataFrame, path: str, name: str, survivors: DataFrame | None = None, limit: int = 200) -> str:
    """The changes of the entities at a place. Unchanged observations are counted and not listed."""
    counts = changes.agg(F.count("*").alias("all"), F.count_if(F.col("change_level") == "none").alias("same"), F.count_distinct("stable_key").alias("entities")).first()
    if not counts["all"]:
        raise UnknownTarget(f"{path}:{name} is nowhere in this history")
    rows = changes.where("change_level <> 'none'").orderBy("stable_key", "topo").limit(limit).collect()
    out, entity = [f"{path}:{name}: {counts['all'] - counts['same']} changes of {counts['entities']} entities, seen unchanged {counts['same']} times"], None
    for r in rows:
        if r["stable_key"] != entity:
            entity = r["stable_key"]
            out.append(f"entity {entity[:12]}")
        tier = f" [{r['tier']}{'?' if (r['ambiguity_size'] or 0) > 1 else ''}]" if r["tier"] else ""
        moved = f", from {r['moved_from']}" if r["moved_from"] else ""
        out.append(f"  {r['commit'].rpartition('@')[2][:10]} {LEVELS[r['change_level']]}{tier} {r['path']}:{r['name']}{moved}")
    if rows and rows[-1]["change_level"] == "death" and survivors is not None:
        left = [r["stable_key"][:12] for r in survivors.orderBy("stable_key").limit(NAMESAKES + 1).collect()]
        if left:
            more = " and others" if len(left) > NAMESAKES else ""
            out.append(f"  {name} is also the name of {', '.join(left[:NAMESAKES])}{more}, still there: this text went, not necessarily the idea")
    return "\n".join(out)


def abandoned(found: DataFrame, places: DataFrame, limit: int = 50) -> str:
    """Excursions, surest first. Those that only their life span suggests are called suspected; tests are counted and not listed."""
    named = found.join(places.groupBy("stable_key").agg(F.max_by(F.struct("path", "name"), "topo").alias("at")).select(F.col("stable_key").alias("entity"), "at.*"), "entity").withColumn("test", is_test_path(F.col("path")))
    counts = named.agg(F.count_if(~F.col("test")).alias("shown"), F.count_if("test").alias("hidden"), F.count_if(~F.col("test") & (F.col("strength") != SURE)).alias("suspected")).first()
    out = [f"{counts['shown']} removed after a while, {counts['suspected']} of them only suspected; {counts['hidden']} in tests not shown"]
    for r in named.where("not test").orderBy("strength", F.desc("duration_days"), "path", "name", "entity").limit(limit).collect():
        word = "removed" if r["strength"] == SURE else "suspected"
        out.append(f"  {r['strength']} {word} after {r['duration_days']:.1f} days ({r['method']}) {r['path']}:{r['name']}")
    return "\n".join(out)


def hotspots(rows: DataFrame, limit: int = 20) -> str:
    """Declarations with structural changes, most first; tests are counted and not listed."""
    marked = rows.where("structural > 0").withColumn("test", is_test_path(F.col("path")))
    counts = marked.agg(F.count_if(~F.col("test")).alias("shown"), F.count_if("test").alias("hidden")).first()
    out = [f"{counts['shown']} declarations changed their structure; {counts['hidden']} in tests not shown"]
    for k, r in enumerate(marked.where("not test").orderBy(F.desc("structural"), F.desc("changes"), "stable_key").limit(limit).collect(), 1):
        out.append(f"  {k:2d}. {r['structural']} of {r['changes']} changes {r['path']}:{r['name']}")
    return "\n".join(out)
