"""Path lineages over a commit graph: which thing a path names at a commit, through renames, deletions, copies and merges.

A commit's state is its first parent's with its own changes laid over, so a history is worked off in order within a repository; many
repositories are worked off in parallel. Only changed paths are stored; a null lineage is a tombstone. A repository is one task: it holds its overlays
and the whole state of HEADS commits at most, which move on with their first-parent children; the state of any other commit is laid up again when it is
asked for."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "repo string, sha string, topo bigint, path string, lineage bigint"
OUTPUT = "repo string, kind string, sha string, topo bigint, path string, lineage bigint, detail string"


HEADS = 64
_ORDER = {"D": 0, "A": 1, "C": 1, "M": 2}


class _Overlays:
    """What each path stands for at each commit, from what each commit changed on its first parent."""

    def __init__(self, parent: dict[str, str | None]) -> None:
        self.parent = parent
        self.over: dict[str, dict] = {}
        self.heads: OrderedDict[str, dict] = OrderedDict()

    def state(self, sha: str | None) -> dict:
        if sha is None:
            return {}
        if sha not in self.heads:
            chain, at = [], sha
            while at is not None and at not in self.heads:
                chain.append(at)
                at = self.parent.get(at)
            made = {} if at is None else dict(self.heads[at])
            for x in reversed(chain):
                made.update(self.over.get(x, {}))
            self._keep(sha, made)
        self.heads.move_to_end(sha)
        return self.heads[sha]

    def put(self, sha: str, own: dict) -> None:
        """Ends a commit: its parent's state moves on to it."""
        self.over[sha] = own
        first = self.parent[sha]
        moved = self.state(first)
        self.heads.pop(first, None)
        moved.update(own)
        self._keep(sha, moved)

    def _keep(self, sha: str, state: dict) -> None:
        self.heads[sha] = state
        if len(self.heads) > HEADS:
            self.heads.popitem(last=False)


class _Walk:
    """One repository: lineages and last changes by commit and path, and a counter that mints lineages by position."""

    def __init__(self) -> None:
        self.parent: dict[str, str | None] = {}
        self.lineages = _Overlays(self.parent)
        self.touched = _Overlays(self.parent)  # the commit that last changed a path
        self.buried = _Overlays(self.parent)  # the lineage that was last removed from a path
        self.minted = 0

    def mint(self) -> int:
        self.minted += 1
        return self.minted

    def commit(self, sha: str, parents: list[str], changes: list[dict]) -> list[tuple[str, str, int | None, str | None]]:
        """(kind, path, lineage, detail): events, anomalies, and of each change the path before (with the commit that last changed it) and after."""
        first = parents[0] if parents else None
        self.parent[sha] = first
        before, last = self.lineages.state(first), self.touched.state(first)
        own: dict[str, int | None] = {}
        out: list[tuple[str, str, int | None, str | None]] = []

        def note(path: str, kind: str) -> None:
            out.append(("anomaly", path, None, kind))

        def other_parents(path: str) -> int | None:
            found = {x for p in parents[1:] if (x := self.lineages.state(p).get(path)) is not None}
            return found.pop() if len(found) == 1 else None

        def held(lineage: int, but: str) -> bool:
            return any(x == lineage and path != but for path, x in {**before, **own}.items())

        renames = [c for c in changes if c["change_type"] == "R"]
        # every source is read from the parent's state before any target is set, so chains and swaps keep their meaning
        sources = {c["path"]: before.get(c["old_path"]) for c in renames}
        own.update({c["old_path"]: None for c in renames})
        for c in renames:
            lineage = sources[c["path"]]
            if lineage is None:
                lineage = other_parents(c["path"])
                if lineage is None:
                    lineage = self.mint()
                    note(c["path"], "rename_source_missing")
            own[c["path"]] = lineage
        for c in sorted((c for c in changes if c["change_type"] != "R"), key=lambda c: _ORDER[c["change_type"]]):
            path, kind = c["path"], c["change_type"]
            was = before.get(path)
            if kind == "D":
                if was is None and other_parents(path) is None:
                    note(path, "delete_of_absent")
                if own.get(path) is None:  # not the target of a rename
                    own[path] = None
            elif kind in ("A", "C"):
                if was is not None and path not in own:
                    note(path, "add_of_present")
                    continue
                lineage = other_parents(path) if kind == "A" and len(parents) > 1 else None
                if lineage is not None and held(lineage, path):
                    lineage = None  # the same thing can't be in two places: this one forks
                own[path] = self.mint() if lineage is None else lineage
            elif kind == "M" and was is None:
                lineage = other_parents(path) if len(parents) > 1 else None
                if lineage is None:
                    lineage = self.mint()
                    note(path, "modify_of_absent")
                own[path] = lineage

        moved: dict[str, str | None] = {}
        for c in changes:
            path, kind, old = c["path"], c["change_type"], c["old_path"] or c["path"]
            if kind not in ("A", "C"):
                out.append(("before", old, before.get(old), last.get(old)))
            if kind == "R":
                moved.setdefault(old, None)
            # what a merge brings in was changed on the branch that it comes from
            from_branch = next((t for p in parents[1:] if (t := self.touched.state(p).get(path)) is not None), sha)
            moved[path] = None if kind == "D" else from_branch
            if kind != "D":
                out.append(("after", path, own[path] if path in own else before.get(path), sha))
        gone = self.buried.state(first)
        out += [("recreated", path, gone[path], None) for path, lineage in own.items() if lineage is not None and before.get(path) is None and path in gone and gone[path] != lineage]
        removed = {path: before[path] for path, lineage in own.items() if lineage is None and before.get(path) is not None}
        out += [("event", path, lineage, None) for path, lineage in own.items()]
        self.lineages.put(sha, own)
        self.touched.put(sha, moved)
        self.buried.put(sha, removed)
        return out


def _repository(rows: pd.DataFrame) -> pd.DataFrame:
    walk = _Walk()
    out = []
    for row in rows.sort_values("topo").itertuples():
        changes = [c.asDict() if hasattr(c, "asDict") else dict(c) for c in (row.changes if row.changes is not None else [])]
        found = walk.commit(row.sha, list(row.parents if row.parents is not None else []), changes)
        out += [(row.repo, kind, row.sha, row.topo, path, lineage, detail) for kind, path, lineage, detail in found]
    made = pd.DataFrame(out, columns=["repo", "kind", "sha", "topo", "path", "lineage", "detail"])
    return made.astype({"lineage": "Int64"})


def build(commits: DataFrame) -> DataFrame:
    """commits: repo, sha, topo, parents array<string>, changes array<struct<change_type, path, old_path>> (for a merge, against its
    first parent). Rows of kind event (path, lineage; null for a tombstone), of kind anomaly (path, detail), and for each change of kind before
(path and lineage at the first parent, and in detail the commit on its chain that last changed it) and after. Kind recreated: a path that is taken
again, with the lineage that was removed from it last on the chain."""
    bare = F.transform("changes", lambda c: F.struct(c["change_type"].alias("change_type"), c["path"].alias("path"), c["old_path"].alias("old_path")))
    return commits.select("repo", "sha", "topo", "parents", bare.alias("changes")).groupBy("repo").applyInPandas(_repository, OUTPUT)


def linear_lineages(events: list[tuple[int, str, str, str | None]]) -> Iterator[tuple[int, str, int]]:
    """A plain model for histories without merges, for tests: (topo, kind, path, old_path) -> (topo, path, lineage)."""
    state: dict[str, int] = {}
    minted = 0
    by_topo: dict[int, list[tuple[str, str, str | None]]] = {}
    for topo, kind, path, old in events:
        by_topo.setdefault(topo, []).append((kind, path, old))
    for topo in sorted(by_topo):
        before = dict(state)
        renames = [(p, o) for k, p, o in by_topo[topo] if k == "R"]
        for _, old in renames:
            state.pop(old, None)
        for path, old in renames:
            if old in before:
                state[path] = before[old]
            else:
                minted += 1
                state[path] = minted
            yield topo, path, state[path]
        for kind, path, _ in by_topo[topo]:
            if kind == "D":
                state.pop(path, None)
            elif kind == "A" and path not in state or kind == "M" and path not in state:
                minted += 1
                state[path] = minted
                yield topo, path, minted
