"""Version-control history as DataFrames: commits, changes and hunks from git's own output, read where git is installed."""

from __future__ import annotations

import hashlib
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMMITS = "repo string, sha string, topo bigint, parents array<string>, author string, authored_at string, committed_at string, message string, is_merge boolean, changes array<struct<change_type:string,path:string,old_path:string,score:int,hunks:array<struct<old_start:bigint,old_count:bigint,new_start:bigint,new_count:bigint>>>>"
PER_PARTITION = 500

_HUNK = re.compile(rb"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_ESCAPES = {"n": 10, "t": 9, "r": 13, '"': 34, "\\": 92, "a": 7, "b": 8, "f": 12, "v": 11}


def unquote_path(path: str) -> str:
    """A path as git prints it: in quotes, with C escapes and octal bytes, where it holds unusual characters."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    out = bytearray()
    for m in re.finditer(r"\\([0-7]{3})|\\(.)|([^\\]+)", path[1:-1], re.S):
        if m[1]:
            out.append(int(m[1], 8))
        elif m[2]:
            out += bytes([_ESCAPES[m[2]]]) if m[2] in _ESCAPES else m[2].encode()
        else:
            out += m[3].encode()
    return out.decode("utf-8", "replace")


def parse_status(line: str) -> dict | None:
    """One line of name-status output. Kinds other than A, D, R and C count as M."""
    kind, *paths = line.split("\t")
    if not kind or not paths:
        return None
    score = int(kind[1:]) if kind[1:].isdigit() else None
    letter = kind[0] if kind[0] in "ADRC" else "M"
    paths = [unquote_path(p) for p in paths]
    return {"change_type": letter, "path": paths[-1], "old_path": paths[0] if letter in "RC" else None, "score": score}


def parse_hunks(lines: Iterator[bytes]) -> Iterator[tuple[str, dict]]:
    """(path, hunk) from a patch without context. A hunk's content lines are counted off, so that what looks like a header inside them is none."""
    path, left = None, 0
    for line in lines:
        if left and line[:1] in (b"+", b"-"):
            left -= 1
            continue
        if line.startswith(b"\\ "):
            continue
        left = 0
        if line.startswith(b"--- ") and line != b"--- /dev/null":
            path = _patch_path(line[4:])
        elif line.startswith(b"+++ ") and line != b"+++ /dev/null":
            path = _patch_path(line[4:])
        elif path is not None and (m := _HUNK.match(line)):
            a, b, c, d = (int(x) if x is not None else 1 for x in m.groups())
            left = b + d
            yield path, {"old_start": a, "old_count": b, "new_start": c, "new_count": d}


def _patch_path(text: bytes) -> str:
    path = unquote_path(text.decode("utf-8", "replace").rstrip("\t"))
    return path[2:] if path[:2] in ("a/", "b/") else path


def blob_id(content: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def parse_commits(output: bytes) -> dict[str, list[dict]]:
    """The changes of each commit with their hunks, from the raw and patch output of many commits. A change of content without a hunk (a binary file)
    has null hunks: there is no evidence where its lines are; a change of name or mode only has none at all."""
    found: dict[str, list[dict]] = {}
    patches: dict[str, list[bytes]] = {}
    sha, left = "", 0
    for line in output.split(b"\n"):
        if left and line[:1] in (b"+", b"-"):
            left -= 1
        elif line[:1] != b"\\":
            left = 0
            if re.fullmatch(rb"[0-9a-f]{40}|[0-9a-f]{64}", line):
                sha = line.decode()
                found[sha], patches[sha] = [], []
                continue
            if line[:1] == b":":
                meta, _, names = line.decode("utf-8", "surrogateescape").partition("\t")
                fields = meta.split(" ")
                if change := parse_status(f"{fields[4]}\t{names}"):
                    found[sha].append(change | {"same": fields[2] == fields[3]})
                continue
            if m := _HUNK.match(line):
                left = sum(int(m[k]) if m[k] is not None else 1 for k in (2, 4))
        if sha:
            patches[sha].append(line)
    for sha, own in found.items():
        hunks: dict[str, list[dict]] = {}
        for path, hunk in parse_hunks(iter(patches[sha])):
            hunks.setdefault(path, []).append(hunk)
        for change in own:
            change["hunks"] = hunks.get(change["path"], [] if change.pop("same") else None)
            change.pop("same", None)
    return found


class GitFailed(RuntimeError):
    """What git said; a worker's error reaches the driver as text only."""


def _git(repo: str, *args: str, feed: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], check=False, capture_output=True, input=feed)
    if done.returncode:
        raise GitFailed(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def tip(repo: str, until: str = "HEAD") -> str:
    return _git(repo, "rev-parse", "--verify", f"{until}^{{commit}}").decode().strip()


def read_blobs(repo: str, specs: list[str]) -> Iterator[tuple[str, bytes | None]]:
    """Content of each revision:path; None where there is none. Contents are checked against their ids."""
    out = _git(repo, "cat-file", "--batch", feed="\n".join(specs).encode() + b"\n")
    at = 0
    for spec in specs:
        end = out.index(b"\n", at)
        head = out[at:end].split()
        if head[-1] == b"missing":
            yield spec, None
            at = end + 1
            continue
        size = int(head[2])
        content = out[end + 1 : end + 1 + size]
        if head[1] == b"blob" and blob_id(content) != head[0].decode():
            raise OSError(f"{spec}: content doesn't match its id")
        yield spec, content
        at = end + 1 + size + 1


class _Range(InputPartition):
    def __init__(self, first: int, shas: list[str]) -> None:
        super().__init__((first, shas))


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.repo, self.until = options["path"], options.get("until", "HEAD")
        self.rename, self.copy = options.get("rename", "30"), options.get("copy", "40")

    def partitions(self) -> list[_Range]:
        if _git(self.repo, "rev-parse", "--is-shallow-repository").strip() == b"true":
            raise GitFailed("fatal: a shallow clone has no whole history")
        shas = _git(self.repo, "rev-list", "--reverse", "--topo-order", self.until).decode().split()
        return [_Range(k, shas[k : k + PER_PARTITION]) for k in range(0, len(shas), PER_PARTITION)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        first, shas = partition.value
        number = {sha: first + k for k, sha in enumerate(shas)}
        listed = _git(self.repo, "log", "--no-walk=unsorted", "--stdin", "-z", "--format=%H%x1f%P%x1f%an%x1f%aI%x1f%cI%x1f%B", feed="\n".join(shas).encode()).decode("utf-8", "replace")
        facts = {f[0]: f[1:] for x in listed.split("\0") if len(f := x.strip("\n").split("\x1f", 5)) == 6}
        # a merge's changes are those against its first parent, which is the state that it goes on from
        asked = "\n".join(" ".join([sha, *facts[sha][0].split()[:1]]) for sha in shas) + "\n"
        patch = ("--raw", "--no-abbrev", "-p", "-U0", "--no-color", "--no-ext-diff", "--no-textconv", "--src-prefix=a/", "--dst-prefix=b/")
        raw = _git(self.repo, "diff-tree", "--stdin", "-r", "--root", *patch, f"-M{self.rename}%", f"-C{self.copy}%", feed=asked.encode())
        changes = parse_commits(raw)
        for sha in shas:
            parents, author, authored, committed, message = facts[sha]
            rows = [(c["change_type"], c["path"], c["old_path"], c["score"], c["hunks"]) for c in changes.get(sha, [])]
            yield (self.repo, sha, number[sha], parents.split(), author, authored, committed, message.rstrip("\n"), len(parents.split()) > 1, rows)


class HistorySource(DataSource):
    """spark.read.format("history").load(repository): one row for each commit, ancestors first."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return COMMITS

    def reader(self, schema: object) -> HistoryReader:
        return HistoryReader(dict(self.options))


def read_history(spark: SparkSession, repo: str, until: str = "HEAD") -> DataFrame:
    spark.dataSource.register(HistorySource)
    return spark.read.format("history").option("until", until).load(repo)
