"""Declarations of Python source: names, ranges, token streams, hash vectors and n-grams, by the standard library's parser.

A declaration is a function, method or class; a name that is bound to a lambda counts too. Decorators widen a range. Names are dotted by
nesting. The layers of the hash vector: the source text; its tokens without comments and layout; tokens with local bindings
numbered; the same with the own name masked; the shape of the tree. Parsing is a Python UDF over distinct contents, so a file version
that occurs in many commits is parsed once."""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.functions import sketch
from lamina.functions.hashing import RECORD, UNIT
from lamina.versions import shape_profile

EXTENSIONS = {".py": "python"}
OBSERVED = "blob string, name string, kind string, start_line bigint, end_line bigint, start_byte bigint, end_byte bigint, raw string, token string, alpha string, alpha_self string, shape string, profile string, node_count int, token_count int, signature string, parts array<string>"
_LAYOUT = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _named(tree: ast.AST, prefix: str = "") -> Iterator[tuple[str, str, ast.AST, ast.AST]]:
    """(name, kind, node, whole) in source order; whole is the statement that a range covers."""
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            name = f"{prefix}{node.name}"
            yield name, "class" if isinstance(node, ast.ClassDef) else "method" if prefix and isinstance(tree, ast.ClassDef) else "function", node, node
            yield from _named(node, f"{name}.")
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Lambda) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            yield f"{prefix}{node.targets[0].id}", "function", node.value, node
        else:
            yield from _named(node, prefix)


def bindings(node: ast.AST) -> list[str]:
    """Names that a declaration binds inside, by first binding; its own name is not among them. This goes by name, not by scope."""
    found: dict[str, None] = {}

    def visit(n: ast.AST) -> None:
        if isinstance(n, ast.arg):
            found.setdefault(n.arg)
        elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
            found.setdefault(n.id)
        elif isinstance(n, _SCOPES) and n is not node and hasattr(n, "name"):
            found.setdefault(n.name)
        elif isinstance(n, ast.ExceptHandler) and n.name:
            found.setdefault(n.name)
        elif isinstance(n, ast.alias):
            found.setdefault((n.asname or n.name).split(".")[0])
        for child in ast.iter_child_nodes(n):
            visit(child)

    visit(node)
    return list(found)


def shape(node: ast.AST) -> tuple[str, int]:
    """Kinds and fields of the tree without its texts, and the number of its nodes."""
    count = 0

    def walk(n: ast.AST) -> str:
        nonlocal count
        count += 1
        inner = []
        for field, value in ast.iter_fields(n):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST) and not isinstance(child, ast.expr_context):
                    inner.append(f"{field}:{walk(child)}")
        return f"({type(n).__name__}{''.join(' ' + x for x in inner)})"

    return walk(node), count


def _tokens(source: str) -> list[tuple[int, int, str, str]]:
    """(line, column, kind, text); attribute names after a dot are members and never renamed."""
    out: list[tuple[int, int, str, str]] = []
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type in _LAYOUT:
            continue
        kind = tokenize.tok_name[t.type]
        if t.type == tokenize.NAME and not keyword.iskeyword(t.string):
            kind = "member" if out and out[-1][3] == "." else "identifier"
        out.append((*t.start, kind, t.string))
    return out


def declarations(source: str) -> list[dict]:
    """One record for each declaration, in source order. A source that doesn't parse has none."""
    try:
        tree = ast.parse(source)
        tokens = _tokens(source)
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
        return []
    lines = source.splitlines(keepends=True)
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line.encode()))
    out = []
    for name, kind, node, whole in _named(tree):
        first = min([whole.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        start_column = len(lines[first - 1].encode()[: whole.col_offset].decode()) if first == whole.lineno else len(lines[first - 1]) - len(lines[first - 1].lstrip())
        end_column = len(lines[whole.end_lineno - 1].encode()[: whole.end_col_offset].decode())
        own = [(k, t) for line, column, k, t in tokens if (first, start_column) <= (line, column) < (whole.end_lineno, end_column)]
        start = begins[first - 1] + len(lines[first - 1][:start_column].encode())
        end = begins[whole.end_lineno - 1] + len(lines[whole.end_lineno - 1][:end_column].encode())
        numbers = {b: f"${k}" for k, b in enumerate(bindings(node))}
        last = name.rsplit(".", 1)[-1]
        alpha = [(k, numbers.get(t, t) if k == "identifier" else t) for k, t in own]
        masked = [(k, "$self" if k == "identifier" and t == last else numbers.get(t, t) if k == "identifier" else t) for k, t in own]
        tree_shape, nodes = shape(node)
        stream = lambda ts: RECORD.join(f"{k}{UNIT}{t}" for k, t in ts)
        raw = source.encode()[start:end].decode()
        out.append({
            "name": name, "kind": kind, "start_line": first, "end_line": whole.end_lineno, "start_byte": start, "end_byte": end, "raw": _sha(raw), "token": _sha(stream(own)), "alpha": _sha(stream(alpha)), "alpha_self": _sha(stream(masked)), "shape": _sha(tree_shape),
            "profile": shape_profile("python"), "node_count": nodes, "token_count": len(own), "signature": raw.split("\n", 1)[0].strip(), "parts": [f"{k}{UNIT}{t}" for k, t in alpha],
        })
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in OBSERVED.split(", ")]
    for frame in batches:
        rows = [{"blob": blob, **d} for blob, source in zip(frame["blob"], frame["source"], strict=True) for d in declarations(source or "")]
        yield pd.DataFrame(rows, columns=columns)


def observe(files: DataFrame) -> DataFrame:
    """Declarations of files (blob, source), each content parsed once, with their n-grams and occurrence among equal names."""
    once = files.select("blob", "source").dropDuplicates(["blob"])
    seen = once.mapInPandas(_parse, OBSERVED).withColumn("grams", sketch.ngram_set(F.col("parts"))).drop("parts")
    return seen.withColumn("occurrence", (F.row_number().over(W.partitionBy("blob", "name").orderBy("start_byte")) - 1).cast("int"))
