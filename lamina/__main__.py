"""python -m lamina list | query NAME SF_DIR | hotspots REPO [STORE] | abandoned REPO [STORE] | why REPO PATH:NAME [STORE]

STORE is a folder that keeps the index of REPO for the next call."""

from __future__ import annotations

import sys

WORDS = {"list": (1,), "query": (3,), "hotspots": (2, 3), "abandoned": (2, 3), "why": (3, 4)}


def run(args: list[str]) -> str:
    from lamina import queries, render, session

    if args[0] == "list":
        return "\n".join(sorted(queries.QUERIES))
    if args[0] == "query" and args[1] not in queries.QUERIES:
        raise render.UnknownTarget(f"{args[1]}: no such query")
    path, name = render.target(args[2]) if args[0] == "why" else ("", "")
    spark = session.build()
    if args[0] == "query":
        queries.QUERIES[args[1]](spark, args[2]).show(50, truncate=False)
        return ""
    from lamina.plans import index

    least = WORDS[args[0]][0]
    built, commits = index.indexed(spark, args[1], args[least] if len(args) > least else None)
    if args[0] == "hotspots":
        return render.hotspots(built.churn())
    if args[0] == "abandoned":
        return render.abandoned(built.abandoned(commits), built.revisions)
    return render.timeline(built.timeline(path, name), path, name, built.survivors(name))


def main(args: list[str]) -> int:
    if not args or len(args) not in WORDS.get(args[0], ()):
        print(__doc__, file=sys.stderr)
        return 2
    from lamina import render

    try:
        print(run(args))
    except Exception as error:
        if (line := render.explain(error)) is None:
            raise
        print(line, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
