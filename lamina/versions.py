"""Versions of everything that can change an output. A stored table carries the version that wrote it."""

from __future__ import annotations

WALK = "walk-1"
SIGNATURE = "minhash128-ngram3-1"
MATCH = "ladder-1"
EXCURSION = "excursion-1"
EXTRACTOR = "rationale-1"
MARKDOWN_EXTRACTOR = "rationale-markdown-1"
CLAIM = "claim-1"
SERIALIZER = "1"
GRAMMARS = {"python": "py-stdlib-1"}


def shape_profile(family: str) -> str:
    return f"{family}/{GRAMMARS[family]}/{SERIALIZER}"


def walk_version(rename: int = 30, copy: int = 40, harder: bool = False) -> str:
    return f"{WALK}/rename={rename}/copy={copy}/harder={int(harder)}"


def index_version() -> str:
    """Of everything that a stored index depends on."""
    return "/".join([walk_version(), *map(shape_profile, sorted(GRAMMARS)), match_version(), EXCURSION])


def match_version(same_file: float = 0.5, cross_file: float = 0.7, min_nodes: int = 25) -> str:
    return f"{MATCH}/{SIGNATURE}/same={same_file}/cross={cross_file}/nodes={min_nodes}/exact-recall"


class VersionMismatch(ValueError):
    """Stored rows were written by another version or for another history; mixing them would change answers."""


def require(stored: str | None, wanted: str, what: str) -> None:
    if stored is not None and stored != wanted:
        raise VersionMismatch(f"{what} was written by {stored}, this is {wanted}: rebuild it")
