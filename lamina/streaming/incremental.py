"""Incremental processing: a pass remembers how far it has come and with which version, and a batch folds into what is stored. Any split
of a history into batches gives the same tables as one pass over all of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.asof import latest_by
from lamina.operators.graph import settled
from lamina.versions import VersionMismatch, require


@dataclass(frozen=True)
class PassState:
    version: str
    last_topo: int


class History(ValueError):
    """The stored watermark is no ancestor of the new tip: the history was rewritten."""


def pending(events: DataFrame, state: PassState | None, version: str) -> DataFrame:
    """Events after the watermark. Another version refuses instead of mixing."""
    if state is None:
        return events
    require(state.version, version, "the stored pass")
    return events.where(F.col("topo") > state.last_topo)


def check_ancestor(ancestors: DataFrame, watermark: str) -> None:
    if not ancestors.where(F.col("ancestor") == watermark).take(1):
        raise History(f"{watermark} is not in the history any more: rebuild")


def fold(stored: DataFrame | None, batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Latest row of each key, from what is stored and a batch of later events. Deletes stay as rows with null columns."""
    rows = batch.select(*keys, "topo", *columns)
    both = rows if stored is None else stored.select(*keys, "topo", *columns).unionByName(rows)
    return settled(latest_by(both, keys, ["topo"], ["topo", *columns]))


def advance(state: PassState | None, batch: DataFrame, version: str) -> PassState:
    top = batch.agg(F.max("topo")).first()[0]
    return PassState(version, top if top is not None else (state.last_topo if state else -1))


def run_in_batches(events: DataFrame, bounds: list[int], version: str, keys: list[str], columns: list[str]) -> tuple[DataFrame | None, PassState | None]:
    """One pass for each bound: events up to it that are still pending. Nothing pending is a short circuit."""
    stored, state = None, None
    for bound in bounds:
        batch = pending(events, state, version).where(F.col("topo") <= bound)
        if not batch.take(1):
            continue
        stored = fold(stored, batch, keys, columns)
        state = advance(state, batch, version)
    return stored, state


__all__ = ["History", "PassState", "VersionMismatch", "advance", "check_ancestor", "fold", "pending", "run_in_batches"]
