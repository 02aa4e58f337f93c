"""Sinks of result changes. A sink gets one epoch's rows: (tuple, time, diff)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sink(Protocol):
    def write(self, name: str, diffs: DataFrame, epoch: int) -> list[Any]:
        """Take an epoch's changes; return what is to be told to clients."""


class CallbackSink:
    """Tells every change to a function; for results that fit the client."""

    def __init__(self, callback: Callable[[str, tuple, int, int], None]):
        self.callback = callback

    def write(self, name: str, diffs: DataFrame, epoch: int) -> list[Any]:
        columns = [c for c in diffs.columns if c not in ("_time", "_diff")]
        for row in diffs.toLocalIterator():
            self.callback(name, tuple(row[c] for c in columns), row["_time"], row["_diff"])
        return []


class MemorySink(CallbackSink):
    def __init__(self):
        self.rows: list[tuple[str, tuple, int, int]] = []
        super().__init__(lambda *row: self.rows.append(row))


class TheVoid:
    """Discards rows but makes them; logs ``elapsed_ms,time`` per epoch."""

    def __init__(self, path: str | None = None):
        self.path, self.began = path, time.monotonic()

    def write(self, name: str, diffs: DataFrame, epoch: int) -> list[Any]:
        diffs.write.format("noop").mode("overwrite").save()
        if self.path is not None:
            with Path(self.path).open("a") as out:
                out.write(f"{(time.monotonic() - self.began) * 1000:.0f},{epoch}\n")
        return []


class FileSink:
    """Appends each epoch's changes as files of a Spark format."""

    def __init__(self, path: str, kind: str = "csv"):
        self.path, self.kind = path, kind

    def write(self, name: str, diffs: DataFrame, epoch: int) -> list[Any]:
        flat = diffs.select(*(F.col(c).cast("string") if t.startswith(("array", "struct")) and self.kind == "csv" else F.col(c) for c, t in diffs.dtypes))
        flat.write.mode("append").format(self.kind).save(self.path)
        return []


class AssocIn:
    """Merges pulled paths into nested JSON objects.

    ``stateful`` None: an epoch's changes alone, one object per top-level key.
    ``stateful`` g: the state is kept, and for every changed key of g levels its
    part of the state is told. Changes are applied by time, retractions before
    additions; a retraction removes its leaf at any level.
    """

    def __init__(self, stateful: int | None = None):
        self.stateful = stateful
        self.state: dict[str, Any] = {}

    def write(self, name: str, diffs: DataFrame, epoch: int) -> list[Any]:
        rows = [(*r["path"], r["attr"], r["value"], r["_time"], r["_diff"]) for r in diffs.orderBy("_time", "_diff", "path", "attr", "value").toLocalIterator()]
        into: dict[str, Any] = {} if self.stateful is None else self.state
        depth = self.stateful or 1
        changed: list[tuple[str, ...]] = []
        for *path, leaf, value, _, diff in rows:
            changed.append(merge(into, path, leaf, value, diff, depth))
        if self.stateful is None:
            return [(name, into[k], epoch, 1) for k in sorted(into)]
        return [(name, json.loads(json.dumps(_part(into, key))), epoch, 1) for key in sorted(set(changed))]


def merge(into: dict, path: list[str], leaf: str, value: Any, diff: int, depth: int) -> tuple[str, ...]:
    """Set or remove one leaf; returns its key, cut to ``depth`` levels."""
    entry = into
    for key in path:
        if not isinstance(entry.get(key), dict):
            entry[key] = {}
        entry = entry[key]
    if diff > 0:
        entry[leaf] = value
    else:
        entry.pop(leaf, None)
    keys = path or [leaf]
    return tuple(keys[:depth])


def _part(state: dict, key: tuple[str, ...]) -> Any:
    for k in key:
        state = state.get(k, {})
    return state
