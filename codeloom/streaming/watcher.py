"""The watcher's state over a stream of notifications: what must be synchronised, and when.

A workspace's changed paths wait until it is quiet. More paths than its bound,
a manifest or a folder that changes call for a full pass, which takes the place
of all waiting paths. Contents are verified when the last verification is long
ago, and at once when asked. An error stays until a full pass succeeds, and
every flush meanwhile is a full pass; queries ask :func:`blocked`.

State is kept by workspace in the query's state store, bounded by
``Bounds.paths`` paths, and times are those of the notifications, so a replay
after a failure, or another cut into micro-batches, comes to the same flushes.
A notification later than the watermark counts at the watermark, since the
change it tells of must not be lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codeloom.functions.text import is_ignored, language

# Files that describe a workspace.
MANIFESTS = ("package.json", "composer.json", "nest-cli.json", "go.mod", "tsconfig.json", "artisan")
#: Kinds of rows besides changed paths: a full verification asked for, the outcome of a pass, and time that passes.
SIGNALS = ("verify", "failed", "succeeded", "tick")
FLUSHES = "workspace string, at_ms bigint, mode string, verify boolean, paths array<string>, error string"


@dataclass(frozen=True)
class Bounds:
    """Waiting paths of a workspace, the quiet before a flush, and the time between verifications."""

    paths: int = 1000
    quiet_ms: int = 300
    verify_ms: int = 60_000


def notices(events: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """(workspace, path, kind, at) of events (workspace, path, signal, is_folder, at): what the watcher heeds, by expressions alone.

    A signal stands for itself; a folder or a manifest is ``structure``, a
    source file ``source``. Other files, ignored paths and paths that leave the
    workspace are dropped.
    """
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "")
    name: Column = F.element_at(F.split(path, "/"), -1)
    outside = path.startswith("/") | (path == "..") | path.startswith("../")
    heeded = path.isNotNull() & (path != "") & ~outside & ~is_ignored(path, patterns)
    kind = F.when(F.col("signal").isin(*SIGNALS), F.col("signal")).when(heeded & (F.coalesce("is_folder", F.lit(False)) | name.isin(*MANIFESTS)), "structure").when(heeded & language(path).isNotNull(), "source")
    return events.select("workspace", path.alias("path"), kind.alias("kind"), F.col("at").cast("timestamp").alias("at")).filter("kind is not null and workspace is not null and at is not null")


class State:
    """A workspace's state, and the flushes that its rows bring about."""

    def __init__(self, bounds: Bounds, pending: set[str], full: bool, due: int | None, verified: int | None, error: str):
        self.bounds, self.pending, self.full, self.due, self.verified, self.error = bounds, pending, full, due, verified, error

    def flush(self, at: int, forced: bool = False) -> dict | None:
        """What to synchronise at a time; nothing when there is nothing to do."""
        self.due = None
        verify = forced or at - self.verified >= self.bounds.verify_ms
        if not (self.pending or self.full or verify or self.error):
            return None
        whole = self.full or verify or bool(self.error)
        row = {"at_ms": at, "mode": "full" if whole else "paths", "verify": verify, "paths": [] if whole else sorted(self.pending), "error": self.error}
        self.pending, self.full = set(), False
        self.verified = at if verify else self.verified
        return row

    def notice(self, kind: str, path: str | None, at: int) -> Iterator[dict]:
        """Take a row; rows come in the order of their times."""
        if self.verified is None:
            self.verified = at
        if self.due is not None and at > self.due:
            row = self.flush(self.due)
            if row:
                yield row
        if kind == "verify":
            row = self.flush(at, True)
            if row:
                yield row
        elif kind == "failed":
            self.error = path or "error"
        elif kind == "succeeded":
            self.error = ""
        elif kind == "tick":
            if self.due is None and at - self.verified >= self.bounds.verify_ms:
                row = self.flush(at)
                if row:
                    yield row
        elif not self.full:  # a full pass that waits is not put off
            if kind == "structure" or len(self.pending) >= self.bounds.paths:
                self.full, self.pending = True, set()
            else:
                self.pending.add(path)
            self.due = at + self.bounds.quiet_ms


class Watcher(StatefulProcessor):
    """Keeps :class:`State` by workspace; a timer flushes what no later row does."""

    def __init__(self, bounds: Bounds = Bounds()):
        self.bounds = bounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "full boolean, due bigint, verified bigint, error string")
        self.pending = handle.getMapState("pending", "path string", "at bigint")

    def _load(self) -> State:
        full, due, verified, error = self.held.get() if self.held.exists() else (False, None, None, "")
        return State(self.bounds, {k[0] for k in self.pending.keys()}, full, due, verified, error)

    def _save(self, state: State, before: State) -> None:
        for path in before.pending - state.pending:
            self.pending.removeKey((path,))
        for path in state.pending - before.pending:
            self.pending.updateValue((path,), (0,))
        self.held.update((state.full, state.due, state.verified, state.error))
        if before.due != state.due:
            if before.due is not None:
                self.handle.deleteTimer(before.due)
            if state.due is not None:
                self.handle.registerTimer(state.due)

    @staticmethod
    def _rows(key: tuple, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([{"workspace": key[0]} | r for r in rows])[[c.split()[0] for c in FLUSHES.split(", ")]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        least = timerValues.getCurrentWatermarkInMs()
        stamped = [(max(int(at.value // 1_000_000), least), kind, path) for at, kind, path in zip(batch["at"], batch["kind"], batch["path"], strict=True)]
        taken = sorted(stamped, key=lambda t: (t[0], t[1], t[2] or ""))
        state, before = self._load(), self._load()
        out = [f for at, kind, path in taken for f in state.notice(kind, path, at)]
        self._save(state, before)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, before = self._load(), self._load()
        if state.due is not None and state.due <= expiredTimerInfo.getExpiryTimeInMs():
            row = state.flush(state.due)
            before.due = None  # this timer is gone already
            self._save(state, before)
            yield from self._rows(key, [row] if row else [])

    def close(self) -> None:
        pass


def watch(noticed: DataFrame, bounds: Bounds = Bounds(), late: str = "10 seconds") -> DataFrame:
    """The flushes (:data:`FLUSHES`) of a stream of :func:`notices`."""
    return noticed.withWatermark("at", late).groupBy("workspace").transformWithStateInPandas(statefulProcessor=Watcher(bounds), outputStructType=FLUSHES, outputMode="append", timeMode="eventTime")


def blocked(outcomes: DataFrame) -> DataFrame:
    """Workspaces whose last outcome (workspace, kind, path, at) is a failure, with its message: their queries wait."""
    last = outcomes.filter(F.col("kind").isin("failed", "succeeded")).groupBy("workspace").agg(F.max_by(F.struct("kind", "path"), "at").alias("o"))
    return last.filter("o.kind = 'failed'").select("workspace", F.col("o.path").alias("error"))
