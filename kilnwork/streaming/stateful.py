"""Folds over the steps of a key as streams: state in lists and maps of the state store, not in memory.

Steps of a key are numbered from ``first`` on, as an event log numbers them, and may come in any order
and over any micro-batches: a step that comes early waits in a list until those before it are there. The
state outlives the query: a stream that starts again on the same checkpoint goes on with it. A key
whose ``last`` step has passed keeps its numbers only; its lists and maps are cleared.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHECKS = ("run_test", "read_file", "git_diff")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps maps and lists, for the streams started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class _Ordered(StatefulProcessor):
    """Hands the steps of a key to ``fold`` in order of their numbers."""

    #: Columns of a step besides key and order, all strings, and the numbers that fold keeps.
    fields: tuple[str, ...] = ()
    kept: tuple[str, ...] = ()

    def __init__(self, key: str, key_type: str, order: str, columns: tuple[str, ...], first: int, last: str | None):
        self.key, self.key_type, self.order, self.columns, self.first_order, self.last = key, key_type, order, columns, first, last

    def output(self) -> str:
        return ", ".join([f"{self.key} {self.key_type}", *(f"{c} int" for c in self.kept), "steps int", "waiting int"])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", ", ".join(["next int", "steps int", *(f"{c} int" for c in self.kept)]))
        self.waiting = handle.getListState("waiting", ", ".join(["o int", *(f"{c} string" for c in self.fields)]))
        self.maps(handle)

    def maps(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def clear_maps(self) -> None:
        raise NotImplementedError

    def fold(self, step: tuple, kept: list[int]) -> None:
        """Change ``kept`` and the maps by one step (its fields in order)."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        steps = [(r[self.order], *(r[c] for c in self.columns)) for r in rows]
        held = self.progress.get() if self.progress.exists() else (self.first_order, 0, *(0 for _ in self.kept))
        following, done, kept = held[0], held[1], list(held[2:])
        early = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rest, over = [], False
        for o, *step in sorted(early + steps, key=lambda s: s[0]):
            if o > following:
                rest.append((o, *step))
            elif o == following:
                self.fold(tuple(step), kept)
                following, done, over = o + 1, done + 1, over or step[0] == self.last
            # a step that has passed already, as a batch may be sent again, counts no more
        self.progress.update((following, done, *kept))
        if rest:
            self.waiting.put(list(dict.fromkeys(rest)))
        elif early:
            self.waiting.clear()
        if over and self.last is not None:
            self.clear_maps()
        yield Row(**dict(zip([self.key, *self.kept, "steps", "waiting"], [key[0], *kept, done, len({r[0] for r in rest})])))

    def close(self) -> None:
        pass


class RepairGuard(_Ordered):
    """rejected, repeated: edits that break the read-edit-check rules, as ``sequence.repair_guard``."""

    fields, kept = ("action", "path", "old"), ("must_check", "rejected", "repeated")

    def maps(self, handle):
        self.opened = handle.getMapState("opened", "path string", "yes boolean")
        self.seen = handle.getMapState("seen", "path string, old string", "yes boolean")

    def clear_maps(self):
        self.opened.clear()
        self.seen.clear()

    def fold(self, step, kept):
        action, path, old = step
        if action == "edit_file":
            edit = (path or "", old or "")
            if not self.opened.containsKey((path or "",)):
                kept[1] += 1
            elif self.seen.containsKey(edit):
                kept[2] += 1
            elif kept[0]:
                kept[1] += 1
            else:
                self.seen.updateValue(edit, (True,))
                kept[0] = 1
        elif action in CHECKS:
            kept[0] = 0
        if action == "read_file":
            self.opened.updateValue((path or "",), (True,))


class UnsurfacedAccess(_Ordered):
    """leaked: whether a guarded file (guarded = 'true') was read or edited before anything else
    surfaced it, as ``sequence.unsurfaced_access``."""

    fields, kept = ("action", "path", "guarded"), ("leaked",)

    def maps(self, handle):
        self.surfaced = handle.getMapState("surfaced", "path string", "yes boolean")

    def clear_maps(self):
        self.surfaced.clear()

    def fold(self, step, kept):
        action, path, guarded = step
        if guarded == "true" and path is not None and not self.surfaced.containsKey((path,)):
            self.surfaced.updateValue((path,), (True,))
            kept[0] = int(kept[0] or action in ("read_file", "edit_file"))


def folded(steps: DataFrame, kind: type[_Ordered], key: str, order: str, columns: tuple[str, ...], first: int = 0, last: str | None = None) -> DataFrame:
    """A row for a key whenever a micro-batch brings steps of it: what the fold keeps, how many steps
    it has taken, and how many wait; the last row of a key is its state now. ``last``: the action that
    ends a key's steps, if one does. The stream must be started inside of ``state_store``."""
    fold = kind(key, steps.schema[key].dataType.simpleString(), order, columns, first, last)
    rows = steps.select(key, steps[order].cast("int").alias(order), *(steps[c].cast("string").alias(c) for c in columns)).filter(steps[order].isNotNull())
    return rows.groupBy(key).transformWithState(fold, StructType.fromDDL(fold.output()), "Update", "None")
