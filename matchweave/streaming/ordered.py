"""Order-dependent operators on streams whose rows arrive in any order.

A row's place is its ``order`` column, which must rise with its event time within a
key (a game's clock). State is kept per key by ``transformWithState`` and needs the
RocksDB state store (``keyed_state``). A row later than the watermark is dropped, as
Spark does everywhere; ``late`` says how much later rows may come.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_AT = "_at"  # event time in microseconds, the first column of every state row


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _wake(handle: StatefulProcessorHandle, at: int) -> None:
    """A timer at the first millisecond of the watermark that covers the microsecond ``at``."""
    when = -(-at // 1000)
    if when not in set(handle.listTimers()):
        handle.registerTimer(when)


class NextValue(StatefulProcessor):
    """Holds rows until all before the watermark are known, and the last of these until it has a follower."""

    def __init__(self, schema: T.StructType, order: str, value: str, name: str, idle: int):
        self.schema, self.order, self.value, self.idle = schema, schema.fieldNames().index(order), schema.fieldNames().index(value), idle
        self.row = Row(*schema.fieldNames()[1:], name)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        came = [tuple(r) for r in rows]
        self.rows.appendList(came)
        _wake(self.handle, min(r[0] for r in came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = timerValues.getCurrentWatermarkInMs() * 1000  # no row up to here can come any more
        held = sorted((tuple(r) for r in self.rows.get()), key=lambda r: r[self.order])
        sure = sum(r[0] <= known for r in held)
        for one, after in zip(held[: max(0, sure - 1)], held[1:sure], strict=True):
            yield self.row(*one[1:], after[self.value])
        held = held[max(0, sure - 1) :]
        if len(held) == 1 and held[0][0] + self.idle <= known:
            yield self.row(*held[0][1:], None)
            held = []
        if not held:
            self.rows.clear()
            return
        self.rows.put(held)
        waiting = [r[0] for r in held if r[0] > known]
        _wake(self.handle, min(waiting) if waiting else held[0][0] + self.idle)


class ForwardFill(StatefulProcessor):
    """Fills rows as they come, and again, under a new version, those that a later arrival changes."""

    def __init__(self, schema: T.StructType, by: list[str], order: str, columns: list[str]):
        names = schema.fieldNames()
        self.schema, self.by, self.order = schema, [names.index(b) for b in by], names.index(order)
        self.columns, self.types = [names.index(c) for c in columns], T.StructType([schema[c] for c in columns])
        self.row = Row(*by, order, *columns, "version")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", self.schema)
        self.base = handle.getValueState("base", self.types)  # what is in force before the oldest row kept
        self.version = handle.getValueState("version", T.StructType([T.StructField("version", T.LongType())]))

    def filled(self, rows: dict[int, tuple]) -> dict[int, tuple]:
        now = tuple(self.base.get() or ()) or (None,) * len(self.columns)
        out = {}
        for place in sorted(rows):
            now = out[place] = tuple(a if rows[place][c] is None else rows[place][c] for a, c in zip(now, self.columns, strict=True))
        return out

    def handleInputRows(self, key, rows, timerValues):
        held = {r[self.order]: tuple(r) for r in self.rows.get()}
        before, came = self.filled(held), {r[self.order]: tuple(r) for r in rows}
        held |= came
        after = self.filled(held)
        version = (tuple(self.version.get() or (0,)))[0] + 1
        self.version.update((version,))
        self.rows.put(list(held.values()))
        _wake(self.handle, min(r[0] for r in came.values()))
        for place, values in after.items():
            if place in came or values != before[place]:
                yield self.row(*[held[place][b] for b in self.by], place, *values, version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Forget rows that nothing can change, but for what they leave in force."""
        known = timerValues.getCurrentWatermarkInMs() * 1000
        held = {r[self.order]: tuple(r) for r in self.rows.get()}
        sure = {k: r for k, r in held.items() if r[0] <= known}
        if sure:
            self.base.update(self.filled(sure)[max(sure)])
            held = {k: r for k, r in held.items() if k not in sure}
            self.rows.put(list(held.values())) if held else self.rows.clear()
        if held:
            _wake(self.handle, min(r[0] for r in held.values()))
        return iter(())


def _timed(events: DataFrame, time_col: str, late: str, columns: list[str]) -> DataFrame:
    return events.withWatermark(time_col, late).select(F.unix_micros(time_col).alias(_AT), *columns)


def stream_next_value(events: DataFrame, column: str, by: list[str], time_col: str, order: str, name: str, late: str = "10 minutes", idle_seconds: int = 3 * 3600) -> DataFrame:
    """``sequence.next_value`` on a stream: rows with the following row's ``column`` within ``by``; append mode.

    A row comes out once the watermark has passed it and its follower. If none has
    come ``idle_seconds`` after it, in event time, it is the last and has null; a
    follower after a longer pause starts anew. State holds, for a key, the rows of
    the last ``late`` and one more. Null keys are a key; rows without a time are left
    out, as they can't be placed.
    """
    plain = [c for c in events.columns if c != time_col]
    timed = _timed(events.where(F.col(time_col).isNotNull()), time_col, late, plain)
    out = T.StructType([*[f for f in timed.schema.fields if f.name != _AT], T.StructField(name, timed.schema[column].dataType)])
    return timed.groupBy(*by).transformWithState(NextValue(timed.schema, order, column, name, idle_seconds * 1_000_000), out, "Append", "EventTime")


def stream_forward_fill(events: DataFrame, columns: list[str], by: list[str], time_col: str, order: str, late: str = "10 minutes") -> DataFrame:
    """``sequence.forward_fill`` on a stream, as updates: (by, order, columns, version); update mode.

    Each row is filled when it comes. A row that comes late with a value corrects
    those after it up to the next value; they come out again with a higher version, and
    ``latest`` keeps the last of each. A row sent again replaces itself (``order`` is
    unique in its key). State holds a key's rows of the last ``late`` and the values in
    force before them.
    """
    timed = _timed(events.where(F.col(time_col).isNotNull() & F.col(order).isNotNull()), time_col, late, [*by, order, *columns])
    fields = [timed.schema[c] for c in (*by, order, *columns)]
    out = T.StructType([*fields, T.StructField("version", T.LongType())])
    return timed.groupBy(*by).transformWithState(ForwardFill(timed.schema, by, order, columns), out, "Update", "EventTime")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The highest version of each row of an update stream's table; aggregated before the shuffle."""
    rest = [c for c in updates.columns if c not in (*keys, "version")]
    best = updates.groupBy(*keys).agg(F.max(F.struct("version", *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
