"""Bursts of events that end when nothing happened for a while, by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Quiet(StatefulProcessor):
    """One row for each burst of a key's events that has been quiet for ``gap`` milliseconds.

    Times are whole milliseconds, the nearest ones (a half goes away from zero).
    Events wait until the watermark is past them and are then taken in order of time, so
    batches and the order of arrival decide nothing. An event opens a burst or belongs to
    the open one, and starts the burst's clock anew if it has another ``value`` than the
    one before, or always with ``rearm``; a null value counts as the same. Of events of one
    time those that are ``over`` come last, then they go by value, nulls last. An event that is ``over`` drops the open burst
    and gives a row itself. A key whose burst has settled keeps no state; the only timer
    is that of its next waiting event or of its clock.
    """

    def __init__(self, keys: list[str], gap: int, rearm: bool, kind: str) -> None:
        self.keys, self.gap, self.rearm, self.kind = keys, gap, rearm, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"ms long, value {self.kind}, over boolean")
        self.burst = handle.getValueState("burst", f"start long, since long, value {self.kind}, n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self.waiting.appendList([(r.ms, r.value, r.over) for r in rows])
        yield from self._go_on(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._go_on(key, timerValues.getCurrentWatermarkInMs())

    def _row(self, key: Any, start: int, end: int, value: Any, n: int, over: bool) -> Row:
        return Row(**dict(zip(self.keys, key)), start_ms=start, end_ms=end, value=value, n=n, over=over)

    def _go_on(self, key: Any, now: int) -> Iterator[Row]:
        events = sorted(((ms, over, value) for ms, value, over in self.waiting.get()), key=lambda e: (e[0], e[1], e[2] is None, 0 if e[2] is None else e[2]))
        burst = self.burst.get() if self.burst.exists() else None
        rest = [e for e in events if e[0] > now]
        for ms, over, value in events[: len(events) - len(rest)]:
            if burst and ms >= burst[1] + self.gap:
                yield self._row(key, burst[0], burst[1] + self.gap, burst[2], burst[3], False)
                burst = None
            if over:
                burst = None
                yield self._row(key, ms, ms, value, 1, True)
            elif burst is None:
                burst = (ms, ms, value, 1)
            else:
                other = None not in (value, burst[2]) and value != burst[2]
                burst = (burst[0], ms if self.rearm or other else burst[1], value, burst[3] + 1)
        if burst and burst[1] + self.gap <= now:
            yield self._row(key, burst[0], burst[1] + self.gap, burst[2], burst[3], False)
            burst = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.waiting.put([(ms, value, over) for ms, over, value in rest])
        else:
            self.waiting.clear()
        if burst:
            self.burst.update(tuple(burst))
        else:
            self.burst.clear()
        if rest or burst:
            self.handle.registerTimer(min([e[0] for e in rest[:1]] + ([burst[1] + self.gap] if burst else [])))

    def close(self) -> None:
        pass


def _quiet(events: DataFrame, ts: str, keys: tuple[str, ...], gap_ms: int, late: str, value: str | None, over: str | None) -> DataFrame:
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)  # timers need a store with column families
    ms = F.floor(F.round(F.unix_micros(F.col(ts).cast("timestamp")), -3) / 1000)
    kind = events.schema[value].dataType.simpleString() if value else "string"
    # the watermark counts the same milliseconds as the bursts
    ready = events.select(*keys, F.timestamp_millis(ms).alias(ts), ms.alias("ms"), (F.col(value) if value else F.lit(None).cast("string")).alias("value"), (F.coalesce(F.expr(over), F.lit(False)) if over else F.lit(False)).alias("over"))
    ready = ready.where(f"{ts} IS NOT NULL").withWatermark(ts, late)
    out = T.StructType([*(events.schema[k] for k in keys), *T.StructType.fromDDL(f"start_ms long, end_ms long, value {kind}, n long, over boolean")])
    return ready.groupBy(*keys).transformWithState(Quiet(list(keys), gap_ms, value is None, kind), out, "Append", "EventTime")


def debounced(events: DataFrame, ts: str, gap_ms: int, *keys: str, late: str = "1 hour") -> DataFrame:
    """``(*keys, start_ms, sent_ms, n)``: one notice for each burst of events; each event starts the wait of ``gap_ms`` anew."""
    return _quiet(events, ts, keys, gap_ms, late, None, None).select(*keys, "start_ms", F.col("end_ms").alias("sent_ms"), "n")


def settled(events: DataFrame, ts: str, *keys: str, size: str = "size", gone: str = "event = 'unlink'", gap_ms: int = 5_000, late: str = "1 minute") -> DataFrame:
    """``(*keys, action, start_ms, at_ms, size, n)``: what to do about watched files.

    ``sync`` once a file's ``size`` has not changed for ``gap_ms``, with how many events
    it had since ``start_ms``; ``remove`` when a file is ``gone``, which also cancels the wait.
    """
    found = _quiet(events, ts, keys, gap_ms, late, size, gone)
    return found.select(*keys, F.when(F.col("over"), "remove").otherwise("sync").alias("action"), "start_ms", F.col("end_ms").alias("at_ms"), F.col("value").alias("size"), "n")
