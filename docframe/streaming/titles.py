"""First sightings in a stream: the first time a title is seen for a key, by event time, told once it is certain.

Keyed state with timers. The state of a key is one value: for each of its titles,
when it was told last and at which times it has been seen since the watermark. A
row older than the watermark is late and dropped. A title is told when the
watermark passes its first time, as no earlier row can count any more; a key has
one timer, which wakes it at the first of these, and then tells all that are due.
So a batch reads and writes a key's state once, however many titles it has. Keys
of very many titles are dealt into ``slots`` by title, each a state of its own. With ``forget`` a title that is seen so long after it was told last, or
later, is new again, and its state is given up as soon as nothing can depend on
it. State and timers are kept in the checkpoint, so a stream that starts again
goes on where it was, and its results depend on how arrivals are cut to batches
only by what is late.

Defined results: rows with a null key, title or time are dropped; repeated rows
change nothing; of equal times the title is told once; titles that the last
watermark has not passed are not told yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docframe.ship import ship

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _passed(us: int) -> int:
    """The first millisecond at which a watermark has passed a time."""
    return us // 1000 + 1


class FirstSeen(StatefulProcessor):
    def __init__(self, forget_us: int | None):
        self.forget_us = forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "title array<string>, told_us array<long>, pending array<array<long>>, wake_ms long")

    def _load(self) -> tuple[dict[str, tuple[int | None, list[int]]], int | None]:
        """What is known of each title (told last, seen since), and when the key's timer is set to."""
        got = self.seen.get() if self.seen.exists() else None
        if got is None:
            return {}, None
        return {t: (told, list(pending)) for t, told, pending in zip(*got[:3], strict=True)}, got[3]

    def _store(self, known: dict[str, tuple[int | None, list[int]]], wake: int | None) -> None:
        """One timer wakes the key: when the first of its times is passed, or the first of its titles forgotten."""
        if not known:
            self.seen.clear()
            return
        times = [_passed(pending[0]) if pending else _passed(told + self.forget_us) for told, pending in known.values() if pending or self.forget_us is not None]
        first = min(times, default=None)
        if first is not None and (wake is None or first < wake):
            self.handle.registerTimer(first)
            wake = first
        self.seen.update((list(known), [told for told, _ in known.values()], [pending for _, pending in known.values()], wake))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        late = timerValues.getCurrentWatermarkInMs() * 1000
        new: dict[str, set[int]] = {}
        for r in rows:
            if r.us >= late:
                new.setdefault(r.title, set()).add(r.us)
        if not new:
            return iter(())
        known, wake = self._load()
        changed = False
        for title, times in new.items():
            told, pending = known.get(title, (None, []))
            if self.forget_us is None:
                if told is not None:
                    continue
                times = {min([*times, *pending])}
            if times.difference(pending):
                known[title] = (told, sorted(times.union(pending) if self.forget_us is not None else times))
                changed = True
        if changed:
            self._store(known, wake)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        known, wake = self._load()
        left = {}
        for title, (told, pending) in known.items():
            due = [us for us in pending if _passed(us) < mark]  # as timers do, which expire before the watermark
            for us in due:
                if told is None or self.forget_us is not None and us >= told + self.forget_us:
                    out.append(Row(key=key[0], title=title, us=us))
                    told = us
            pending = pending[len(due) :]
            if pending or self.forget_us is None or _passed(told + self.forget_us) >= mark:
                left[title] = (told, pending)
        self._store(left, None if wake is None or wake < mark else wake)
        return iter(out)

    def close(self) -> None:
        pass


def first_seen(arrivals: DataFrame, key: str, title: str, at: str, delay: timedelta, forget: timedelta | None = None, slots: int = 1) -> DataFrame:
    """(key, title, first_seen) of a stream with a key (string), titles and event times, which may be late by ``delay``.

    Keyed state needs the RocksDB state store, which is set for the session.
    """
    spark: SparkSession = ship(arrivals.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = arrivals.select(F.col(key).cast("string").alias("key"), F.col(title).cast("string").alias("title"), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    rows = rows.dropna().withColumn("slot", F.pmod(F.xxhash64("title"), F.lit(slots))).withWatermark("at", f"{int(delay.total_seconds() * 1000)} milliseconds")
    forget_us = None if forget is None else int(forget.total_seconds() * 1_000_000)
    told = rows.groupBy("key", "slot").transformWithState(FirstSeen(forget_us), "key string, title string, us long", "Append", "EventTime")
    return told.select("key", "title", F.timestamp_micros("us").alias("first_seen"))
