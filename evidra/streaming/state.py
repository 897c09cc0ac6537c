"""Stateful behaviours that depend on the order of one key's events: presence, quotas and leases, review grace.

Each is a small state machine per actor or claim; Spark partitions the keys and keeps the state in its state store. The
watermark drives expiry.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DAY_MS = 86_400_000


def _keyed(events: DataFrame, watermark: str, key: str):
    """Grouped stream with the event time also as ``ms`` (epoch milliseconds), the only time the processors use."""
    return events.withWatermark("at", watermark).withColumn("ms", F.unix_millis("at")).groupBy(key)


def _forget_after(handle, ms: int) -> None:
    """One timer per key, at ``ms``."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(ms)


class PresenceProcessor(StatefulProcessor):
    """State last shown per actor. An event with the same state and topic less than ``repeat`` seconds after that is dropped and changes
    nothing; a missing topic means the last one; silence expires."""

    def __init__(self, expire: int = 900, repeat: int = 10):
        self.expire, self.repeat = expire, repeat

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, doing string, topic string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ms = doing = topic = None
        if self.last.exists():
            ms, doing, topic = self.last.get()
        out = []
        for r in sorted(rows, key=lambda r: (r.ms, r.seq)):
            if ms is not None and r.ms < ms:
                continue
            now = r.topic if r.topic is not None else topic
            if ms is not None and (doing, topic) == (r.doing, now) and r.ms - ms < self.repeat * 1000:
                continue
            ms, doing, topic = r.ms, r.doing, now
            out.append(Row(actor=key[0], ms=ms, doing=doing, topic=topic, online=True))
        if out:
            self.last.update((ms, doing, topic))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms + self.expire * 1000)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            ms, doing, topic = self.last.get()
            self.last.clear()
            yield Row(actor=key[0], ms=ms, doing=doing, topic=topic, online=False)

    def close(self) -> None:
        pass


def presence(events: DataFrame, expire: int = 900, repeat: int = 10, watermark: str = "1 minute") -> DataFrame:
    """Stream of state changes: actor, at, doing, topic, online. events: actor, at (timestamp), seq, doing, topic."""
    out = (_keyed(events, watermark, "actor")
           .transformWithState(PresenceProcessor(expire, repeat), "actor long, ms long, doing string, topic string, online boolean", "Append", "EventTime"))
    return out.select("actor", F.timestamp_millis("ms").alias("at"), "doing", "topic", "online")


class QuotaProcessor(StatefulProcessor):
    """Admits at most ``quota`` submissions in any 24 hours (admitted ones count) and ``leases`` unexpired leases at once."""

    def __init__(self, quota: int = 5, leases: int = 3, lease_seconds: int = 1800):
        self.quota, self.leases, self.lease_seconds = quota, leases, lease_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "admitted array<bigint>, items array<string>, until array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        admitted, held = [], {}
        if self.state.exists():
            a, items, until = self.state.get()
            admitted, held = list(a), dict(zip(items, until))
        out = []
        for r in sorted(rows, key=lambda r: (r.ms, r.seq)):
            now = r.ms
            admitted = [t for t in admitted if t > now - DAY_MS]
            held = {k: u for k, u in held.items() if u > now}
            if r.kind == "release":
                ok = held.pop(r.item, None) is not None
            elif r.kind == "lease":
                ok = r.item in held or len(held) < self.leases
                if ok:
                    held[r.item] = now + self.lease_seconds * 1000
            else:
                ok = len(admitted) < self.quota
                if ok:
                    admitted.append(now)
            out.append(Row(actor=key[0], seq=r.seq, kind=r.kind, ok=ok))
        self.state.update((admitted, list(held), list(held.values())))
        _forget_after(self.handle, max([t + DAY_MS for t in admitted] + list(held.values()) + [timerValues.getCurrentWatermarkInMs() + 1]))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()  # every admission is a day old and every lease has run out
        return iter([])

    def close(self) -> None:
        pass


def quotas(requests: DataFrame, quota: int = 5, leases: int = 3, lease_seconds: int = 1800, watermark: str = "1 minute") -> DataFrame:
    """actor, seq, kind, ok for every request. requests: actor, at, seq, kind (submit / lease / release), item.

    Requests of one actor are decided in event-time order within a micro-batch.
    """
    return (_keyed(requests, watermark, "actor")
            .transformWithState(QuotaProcessor(quota, leases, lease_seconds), "actor long, seq long, kind string, ok boolean", "Append", "EventTime"))


class DailyRequestProcessor(StatefulProcessor):
    """A target counts once per visitor, at most ``per_day`` a day; a refused request leaves no trace. A visitor who has not been seen for
    ``keep_days`` is forgotten."""

    def __init__(self, per_day: int = 10, keep_days: int = 400):
        self.per_day, self.keep_days = per_day, keep_days

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "target string", "day string")
        self.days = handle.getMapState("days", "day string", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out, last = [], 0
        for r in sorted(rows, key=lambda r: (r.ms, r.seq)):
            if self.seen.containsKey((r.target,)):
                last = max(r.ms, last)
                continue
            day = r.day
            n = self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0
            if n < self.per_day:
                self.seen.updateValue((r.target,), (day,))
                self.days.updateValue((day,), (n + 1,))
                out.append(Row(visitor=key[0], target=r.target, seq=r.seq))
            last = max(r.ms, last)
        if last:
            newest = sorted(d[0] for d in self.days.keys())[-3:]
            for d in [d[0] for d in self.days.keys()]:  # counters of days that no event can reach any more
                if d not in newest:
                    self.days.removeKey((d,))
            _forget_after(self.handle, last + self.keep_days * DAY_MS)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        self.days.clear()
        return iter([])

    def close(self) -> None:
        pass


def unique_requests(requests: DataFrame, per_day: int = 10, watermark: str = "1 minute") -> DataFrame:
    """visitor, target, seq of the counted requests. requests: visitor, target (string), at, seq."""
    return (_keyed(requests.withColumn("day", F.date_format("at", "yyyy-MM-dd")), watermark, "visitor")
            .transformWithState(DailyRequestProcessor(per_day), "visitor long, target string, seq long", "Append", "EventTime"))


class GraceProcessor(StatefulProcessor):
    """Emits a claim once ``wait`` seconds of event time passed after its proposal without a review or challenge. A settled claim is
    forgotten ``keep`` seconds later."""

    def __init__(self, wait: int, keep: int = 30 * 86_400):
        self.wait, self.keep = wait, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.touched = handle.getValueState("touched", "proposed long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        proposed, done = self.touched.get() if self.touched.exists() else (None, False)
        for r in sorted(rows, key=lambda r: r.ms):
            if r.kind == "proposed" and proposed is None:
                proposed = r.ms
                if not done:
                    self.handle.registerTimer(proposed + self.wait * 1000)
            elif r.kind != "proposed":
                done = True
            latest = r.ms
        if done:
            _forget_after(self.handle, latest + self.keep * 1000)
        self.touched.update((proposed, done))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        proposed, done = self.touched.get()
        if done:
            self.touched.clear()
            return
        self.touched.update((proposed, True))
        _forget_after(self.handle, expiredTimerInfo.getExpiryTimeInMs() + self.keep * 1000)
        yield Row(claim_id=key[0], proposed=proposed)

    def close(self) -> None:
        pass


def review_grace(events: DataFrame, wait: int = 600, watermark: str = "1 minute") -> DataFrame:
    """claim_id, proposed. events: claim_id, at, kind (proposed / review / challenge)."""
    out = _keyed(events, watermark, "claim_id").transformWithState(GraceProcessor(wait), "claim_id long, proposed long", "Append", "EventTime")
    return out.select("claim_id", F.timestamp_millis("proposed").alias("proposed"))
