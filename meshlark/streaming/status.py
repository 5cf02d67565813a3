"""The live status of storage bins: one stateful stream per key, with timers and event time.

Readings wait in the state until the watermark has passed them and are then taken in their own order, so that a row's
result does not depend on how readings were batched or on how late (within the watermark) they came. Between readings
deadlines fall due: a bin out of band for the dwell time is in excursion though nothing new has come, one that is silent
is stale, and one that stays silent is offline. A deadline is a timer in the state store: it fires without data of the key.

The trailing window is kept as sums by time bucket, beside the bucket's samples. A reading touches the newest bucket, and
the oldest as far as it expires: each sample enters and leaves once, whatever the window holds, and nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import lists

#: Buckets of a window.
BUCKETS = 64
READING = "us long, seq long, temp_c double, other_c double, rh_pct double, control string"
STATE = "last_us long, last_temp double, last_kept long, since long, latched boolean, fault string, status string, watched string, armed long"
SUMS = "bucket array<long>, n array<long>, total array<double>, rate array<double>, span array<double>, first array<long>, gone array<long>"
OUT = "key string, at timestamp, seq long, event string, temp_c double, mkt_c double, mean_c double, span_s double, held_s double, excursion boolean, latched boolean, fault string, status string, changed boolean"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Rules:
    """The fixed rules of the bins of a stream."""

    def __init__(self, low: float, high: float, ceiling: float | None, rh_max: float | None = None, window_s: float = lists.WINDOW_S, min_window_s: float = lists.MIN_WINDOW_S, dwell_s: float = lists.DWELL_S, stale_s: float = lists.STALE_S, offline_s: float | None = None, tolerance: float = lists.CROSS_CHECK_C):
        self.low, self.high, self.ceiling, self.rh_max, self.min_window_s, self.tolerance = low, high, ceiling, rh_max, min_window_s, tolerance
        self.window_us, self.dwell_us, self.stale_ms = int(window_s * 1e6), int(dwell_s * 1e6), int(stale_s * 1e3)
        self.offline_ms = None if offline_s is None else int(offline_s * 1e3)
        self.bucket_us = max(1, self.window_us // BUCKETS)


def rate(temp: float) -> float:
    return math.exp(-lists.ACTIVATION / (lists.GAS * (temp + 273.15)))


class Window:
    """The trailing window of a key. `sums` has a row per bucket (oldest first) and `samples(bucket)` its samples."""

    def __init__(self, rules: Rules, sums: list[list], load, store, drop):
        self.rules, self.rows, self.load, self.store, self.drop = rules, sums, load, store, drop
        self.held: dict[int, tuple[list[int], list[float]]] = {}
        self.stored = {r[0] for r in sums}  # what the state holds; other buckets live here alone until they are saved
        self.refresh()

    def refresh(self) -> None:
        self.n, self.total, self.weighed, self.span = (sum(r[i] for r in self.rows) for i in (1, 2, 3, 4))

    def samples(self, bucket: int) -> tuple[list[int], list[float]]:
        if bucket not in self.held:
            self.held[bucket] = self.load(bucket)
        return self.held[bucket]

    def lasted(self, seconds: float, temp: float) -> None:
        """The newest sample turns out to have lasted so long."""
        if self.rows:
            row = self.rows[-1]
            row[3] += rate(temp) * seconds
            row[4] += seconds
            self.weighed += rate(temp) * seconds
            self.span += seconds

    def add(self, us: int, temp: float) -> None:
        bucket = us // self.rules.bucket_us
        if not self.rows or self.rows[-1][0] != bucket:
            self.rows.append([bucket, 0, 0.0, 0.0, 0.0, us, 0])
            self.held[bucket] = ([], [])
        at, temps = self.samples(bucket)
        at.append(us)
        temps.append(temp)
        self.rows[-1][1] += 1
        self.rows[-1][2] += temp
        self.n += 1
        self.total += temp
        self.expire(us - self.rules.window_us)

    def expire(self, start: int) -> None:
        """Samples before `start` go; of the oldest bucket `gone` have."""
        while self.rows[0][5] < start:
            row = self.rows[0]
            at, temps = self.samples(row[0])
            i = row[6]
            following = at[i + 1] if i + 1 < len(at) else self.rows[1][5] if len(self.rows) > 1 else None
            if i + 1 == len(at):  # the bucket is empty: its sums go, with what rounding has left in them
                self.rows.pop(0)
                self.held.pop(row[0])
                if row[0] in self.stored:
                    self.stored.remove(row[0])
                    self.drop(row[0])
                self.refresh()
                continue
            seconds = max((following - at[i]) / 1e6, 1e-9)
            row[1], row[2], row[3], row[4] = row[1] - 1, row[2] - temps[i], row[3] - rate(temps[i]) * seconds, row[4] - seconds
            self.n, self.total, self.weighed, self.span = self.n - 1, self.total - temps[i], self.weighed - rate(temps[i]) * seconds, self.span - seconds
            row[5], row[6] = at[i + 1], i + 1

    def save(self) -> list[list]:
        for bucket, held in self.held.items():
            self.store(bucket, held)
        return self.rows


class BinWatch(StatefulProcessor):
    """Keeps a key's bin. Its time is the watermark (timers of event time)."""

    def __init__(self, rules: Rules, changes_only: bool):
        self.rules, self.changes_only = rules, changes_only

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.sums = handle.getValueState("sums", SUMS)
        self.buckets = handle.getMapState("samples", "bucket long", "at array<long>, temps array<double>")
        self.pending = handle.getListState("pending", READING)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        """Readings wait; the earliest one sets the timer."""
        first = None
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            new = list(zip(*(part[c].tolist() for c in ("us", "seq", "temp_c", "other_c", "rh_pct", "control")), strict=True))
            self.pending.appendList(new)
            first = min([x[0] // 1000 for x in new] + ([first] if first is not None else []))
        s = self.read()
        if first is not None and (s["armed"] is None or first < s["armed"]):
            self.arm(s, first)
            self.write(s)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now, s = timerValues.getCurrentWatermarkInMs(), self.read()
        if s["armed"] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        s["armed"] = None
        due, later = [], []
        for x in self.pending.get():
            (due if x[0] // 1000 <= now else later).append(tuple(x))
        self.pending.put(later) if later else self.pending.clear()
        out: list[tuple] = []
        window = self.window()
        for x in sorted(due, key=lambda x: (x[0], x[1])):
            self.deadlines(s, x[0] // 1000, False, out)
            window = self.take(s, window, x, out)
        self.deadlines(s, now, True, out)
        self.put_window(window)
        waits = [d for d in [self.next_deadline(s), *(x[0] // 1000 for x in later)] if d is not None]
        if waits:
            self.arm(s, min(waits))
        self.write(s)
        rows = [(key[0], *r) for r in out if r[-1] or not self.changes_only]
        if not rows:
            return iter(())
        frame = pd.DataFrame(rows, columns=[f.split()[0] for f in OUT.split(", ")])
        frame["at"] = pd.to_datetime(frame["at"], unit="us", utc=True)
        frame["seq"] = frame["seq"].astype("Int64")
        for c in ("temp_c", "mkt_c", "mean_c", "span_s", "held_s"):
            frame[c] = frame[c].astype("float64")
        return iter([frame])

    # what the state holds

    def read(self) -> dict:
        names = [f.split()[0] for f in STATE.split(", ")]
        got = self.state.get() if self.state.exists() else None
        return dict(zip(names, got if got is not None else (None, None, None, None, False, None, "offline", None, None), strict=True))

    def write(self, s: dict) -> None:
        self.state.update(tuple(s.values()))

    def arm(self, s: dict, at: int) -> None:
        if s["armed"] is not None:
            self.handle.deleteTimer(s["armed"])
        self.handle.registerTimer(at)
        s["armed"] = at

    def window(self) -> Window:
        rows = [list(r) for r in zip(*self.sums.get(), strict=True)] if self.sums.exists() else []

        def load(bucket: int) -> tuple[list[int], list[float]]:
            at, temps = self.buckets.getValue((bucket,))
            return list(at), list(temps)

        return Window(self.rules, rows, load, lambda bucket, held: self.buckets.updateValue((bucket,), held), lambda bucket: self.buckets.removeKey((bucket,)))

    def put_window(self, window: Window) -> None:
        rows = window.save()
        self.sums.update(tuple(list(c) for c in zip(*rows, strict=True))) if rows else self.sums.clear()

    # the rules

    def take(self, s: dict, window: Window, x: tuple, out: list) -> Window:
        us, seq, temp, other, rh, control = x
        if control == "reset":
            self.buckets.clear()
            self.sums.clear()
            s |= {"last_us": None, "last_temp": None, "last_kept": None, "since": None, "latched": False, "fault": None, "status": "offline"}
            return self.window()
        r, mkt, mean, span = self.rules, None, None, None
        s["fault"] = "primary sensor silent" if temp is None else "sensors disagree" if other is not None and abs(temp - other) > r.tolerance else None
        if temp is not None:
            before = max((us - s["last_kept"]) / 1e6, 1e-9) if s["last_kept"] is not None else None
            if before is not None:
                window.lasted(before, s["last_temp"])
            window.add(us, temp)
            mean, span = window.total / window.n, (us - window.rows[0][5]) / 1e6
            if window.n == 1:
                mkt = temp
            else:
                mkt = lists.ACTIVATION / lists.GAS / -math.log((window.weighed + before * rate(temp)) / (window.span + before)) - 273.15
            s["last_kept"], s["last_temp"] = us, temp
            ok = r.low <= temp <= r.high and (rh is None or r.rh_max is None or rh <= r.rh_max)
            s["since"] = None if ok else us if s["since"] is None else s["since"]
            s["latched"] = bool(s["latched"] or r.ceiling is not None and span >= r.min_window_s and mkt > r.ceiling)
        s["last_us"] = us
        held = None if s["since"] is None else us - s["since"]
        s["status"] = self.status(s, held)
        watched = repr((s["status"], temp, other, rh, None if mkt is None else round(mkt, 6)))
        changed, s["watched"] = watched != s["watched"], watched
        out.append((us, seq, "reading", temp, mkt, mean, span, None if held is None else held / 1e6, held is not None and held >= r.dwell_us, s["latched"], s["fault"], s["status"], changed))
        return window

    def status(self, s: dict, held: int | None) -> str:
        if s["latched"]:
            return "mkt_breach"
        if s["fault"] is not None:
            return "sensor_fault"
        return "excursion" if held is not None and held >= self.rules.dwell_us else "ok"

    def next_deadline(self, s: dict) -> int | None:
        """When, in ms, the status changes by silence alone."""
        if s["last_us"] is None or s["status"] == "offline":
            return None
        last, waits = s["last_us"] // 1000, []
        if s["status"] == "ok" and s["since"] is not None:
            waits.append(-(-(s["since"] + self.rules.dwell_us) // 1000))
        if s["status"] != "stale":
            waits.append(last + self.rules.stale_ms)
        elif self.rules.offline_ms is not None:
            waits.append(last + self.rules.offline_ms)
        return min(waits, default=None)

    def deadlines(self, s: dict, upto: int, inclusive: bool, out: list) -> None:
        """Deadlines before (or at) `upto` ms fall due, one after the other."""
        while (at := self.next_deadline(s)) is not None and (at < upto or inclusive and at == upto):
            silent = at - s["last_us"] // 1000
            if self.rules.offline_ms is not None and silent >= self.rules.offline_ms:
                s["status"] = "offline"
            else:
                s["status"] = "stale" if silent >= self.rules.stale_ms else "excursion"
            held = None if s["since"] is None else (at * 1000 - s["since"]) / 1e6
            out.append((at * 1000, None, "deadline", None, None, None, None, held, held is not None and held * 1e6 >= self.rules.dwell_us, s["latched"], s["fault"], s["status"], True))
            s["watched"] = None


def status_stream(readings: DataFrame, rules: Rules, delay: str = "0 seconds", changes_only: bool = True) -> DataFrame:
    """A streaming readings(key string, ts timestamp, seq long, temp_c, other_c, rh_pct double, control string) -> a row for
    each reading, and for each deadline that silence lets pass: columns of OUT. `changed` tells whether status, temperature
    or humidity readings or the kinetic temperature differ from the row before; with changes_only only such rows come.

    `delay` is how late a reading may come; later ones are dropped. A row with control 'reset' clears its key.
    """
    due = readings.withColumn("us", F.unix_micros("ts")).withColumn("due", F.timestamp_millis(F.floor(F.col("us") / 1000).cast("long")))
    due = due.select("key", "us", "seq", *[F.col(c).cast("double").alias(c) for c in ("temp_c", "other_c", "rh_pct")], "control", "due").withWatermark("due", delay)
    return due.groupBy("key").transformWithStateInPandas(BinWatch(rules, changes_only), OUT, "append", "EventTime")


def replayed(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what there is to its end, and give what it wrote. The folder keeps its state: a later call goes on."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/stream").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
