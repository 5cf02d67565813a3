"""The live status stream: silence, late readings, batches of any cut, resets, and work that grows with the readings."""

import random
import time

import pytest
from pyspark.sql import functions as F

from meshlark.streaming import status as S

READINGS = "key string, s double, seq long, temp_c double, other_c double, rh_pct double, control string"
#: A stream begins with its watermark at second 0, at which nothing may come any more.
START = 1000
COLUMNS = ["key", "at", "seq", "event", "temp_c", "mkt_c", "mean_c", "span_s", "held_s", "excursion", "latched", "fault", "status", "changed"]


def run(spark, tmp_path, batches, rules, delay="0 seconds", **params):
    """Each batch of rows is a file that the stream takes by itself; the last one only moves time on."""
    folder = f"{tmp_path}/{random.randrange(10**9)}"
    for i, rows in enumerate(batches):
        rows = spark.createDataFrame(rows, READINGS).withColumn("ts", F.timestamp_micros(F.round((F.col("s") + START) * 1e6).cast("long"))).drop("s")
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.01)
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = S.replayed(spark, S.status_stream(src, rules, delay, **params), f"file://{folder}/work")
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.withColumn("at", F.unix_micros("at") / 1e6 - START).collect()), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))


def reading(key, s, temp, seq=0, other=None, rh=None, control=None):
    return (key, float(s), seq, temp, other, rh, control)


def told(rows, key):
    return [(r[1], r[3], r[12]) for r in rows if r[0] == key]


def test_silence_alone_changes_the_status(spark, tmp_path):
    """One bin stops, another goes on: dwell, staleness and absence fall due without a reading."""
    rules = S.Rules(20, 25, None, dwell_s=8, stale_s=30, offline_s=100)
    rows = [reading("a", 0, 22.0), reading("a", 10, 27.0)] + [reading("b", t, 22.0) for t in range(0, 201, 10)]
    got = run(spark, tmp_path, [rows], rules)
    assert told(got, "a") == [(0, "reading", "ok"), (10, "reading", "ok"), (18, "deadline", "excursion"), (40, "deadline", "stale"), (110, "deadline", "offline")]
    assert told(got, "b") == [(0, "reading", "ok")]  # nothing else changes
    # a bin that comes back says so
    got = run(spark, tmp_path, [rows, [reading("a", 205, 22.0), reading("b", 210, 22.0)], [reading("b", 220, 22.0)]], rules)
    assert told(got, "a")[-1] == (205, "reading", "ok")


@pytest.mark.parametrize("cut", [1, 4])
def test_rows_do_not_depend_on_batches_or_arrival(spark, tmp_path, cut):
    rng = random.Random(3)
    rules = S.Rules(20, 25, 24.0, rh_max=60.0, window_s=600, min_window_s=100, dwell_s=20, stale_s=45)
    rows, s = [], 0.0
    for i in range(160):
        s += rng.choice([1, 5, 20, 50, 200])
        rows.append(reading(rng.choice("ab"), s, rng.choice([None, 19.0, 22.5, 24.0, 30.0]), i, rng.choice([None, 22.0]), rng.choice([None, 50.0, 70.0])))
    want = run(spark, tmp_path, [rows], rules, changes_only=False)
    assert {"ok", "excursion", "sensor_fault", "stale", "mkt_breach"} <= {r[12] for r in want}
    size = len(rows) // cut
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    for p in parts:
        rng.shuffle(p)
    if cut > 1:  # readings at a border come a batch late
        parts[1].append(parts[0].pop())
    end = [reading("z", s + 5000, 22.0, 999)]  # moves the watermark behind the delay
    got = run(spark, tmp_path, [*parts, end], rules, delay="3600 seconds", changes_only=False)
    assert [r for r in got if r[0] != "z" and r[1] <= s] == [r for r in want if r[1] <= s]


def test_resets_and_changes(spark, tmp_path):
    rules = S.Rules(20, 25, 25.0, min_window_s=5, dwell_s=8, stale_s=30)
    rows = [reading("a", t, 40.0, t) for t in range(0, 10)] + [reading("a", 10, None, 10, control="reset"), reading("a", 11, 22.0, 11), reading("a", 12, 22.0, 12), reading("a", 13, 22.0, 13)]
    got = run(spark, tmp_path, [rows], rules)
    assert got[-2][12] == "mkt_breach" and got[-1][1:5] == (11, 11, "reading", 22.0) and got[-1][12] == "ok" and got[-1][5] == 22.0
    every = run(spark, tmp_path, [rows], rules, changes_only=False)
    assert [r for r in every if r[13]] == got and len(every) == len(rows) - 1


def window_of(n, rules):
    kept = {}
    w = S.Window(rules, [], kept.__getitem__, kept.__setitem__, lambda b: kept.pop(b, None))
    for i in range(n):
        if i:
            w.lasted(1.0, 20 + (i - 1) % 7)
        w.add(i * 1_000_000, 20 + i % 7)
    return w


def test_a_long_window_costs_as_many_steps_as_readings():
    rules = S.Rules(20, 25, None, window_s=20_000)
    began = time.process_time()
    w = window_of(60_000, rules)
    took = time.process_time() - began
    assert w.n == 20_001 and len(w.rows) <= S.BUCKETS + 2 and took < 6
    temps = [20 + i % 7 for i in range(60_000 - 20_001, 60_000)]
    assert w.total == pytest.approx(sum(temps)) and w.weighed == pytest.approx(sum(map(S.rate, temps[:-1]))) and w.span == pytest.approx(20_000)


def test_only_stored_buckets_are_removed():
    """A bucket that comes and goes within one call costs the state store nothing."""
    rules, kept, dropped = S.Rules(20, 25, None, window_s=640), {}, []

    def window(sums):
        return S.Window(rules, [list(r) for r in sums], lambda b: kept[b], kept.__setitem__, lambda b: (kept.pop(b), dropped.append(b)))

    first = window([])
    for s in range(0, 10_000, 100):
        first.add(s * 1_000_000, 22.0)
    sums = first.save()
    assert not dropped and len(kept) == len(sums) == 7
    second = window(sums)
    for s in range(10_000, 20_000, 100):
        second.add(s * 1_000_000, 23.0)
    assert len(dropped) == 7 and second.n == 7 and abs(second.total - 161.0) < 1e-6
    second.save()
    assert len(kept) == 7
