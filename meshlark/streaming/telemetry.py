"""Storage telemetry: windows over event time for a table, and the same state kept by a stream.

The table form expresses every rule as a window over (key, ts); the stream form is in status.py.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists


def storage_classes(spark) -> DataFrame:
    return spark.createDataFrame(lists.STORAGE_CLASSES, "storage_class string, temp_c_min double, temp_c_max double, excursion_min double, excursion_max double, mkt_c_max double, rh_pct_max double")


def synthetic(ticks: DataFrame, scenario: str, n: int | Column, step_s: int = 2) -> DataFrame:
    """ticks(seq, ...), numbered from 0 to n - 1, with temp_c, temp2_c and rh_pct of a scenario: nominal, excursion (a ramp over
    the last fifth), breach (a hot hour), fault. n may be a column of the ticks, where they are of several bins."""
    n = F.lit(n) if isinstance(n, int) else n
    i, late = F.col("seq"), F.floor(n * 4 / 5)
    temp = {
        "nominal": F.lit(22.0),
        "excursion": F.when(i < late, 22.0).otherwise(22.0 + (i - late) * (9.0 / F.greatest(F.lit(1.0), n / 5))),
        "breach": F.when((i * step_s).between(3600, 7200), 45.0).otherwise(23.0),
        "fault": F.lit(22.0),
    }[scenario]
    other = temp + 9.0 if scenario == "fault" else temp + 0.2
    rh = F.greatest(F.lit(20.0), F.least(F.lit(95.0), 55 + (temp - 22) * 1.8))
    return ticks.withColumns({"temp_c": temp, "temp2_c": other, "rh_pct": rh})


def in_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def sliding_mkt(df: DataFrame, key: str, ts: str, temp: str, window_s: int = lists.WINDOW_S, dh: float = lists.ACTIVATION, r: float = lists.GAS, tie: str = "event_id") -> DataFrame:
    """Adds mkt_c, mean_c, span_s over the trailing window: the time-weighted mean kinetic temperature.

    A sample weighs as long as it lasted; the newest weighs as long as the one before it did; alone, it is the value.
    """
    w = Window.partitionBy(key).orderBy("_us", tie)
    d = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_t", F.col(temp))
    gap = lambda c: F.greatest(c, F.lit(1e-9))
    d = d.withColumn("_k", F.exp(F.lit(-dh) / (r * (F.col("_t") + 273.15)))).withColumn("_next", gap((F.lead("_us").over(w) - F.col("_us")) / 1e6)).withColumn("_prev", gap((F.col("_us") - F.lag("_us").over(w)) / 1e6))
    span = Window.partitionBy(key).orderBy("_us").rangeBetween(-window_s * 1_000_000, 0)
    # the frame holds this row too: its own later gap is taken out again
    num = F.sum(F.col("_k") * F.coalesce("_next", F.lit(0.0))).over(span) - F.col("_k") * F.coalesce("_next", F.lit(0.0))
    den = F.sum(F.coalesce("_next", F.lit(0.0))).over(span) - F.coalesce("_next", F.lit(0.0))
    d = d.withColumn("_n", F.count(F.lit(1)).over(span)).withColumn("mean_c", F.avg("_t").over(span)).withColumn("span_s", (F.col("_us") - F.min("_us").over(span)) / 1e6)
    mean = (num + F.col("_prev") * F.col("_k")) / (den + F.col("_prev"))
    d = d.withColumn("mkt_c", F.when(F.col("_n") == 1, F.col("_t")).otherwise(dh / r / -F.log(mean) - 273.15))
    return d.drop("_t", "_k", "_next", "_prev", "_us", "_n")


def in_band(temp: Column, low: Column, high: Column, rh: Column | None = None, rh_max: Column | None = None) -> Column:
    ok = temp.between(low, high)
    return ok & (rh.isNull() | rh_max.isNull() | (rh <= rh_max)) if rh is not None else ok


def excursions(df: DataFrame, key: str, ts: str, ok: Column, dwell_s: float = lists.DWELL_S, tie: str = "event_id") -> DataFrame:
    """Adds since (first row of the current run out of band), held_s and excursion (held long enough)."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    d = df.withColumn("_ok", ok).withColumn("_run", F.sum(F.col("_ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(F.when(~F.col("_ok"), F.col(ts))).over(Window.partitionBy(key, "_run"))
    d = d.withColumn("since", F.when(~F.col("_ok"), since))
    d = d.withColumn("held_s", (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 1e6)
    return d.withColumn("excursion", F.coalesce(F.col("held_s") >= dwell_s, F.lit(False))).drop("_ok", "_run")


def latch(df: DataFrame, key: str, ts: str, ceiling: Column, min_window_s: int = lists.MIN_WINDOW_S, tie: str = "event_id") -> DataFrame:
    """Adds latched: from the first row on whose mkt_c is above the ceiling over a long enough span, for good."""
    hit = (F.col("mkt_c") > ceiling) & (F.col("span_s") >= min_window_s)
    return df.withColumn("latched", F.max(F.coalesce(hit, F.lit(False))).over(Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)))


def sensor_fault(primary: Column, secondary: Column, tolerance: float = lists.CROSS_CHECK_C) -> Column:
    return F.when(primary.isNull(), "primary sensor silent").when(F.abs(primary - secondary) > tolerance, "sensors disagree")


def status_asof(last: DataFrame, as_of: Column, stale_s: int = lists.STALE_S, precedence: str = "code") -> DataFrame:
    """last(last_ts, latched, fault, excursion) -> adds age_s, status, rank.

    `code` puts silence first (offline, stale, then the latch), `contract` puts the latch first and silence last.
    """
    age = in_seconds(as_of) - in_seconds(F.col("last_ts"))
    is_ = {"offline": F.col("last_ts").isNull(), "stale": age > stale_s, "mkt_breach": F.col("latched"), "sensor_fault": F.col("fault").isNotNull(), "excursion": F.col("excursion")}
    order = ["offline", "stale", "mkt_breach", "sensor_fault", "excursion"] if precedence == "code" else ["mkt_breach", "sensor_fault", "excursion", "stale", "offline"]
    status = F.coalesce(*[F.when(is_[s], s) for s in order], F.lit("ok"))
    return last.withColumn("age_s", age).withColumn("status", status).withColumn("rank", F.array_position(F.array(*[F.lit(s) for s in lists.STATUS_RANK]), F.col("status")))


def change_stream(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """Rows whose watched columns differ from the row before of the same key (the first one counts)."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*cols)
    return df.withColumn("_was", F.lag(now).over(w)).withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") == 1) | ~F.col("_was").eqNullSafe(now)).drop("_was", "_rn")


def stride(df: DataFrame, key: str, order: list[str], limit: int = 2000) -> DataFrame:
    """Every (count div limit)-th row of each key, the first included."""
    w = Window.partitionBy(key)
    d = df.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return d.filter(F.col("_rn") % F.greatest(F.lit(1), F.floor(F.col("_n") / limit)) == 0).drop("_rn", "_n")


def ratchet(df: DataFrame, key: str, order: list[str], value: str, decay: float = 0.9998) -> DataFrame:
    """Adds clean = max(now, decay * clean before), in closed form over logarithms (values from 0 on)."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("_i", F.row_number().over(w))
    log = F.when(F.col(value) == 0, F.lit(-math.inf)).otherwise(F.log(F.col(value)))
    best = F.max(log - F.col("_i") * math.log(decay)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("clean", F.exp(best + F.col("_i") * math.log(decay))).drop("_i")


def sequence_gaps(df: DataFrame, key: str, order: list[str], seq: str) -> DataFrame:
    """Adds lost: packets missing before this one."""
    return df.withColumn("lost", F.greatest(F.lit(0), F.coalesce(F.col(seq) - F.lag(seq).over(Window.partitionBy(key).orderBy(*order)) - 1, F.lit(0))))


def reason(temp: Column, low: Column, high: Column, rh: Column, rh_max: Column) -> Column:
    return F.concat_ws("; ", F.when(temp > high, F.concat(F.lit("above the band at "), F.format_number(temp, 1))), F.when(temp < low, F.concat(F.lit("below the band at "), F.format_number(temp, 1))), F.when(rh > rh_max, F.concat(F.lit("humidity "), F.format_number(rh, 0))))


def routed(readings: DataFrame, bins: DataFrame) -> DataFrame:
    """Keys by node_id or else device_id; unknown keys register themselves in class crt; a device's country beats the seed's."""
    key = F.coalesce("node_id", "device_id")
    seed = bins.select(F.col("node_id").alias("key"), F.col("label").alias("_label"), F.col("storage_class").alias("_class"), F.col("country").alias("_country"))
    r = readings.withColumn("key", key).join(seed, "key", "left")
    return r.select(*readings.columns, "key", F.coalesce("_label", F.concat(F.lit("Unregistered: "), "key")).alias("bin_label"), F.coalesce("_class", F.lit("crt")).alias("storage_class"), F.lower(F.coalesce("country", "_country")).alias("bin_country"))

