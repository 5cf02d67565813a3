"""Telemetry queries over the events table: key user_id, temperature least(value, 60), time ts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming import telemetry as T
from .registry import Tables, query, r6

LOW, HIGH, CEILING = 10.0, 40.0, 50.0


def readings(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "ts", F.least("value", F.lit(60.0)).alias("temp"))


EV = "ev AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, least(value, 60.0::DOUBLE) AS temp FROM events)"
MKT = f"""{EV}, g AS (SELECT *, exp(-83144.0::DOUBLE / (8.314::DOUBLE * (temp + 273.15::DOUBLE))) AS k, (lead(us) OVER w - us) / 1e6::DOUBLE AS nx, (us - lag(us) OVER w) / 1e6::DOUBLE AS pv FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
m AS (SELECT *, count(*) OVER r AS n, avg(temp) OVER r AS mean_c, (us - min(us) OVER r) / 1e6::DOUBLE AS span_s, sum(k * coalesce(nx, 0)) OVER r - k * coalesce(nx, 0) AS num, sum(coalesce(nx, 0)) OVER r - coalesce(nx, 0) AS den FROM g WINDOW r AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
mkt AS (SELECT *, CASE WHEN n = 1 THEN temp ELSE 83144.0::DOUBLE / 8.314::DOUBLE / -ln((num + pv * k) / (den + pv)) - 273.15::DOUBLE END AS mkt_c FROM m)"""


@query("q30_sliding_mkt", f"WITH {MKT} SELECT event_id, round(mkt_c, 5) AS mkt_c, round(mean_c, 6) AS mean_c, round(span_s, 3) AS span_s FROM mkt")
def q30(t):
    d = T.sliding_mkt(readings(t), "user_id", "ts", "temp")
    return d.select("event_id", F.round("mkt_c", 5).alias("mkt_c"), r6("mean_c").alias("mean_c"), F.round("span_s", 3).alias("span_s"))


BAND = f"temp BETWEEN {LOW} AND {HIGH}"
DWELL = f"""{EV}, ru AS (SELECT *, {BAND} AS ok, sum(({BAND})::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM ev),
dw AS (SELECT *, CASE WHEN NOT ok THEN (us - min(us) FILTER (NOT ok) OVER (PARTITION BY user_id, run)) / 1e6::DOUBLE END AS held_s FROM ru)"""


@query("q31_dwell_excursion_runs", f"WITH {DWELL} SELECT event_id, round(held_s, 3) AS held_s, coalesce(held_s >= 3600, false) AS excursion FROM dw")
def q31(t):
    d = T.excursions(readings(t), "user_id", "ts", F.col("temp").between(LOW, HIGH), 3600)
    return d.select("event_id", F.round("held_s", 3).alias("held_s"), "excursion")


@query("q32_latched_breach", f"WITH {MKT} SELECT event_id, bool_or(mkt_c > {CEILING} AND span_s >= 3600) OVER (PARTITION BY user_id ORDER BY us, event_id) AS latched FROM mkt")
def q32(t):
    return T.latch(T.sliding_mkt(readings(t), "user_id", "ts", "temp"), "user_id", "ts", F.lit(CEILING)).select("event_id", "latched")


def last_state(t: Tables) -> DataFrame:
    d = T.latch(T.sliding_mkt(readings(t), "user_id", "ts", "temp"), "user_id", "ts", F.lit(CEILING))
    d = T.excursions(d, "user_id", "ts", F.col("temp").between(LOW, HIGH), 3600)
    fault = T.sensor_fault(F.col("temp"), F.when(F.col("event_id") % 10 == 0, F.col("temp") + 5).otherwise(F.col("temp")))
    newest = d.withColumn("fault", fault).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "latched", "excursion", "fault")).alias("s"))
    known = t.customer.select(F.col("c_custkey").alias("user_id"))
    return known.join(newest, "user_id", "left").select("user_id", F.col("s.ts").alias("last_ts"), F.coalesce("s.latched", F.lit(False)).alias("latched"), F.coalesce("s.excursion", F.lit(False)).alias("excursion"), F.col("s.fault").alias("fault"))


STATUS = f"""WITH {MKT}, la AS (SELECT *, bool_or(mkt_c > {CEILING} AND span_s >= 3600) OVER (PARTITION BY user_id ORDER BY us, event_id) AS latched, rank() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rk FROM mkt),
ru AS (SELECT *, {BAND} AS ok, sum(({BAND})::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM la), dw AS (SELECT *, CASE WHEN NOT ok THEN (us - min(us) FILTER (NOT ok) OVER (PARTITION BY user_id, run)) / 1e6::DOUBLE END AS held_s FROM ru),
s AS (SELECT c_custkey AS user_id, us, coalesce(latched, false) AS latched, coalesce(held_s >= 3600, false) AS excursion, event_id % 10 = 0 AS fault FROM customer LEFT JOIN dw ON c_custkey = user_id AND rk = 1),
a AS (SELECT user_id, CASE WHEN us IS NULL THEN 'offline' WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - us > 20000 * 1000000::BIGINT THEN 'stale' WHEN latched THEN 'mkt_breach' WHEN fault THEN 'sensor_fault' WHEN excursion THEN 'excursion' ELSE 'ok' END AS code,
 CASE WHEN latched THEN 'mkt_breach' WHEN fault THEN 'sensor_fault' WHEN excursion THEN 'excursion' WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - us > 20000 * 1000000::BIGINT THEN 'stale' WHEN us IS NULL THEN 'offline' ELSE 'ok' END AS contract FROM s)"""


@query("q33_bin_status_asof", STATUS + " SELECT user_id, code, contract, list_position(['mkt_breach', 'sensor_fault', 'excursion', 'stale', 'offline', 'ok'], code)::BIGINT AS rank FROM a")
def q33(t):
    last, now = last_state(t), F.lit("2024-01-31 00:00:00").cast("timestamp")
    code = T.status_asof(last, now, 20000).select("user_id", F.col("status").alias("code"), "rank")
    return code.join(T.status_asof(last, now, 20000, "contract").select("user_id", F.col("status").alias("contract")), "user_id").select("user_id", "code", "contract", F.col("rank").cast("long").alias("rank"))


@query("q34_change_stream", """WITH x AS (SELECT event_id, user_id, event_type, value >= 50 AS hot, lag(event_type) OVER w AS pt, lag(value >= 50) OVER w AS ph, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, event_type, hot FROM x WHERE rn = 1 OR pt IS DISTINCT FROM event_type OR ph IS DISTINCT FROM hot""")
def q34(t):
    d = t.events.select("event_id", "user_id", "ts", "event_type", (F.col("value") >= 50).alias("hot"))
    return T.change_stream(d, "user_id", ["ts", "event_id"], ["event_type", "hot"]).select("event_id", "user_id", "event_type", "hot")


@query("q35_history_stride", """WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, user_id FROM x WHERE i % greatest(1, n // 20) = 0""")
def q35(t):
    return T.stride(t.events, "user_id", ["ts", "event_id"], 20).select("event_id", "user_id")


@query("q53_ratchet_baseline", """WITH x AS (SELECT event_id, user_id, value, row_number() OVER w AS i, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, exp(max(ln(value) - i * ln(0.9998::DOUBLE)) OVER (PARTITION BY user_id ORDER BY i) + i * ln(0.9998::DOUBLE)) AS clean FROM x) SELECT event_id, round(clean, 5) AS clean, round(greatest(0, least(100, (1 - value / clean) * 100)), 4) AS dirt FROM y""")
def q53(t):
    from ..functions.values import contamination_pct

    d = T.ratchet(t.events.select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value")
    return d.select("event_id", F.round("clean", 5).alias("clean"), F.round(contamination_pct(F.col("clean"), F.col("value")), 4).alias("dirt"))


@query("q74_sequence_gaps", """SELECT event_id, greatest(0, coalesce(event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1, 0)) AS lost FROM events""")
def q74(t):
    return T.sequence_gaps(t.events.select("event_id", "event_type", "ts"), "event_type", ["ts", "event_id"], "event_id").select("event_id", "lost")


@query("q75_synthetic_scenarios", """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT user_id, scenario, i, CASE scenario WHEN 'excursion' THEN CASE WHEN i < floor(n * 4 / 5) THEN 22.0::DOUBLE ELSE 22.0 + (i - floor(n * 4 / 5)) * (9.0::DOUBLE / greatest(1.0::DOUBLE, n / 5)) END WHEN 'breach' THEN CASE WHEN i * 120 BETWEEN 3600 AND 7200 THEN 45.0::DOUBLE ELSE 23.0 END ELSE 22.0::DOUBLE END AS t FROM r, (SELECT unnest(['nominal', 'excursion', 'breach', 'fault']) AS scenario))
SELECT user_id, scenario, round(avg(t), 8) AS mean_c, round(max(t), 8) AS max_c, round(avg(greatest(20.0, least(95.0, 55 + (t - 22) * 1.8::DOUBLE))), 8) AS rh FROM s GROUP BY 1, 2""")
def q75(t):
    """Each user's events as the ticks of a bin, two minutes apart, under every scenario."""
    w = Window.partitionBy("user_id")
    ticks = t.events.select("user_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("seq"), F.count(F.lit(1)).over(w).alias("n"))
    runs = [T.synthetic(ticks, s, F.col("n"), 120).withColumn("scenario", F.lit(s)) for s in ("nominal", "excursion", "breach", "fault")]
    return reduce(DataFrame.unionByName, runs).groupBy("user_id", "scenario").agg(F.round(F.avg("temp_c"), 8).alias("mean_c"), F.round(F.max("temp_c"), 8).alias("max_c"), F.round(F.avg("rh_pct"), 8).alias("rh"))


def watched(t: Tables) -> DataFrame:
    """The events as a stream of readings, with a second sensor and a humidity."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    src = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    temp = F.least("value", F.lit(60.0))
    return src.select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), temp.alias("temp_c"),
        F.when(F.col("event_id") % 10 == 0, temp + 5).otherwise(temp).alias("other_c"), (F.col("event_id") % 90).cast("double").alias("rh_pct"), F.lit(None).cast("string").alias("control"))


@query("q145_status_stream", f"""WITH {MKT}, la AS (SELECT *, coalesce(bool_or(mkt_c > {CEILING} AND span_s >= 3600) OVER (PARTITION BY user_id ORDER BY us, event_id), false) AS latched, {BAND} AND event_id % 90 <= 80 AS ok, event_id % 10 = 0 AS fault FROM mkt),
ru AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM la), si AS (SELECT *, CASE WHEN NOT ok THEN min(us) FILTER (NOT ok) OVER (PARTITION BY user_id, run) END AS since FROM ru),
st AS (SELECT *, coalesce(us - since >= 3600000000, false) AS excursion, lead(us // 1000) OVER (PARTITION BY user_id ORDER BY us, event_id) AS next_ms, max(us // 1000) OVER () AS mx, us // 1000 + 20000000 AS stale_at, us // 1000 + 90000000 AS off_at, (since + 3600000000 + 999) // 1000 AS exc_at FROM si),
s AS (SELECT *, CASE WHEN latched THEN 'mkt_breach' WHEN fault THEN 'sensor_fault' WHEN excursion THEN 'excursion' ELSE 'ok' END AS status FROM st),
d AS (SELECT user_id, exc_at AS due, 'excursion' AS status, since, latched, fault FROM s WHERE status = 'ok' AND exc_at < coalesce(next_ms, mx + 1) AND exc_at < stale_at
 UNION ALL SELECT user_id, stale_at, 'stale', since, latched, fault FROM s WHERE stale_at < coalesce(next_ms, mx + 1) UNION ALL SELECT user_id, off_at, 'offline', since, latched, fault FROM s WHERE off_at < coalesce(next_ms, mx + 1))
SELECT user_id::VARCHAR AS key, us AS at_us, event_id AS seq, 'reading' AS event, round(mkt_c, 4) AS mkt_c, round(mean_c, 7) AS mean_c, round(span_s, 3) AS span_s, round((us - since) / 1e6::DOUBLE, 3) AS held_s, excursion, latched, CASE WHEN fault THEN 'sensors disagree' END AS fault, status FROM s
UNION ALL SELECT user_id::VARCHAR, due * 1000, NULL, 'deadline', NULL, NULL, NULL, round((due * 1000 - since) / 1e6::DOUBLE, 3), coalesce(due * 1000 - since >= 3600000000, false), latched, CASE WHEN fault THEN 'sensors disagree' END, status FROM d""")
def q145(t):
    """Every reading with its bin's state, and every deadline that passed in silence, from one stateful stream."""
    from ..sources.folders import new_folder
    from ..streaming import status as S

    rules = S.Rules(LOW, HIGH, CEILING, rh_max=80.0, dwell_s=3600, stale_s=20000, offline_s=90000)
    out = S.replayed(t.spark, S.status_stream(watched(t), rules, changes_only=False), new_folder(t.spark, "status"))
    return out.select("key", F.unix_micros("at").alias("at_us"), "seq", "event", F.round("mkt_c", 4).alias("mkt_c"), F.round("mean_c", 7).alias("mean_c"), F.round("span_s", 3).alias("span_s"), F.round("held_s", 3).alias("held_s"), "excursion", "latched", "fault", "status")


@query("q51_telemetry_stateful_stream", f"""WITH {MKT}, la AS (SELECT *, coalesce(bool_or(mkt_c > {CEILING} AND span_s >= 3600) OVER (PARTITION BY user_id ORDER BY us, event_id), false) AS latched, {BAND} AS ok FROM mkt),
ru AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM la), dw AS (SELECT *, CASE WHEN NOT ok THEN us - min(us) FILTER (NOT ok) OVER (PARTITION BY user_id, run) END AS held, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rn FROM ru)
SELECT user_id::VARCHAR AS key, round(mkt_c, 5) AS mkt_c, latched, coalesce(held >= 3600000000, false) AS excursion FROM dw WHERE rn = 1""")
def q51(t):
    """The status stream over the events, run to its end: each key's state at its newest reading."""
    from ..sources.folders import new_folder
    from ..streaming import status as S

    r = watched(t).withColumns({"other_c": F.lit(None).cast("double"), "rh_pct": F.lit(None).cast("double")})
    out = S.replayed(t.spark, S.status_stream(r, S.Rules(LOW, HIGH, CEILING, dwell_s=3600), changes_only=False), new_folder(t.spark, "bins"))
    newest = out.filter("event = 'reading'").groupBy("key").agg(F.max(F.struct("at", "seq", "mkt_c", "latched", "excursion")).alias("s"))
    return newest.select("key", F.round("s.mkt_c", 5).alias("mkt_c"), "s.latched", "s.excursion")
