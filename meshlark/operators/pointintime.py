"""What was known at a cutoff: market structure, event features, labels, the active universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import months_between_plain

CAP_MONTHS = 120.0


def market_at(listings: DataFrame, cutoff: Column, key: str = "generic", labeler: str = "labeler", start: str = "start") -> DataFrame:
    """(key, labeler, products) of what started strictly before the cutoff; empty starts and keys under 4 letters go."""
    at = listings.filter(F.col(start).isNotNull() & (F.col(start) < cutoff) & (F.length(key) >= 4))
    return at.groupBy(key, labeler).agg(F.count(F.lit(1)).alias("products"))


def features(events: DataFrame, universe: DataFrame, cutoff: Column) -> DataFrame:
    """events(fei, day, kind OAI/VAI/NAI or mfg/paperwork) -> one row per fei of the universe with its features at the
    cutoff (included). One aggregation with conditions; plants without events get zeros and the cap."""
    y1, y2, y3 = (F.add_months(cutoff, -12 * i) for i in (1, 2, 3))
    d, k = F.col("day"), F.col("kind")
    insp, refu = k.isin("OAI", "VAI", "NAI"), k.isin("mfg", "paperwork")
    n = lambda c: F.count_if(c)
    past = events.filter(d <= cutoff)
    g = past.groupBy("fei").agg(
        n(k == "OAI").alias("oai"), n((k == "OAI") & (d >= y3)).alias("oai3"), F.max(F.when(k == "OAI", d)).alias("last_oai"),
        n((k == "VAI") & (d >= y3)).alias("vai3"), n(insp & (d >= y3)).alias("insp3"), F.max(F.when(insp, d)).alias("last_insp"),
        n((k == "mfg") & (d >= y3)).alias("mfg3"), n((k == "paperwork") & (d >= y3)).alias("paper3"), (n(refu & (d >= y1)) - n(refu & (d >= y2) & (d < y1))).alias("trend"),
    )
    log = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    months = lambda c: F.coalesce(months_between_plain(cutoff, F.col(c), CAP_MONTHS), F.lit(CAP_MONTHS))
    return universe.select("fei").distinct().join(g, "fei", "left").select(
        "fei", log("oai").alias("oai_all"), log("oai3").alias("oai_3y"), months("last_oai").alias("months_since_oai"), log("vai3").alias("vai_3y"), log("insp3").alias("insp_3y"),
        months("last_insp").alias("months_since_insp"), log("mfg3").alias("refusal_mfg_3y"), log("paper3").alias("refusal_paper_3y"), F.coalesce("trend", F.lit(0)).cast("double").alias("refusal_trend"),
    )


def horizon_label(events: DataFrame, universe: DataFrame, cutoff: Column, days: int = 365) -> DataFrame:
    """label: an OAI or a manufacturing refusal after the cutoff, up to cutoff + days included."""
    bad = events.filter((F.col("day") > cutoff) & (F.col("day") <= F.date_add(cutoff, days)) & F.col("kind").isin("OAI", "mfg")).select("fei").distinct().withColumn("label", F.lit(1))
    return universe.select("fei").distinct().join(bad, "fei", "left").select("fei", F.coalesce("label", F.lit(0)).alias("label"))


def active_universe(registered: DataFrame, inspections: DataFrame, cutoff: Column, months: int = 60) -> DataFrame:
    """Registered or inspected plants that were inspected within the months up to the cutoff."""
    seen = inspections.filter(F.col("day") <= cutoff)
    recent = seen.filter(F.col("day") >= F.add_months(cutoff, -months)).select("fei").distinct()
    both = registered.select("fei").withColumn("registered", F.lit(True)).unionByName(seen.select("fei").withColumn("registered", F.lit(False)))
    return both.groupBy("fei").agg(F.bool_or("registered").alias("registered")).join(recent, "fei", "left_semi")


def price_trend(prices: DataFrame, key: str, day: str, price: str) -> DataFrame:
    """First and last price of each key and the relative change; equal days: the smallest price first, the largest last."""
    p = prices.filter(F.col(price) > 0).groupBy(key).agg(F.min(F.struct(day, price))[price].alias("first"), F.max(F.struct(day, price))[price].alias("last"), F.count(F.lit(1)).alias("n"))
    return p.filter("n >= 2").select(key, "first", "last", ((F.col("last") - F.col("first")) / F.col("first")).alias("change"))


def country_share(df: DataFrame, group: str, country: str, listed) -> DataFrame:
    """Share of rows from the listed countries, and the largest share of one country."""
    n = df.groupBy(group, country).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(group).agg((F.sum(F.when(F.col(country).isin(list(listed)), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("listed_share"), (F.max("_n") / F.sum("_n")).alias("plurality"), F.count(F.lit(1)).alias("countries"))
