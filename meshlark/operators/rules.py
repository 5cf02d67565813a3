"""Signals, verdicts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from .order import against


def semantics(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in lists.SIGNAL_SEMANTICS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit("event"))


def latest_state(signals: DataFrame, keys=("node_id", "kind"), tie: str = "event_id") -> DataFrame:
    """The newest row of each key; of equal dates the one seen first (`tie`, rising)."""
    return signals.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("observed_at"), tie))).filter("_rn = 1").drop("_rn")


def is_adverse(kind: Column, severity: Column, classification: Column, status: Column) -> Column:
    return F.when(kind == "inspection_classification", classification == "OAI").when(kind == "shortage", F.lower(status).isin(lists.ADVERSE_SHORTAGE)).otherwise(severity.isin("high", "critical"))


def events_in_window(signals: DataFrame, as_of: Column, days: int = lists.EVENT_WINDOW_DAYS, floor=("low", "info")) -> DataFrame:
    """Events within the days up to as_of, both ends included, above the severity floor."""
    day = F.col("observed_at").cast("date")
    return signals.filter(day.between(F.date_sub(as_of, days), as_of) & ~F.coalesce(F.col("severity"), F.lit("unknown")).isin(list(floor)))


def red_verdict(signals: DataFrame, shares: DataFrame, as_of: Column, share_gt: float = lists.SHARE_GT, days: int = lists.EVENT_WINDOW_DAYS, tie: str = "event_id") -> DataFrame:
    """shares(node_id, share) -> node_id, red, concentrated, fired_by, reasons.

    Red needs a share strictly above the bound (an unknown share proves nothing) and something that fired: an event in
    the window, or a latest state that is adverse.
    """
    dated = signals.filter(F.col("observed_at").cast("date") <= as_of).withColumn("_sem", semantics(F.col("kind")))
    states = latest_state(dated.filter("_sem = 'state'"), tie=tie).filter(is_adverse(F.col("kind"), F.col("severity"), F.col("classification"), F.col("status")))
    fired = events_in_window(dated.filter("_sem = 'event'"), as_of, days).unionByName(states)
    what = F.array_sort(F.collect_list(F.concat_ws(" ", "kind", F.col("observed_at").cast("date").cast("string"))))
    by = fired.groupBy("node_id").agg(what.alias("fired_by"))
    out = shares.join(by, "node_id", "left")
    concentrated = F.col("share") > share_gt
    none = F.array().cast("array<string>")
    reasons = F.filter(
        F.array(
            F.when(F.col("share").isNull(), "concentration unproven").when(concentrated, "concentrated supply"),
            F.when(F.col("fired_by").isNotNull(), F.concat(F.size("fired_by").cast("string"), F.lit(" signals fired"))),
        ),
        lambda x: x.isNotNull(),
    )
    return out.select("node_id", (F.coalesce(concentrated, F.lit(False)) & F.col("fired_by").isNotNull()).alias("red"), concentrated.alias("concentrated"), F.coalesce("fired_by", none).alias("fired_by"), reasons.alias("reasons"))


def designated(countries: Column, yes=tuple(lists.DESIGNATED), no=tuple(lists.NOT_DESIGNATED)) -> Column:
    """True if all countries are on the list, False if all are on the other, else null."""
    some = F.size(countries) > 0
    return F.when(some & F.forall(countries, lambda c: c.isin(list(yes))), True).when(some & F.forall(countries, lambda c: c.isin(list(no))), False)


def score_alternates(holders: DataFrame, region=tuple(lists.REGION_TO_LEAVE), yes=tuple(lists.DESIGNATED), no=tuple(lists.NOT_DESIGNATED)) -> DataFrame:
    """holders(holder, matched, api, countries, hinted, risk_flags) -> with score, viable, taa, in_region, why.

    A registered maker gets 3 (1 if not flagged for it); sites all outside the region 2 (some 1; none if the country is
    only a hint); designated 1.5; every distinct risk flag takes 2. Viable means above 0.
    """
    inside = F.array_intersect("countries", F.array(*[F.lit(c) for c in region]))
    outside = F.array_except("countries", F.array(*[F.lit(c) for c in region]))
    clean, risky = F.size(outside) > 0, F.size(inside) > 0
    flags = F.array_sort(F.array_distinct("risk_flags"))
    taa = designated(F.col("countries"), yes, no)
    place = F.when(F.col("hinted"), 0.0).when(clean & risky, 1.0).when(clean, 2.0).otherwise(0.0)
    score = F.when(F.col("matched") & F.col("api"), 3.0).when(F.col("matched"), 1.0).otherwise(0.0) + place + F.when(taa, 1.5).otherwise(0.0) - 2.0 * F.size(flags)
    why = F.filter(
        F.array(
            F.when(F.col("matched") & F.col("api"), "registered maker").when(F.col("matched"), "registered, not flagged as maker").otherwise("no register match"),
            F.when(F.col("hinted"), "country from the graph only").when(clean & risky, "mixed footprint").when(clean, "outside the region").when(risky, "same region"),
            F.when(taa, "designated").when(~taa & ~clean, "not designated").when(~taa, "depends on the site"),
            F.when(F.size(flags) > 0, F.concat(F.lit("own risk: "), F.array_join(F.slice(flags, 1, 3), ", "))),
        ),
        lambda x: x.isNotNull(),
    )
    return holders.withColumns({"risk_flags": flags, "taa": taa, "in_region": risky, "score": F.bround(score, 1), "why": why}).withColumn("viable", F.col("score") > 0)


def eligibility_us(parties: DataFrame) -> DataFrame:
    """parties(id, type, country, country_verdict boolean) -> id, eligible, reason: null is a verdict."""
    kind, c = F.col("type"), F.col("country")
    reason = (
        F.when(~kind.isin("company", "country"), "not applicable")
        .when(c.isNull(), "no country resolved")
        .when(F.lower(c) == "us", "domestic: the rule does not bind")
        .when(F.col("country_verdict").isNull(), "country undetermined")
        .when(F.col("country_verdict"), "designated country")
        .otherwise("not a designated country")
    )
    eligible = F.when(kind.isin("company", "country") & c.isNotNull() & (F.lower(c) != "us"), F.col("country_verdict"))
    return parties.select("id", eligible.alias("eligible"), reason.alias("reason"))


def eligibility_buyers(nodes: DataFrame, buyers: DataFrame, parties: list[str]) -> DataFrame:
    """nodes(id, type, country) for each of buyers(buyer): eligible, rule, reason."""
    known = F.col("buyer").isin(parties)
    fits, c = F.col("type").isin("company", "country"), F.lower("country")
    all_of = against(nodes, buyers.select("buyer").filter("buyer IS NOT NULL").distinct())
    reason = F.when(~fits, "not applicable").when(~known, "no rule for the buyer").when(c.isNull(), "unresolved").when(c == F.col("buyer"), "domestic").when(c.isin(parties), "party").otherwise("non-party")
    eligible = F.when(reason.isin("domestic", "party"), True).when(reason == "non-party", False)
    return all_of.select("id", "buyer", eligible.alias("eligible"), F.when(fits & known, "gpa").otherwise("none").alias("rule"), reason.alias("reason"))


def inherit_verdict(companies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """companies(id, country), verdicts(node_id, verdict): a company without a verdict takes its country's."""
    own = verdicts.select(F.col("node_id").alias("id"), F.col("verdict").alias("_own"))
    land = verdicts.select(F.regexp_replace("node_id", "^country:", "").alias("country"), F.col("verdict").alias("_land"))
    return companies.join(own, "id", "left").join(land, "country", "left").select("id", "country", F.coalesce("_own", "_land").alias("verdict"), F.when(F.col("_own").isNotNull(), "own").when(F.col("_land").isNotNull(), "country").alias("basis"))


def list_membership(names: DataFrame, listed: DataFrame) -> DataFrame:
    """names(id, key) against listed(key, entry, role: parent, alias or subsidiary): the strongest role wins."""
    order = F.when(F.col("role") == "parent", 1).when(F.col("role") == "alias", 2).otherwise(3)
    best = listed.groupBy("key").agg(F.min(F.struct(order.alias("o"), "role", "entry")).alias("b")).select("key", "b.role", "b.entry")
    return names.join(best, "key", "left").select("id", "key", F.col("entry").isNotNull().alias("listed"), "role", "entry")


def impact_band(no_substitute: Column, filings: Column, ndcs: Column, thin: int = 3, wide: int = 100) -> Column:
    """struct(band, drivers)."""
    drivers = F.filter(F.array(F.when(no_substitute, "no substitute"), F.when(filings <= thin, F.concat(filings.cast("string"), F.lit(" filings"))), F.when(ndcs >= wide, F.concat(ndcs.cast("string"), F.lit(" products")))), lambda x: x.isNotNull())
    return F.struct(F.when(F.size(drivers) > 0, "high").otherwise("medium").alias("band"), drivers.alias("drivers"))


def document_severity(kind: Column, query: Column, strict: str = "dod-1260h") -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(query == strict, "high").when(k.isin("presidential document", "rule"), "high").when(k == "proposed rule", "medium").otherwise("low")


def basis_of(attribution: Column) -> Column:
    return F.when(attribution == "direct", "measured").when(attribution == "inherited", "supplier").when(attribution == "molecule", "substance").otherwise("base-rate")
