"""Signals, features, labels and verdicts over the events table.

An event is a signal on its user: error is an inspection state (OAI from k 50 on, else VAI), click an event of high
severity from value 50 on, view an NAI inspection, purchase a manufacturing refusal, signup a paperwork one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists, values
from ..operators import merge, pointintime, rules
from .registry import Tables, query, r6

AS_OF, DAY = "2024-01-25", "2024-01-15"
KIND = {"error": "inspection_classification", "click": "news_event", "view": "regulatory_action", "purchase": "import_refusal", "signup": "import_refusal_paperwork"}


def signals(t: Tables) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv])[F.col("event_type")]
    severity = F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 50, "high").when(F.col("value") >= 10, "medium").otherwise("low")
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", F.col("user_id").alias("node_id"), kind.alias("kind"), severity.alias("severity"), F.col("ts").alias("observed_at"), F.when(k >= 50, "OAI").otherwise("VAI").alias("classification"), F.lit(None).cast("string").alias("status"))


SIG = """sig AS (SELECT event_id, user_id AS node_id, CASE event_type WHEN 'error' THEN 'inspection_classification' WHEN 'click' THEN 'news_event' WHEN 'view' THEN 'regulatory_action' WHEN 'purchase' THEN 'import_refusal' ELSE 'import_refusal_paperwork' END AS kind,
CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS severity, ts AS observed_at, CASE WHEN (props->>'$.k')::INT >= 50 THEN 'OAI' ELSE 'VAI' END AS classification FROM events)"""


def history(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "OAI").when(F.col("event_type") == "click", "VAI").when(F.col("event_type") == "view", "NAI").when(F.col("event_type") == "purchase", "mfg").otherwise("paperwork")
    return t.events.select(F.col("user_id").alias("fei"), F.col("ts").cast("date").alias("day"), kind.alias("kind"))


HIST = "h AS (SELECT user_id AS fei, ts::DATE AS day, CASE event_type WHEN 'error' THEN 'OAI' WHEN 'click' THEN 'VAI' WHEN 'view' THEN 'NAI' WHEN 'purchase' THEN 'mfg' ELSE 'paperwork' END AS kind FROM events)"


def universe(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("fei"))


MONTHS = lambda c: f"least(120.0::DOUBLE, (year(DATE '{DAY}') - year({c})) * 12 + (month(DATE '{DAY}') - month({c})) + (day(DATE '{DAY}') - day({c})) / 30.0::DOUBLE)"


@query("q11_pit_features", f"""WITH {HIST}, u AS (SELECT c_custkey AS fei FROM customer),
g AS (SELECT fei, count(*) FILTER (kind = 'OAI') AS oai, max(day) FILTER (kind = 'OAI') AS lo, count(*) FILTER (kind = 'VAI') AS vai, count(*) FILTER (kind IN ('OAI','VAI','NAI')) AS insp, max(day) FILTER (kind IN ('OAI','VAI','NAI')) AS li,
 count(*) FILTER (kind = 'mfg') AS mfg, count(*) FILTER (kind = 'paperwork') AS pap FROM h WHERE day <= DATE '{DAY}' GROUP BY 1)
SELECT fei, round(ln(1 + coalesce(oai, 0)), 6) AS oai_all, round(ln(1 + coalesce(oai, 0)), 6) AS oai_3y, round(coalesce({MONTHS('lo')}, 120), 6) AS months_since_oai, round(ln(1 + coalesce(vai, 0)), 6) AS vai_3y, round(ln(1 + coalesce(insp, 0)), 6) AS insp_3y,
 round(coalesce({MONTHS('li')}, 120), 6) AS months_since_insp, round(ln(1 + coalesce(mfg, 0)), 6) AS refusal_mfg_3y, round(ln(1 + coalesce(pap, 0)), 6) AS refusal_paper_3y, coalesce(mfg + pap, 0)::DOUBLE AS refusal_trend FROM u LEFT JOIN g USING (fei)""")
def q11(t):
    f = pointintime.features(history(t), universe(t), F.lit(DAY).cast("date"))
    return f.select("fei", *[r6(c).alias(c) for c in f.columns[1:]])


@query("q12_horizon_label", f"""WITH {HIST}, b AS (SELECT DISTINCT fei FROM h WHERE day > DATE '{DAY}' AND day <= DATE '{DAY}' + 3 AND kind IN ('OAI', 'mfg'))
SELECT c_custkey AS fei, (b.fei IS NOT NULL)::INT AS label FROM customer LEFT JOIN b ON c_custkey = b.fei""")
def q12(t):
    return pointintime.horizon_label(history(t), universe(t), F.lit(DAY).cast("date"), 3)


@query("q13_active_universe", f"""WITH {HIST}, i AS (SELECT * FROM h WHERE kind IN ('OAI', 'VAI', 'NAI') AND day <= DATE '{AS_OF}'), r AS (SELECT DISTINCT fei FROM i WHERE day >= DATE '{AS_OF}' - INTERVAL 1 MONTH),
a AS (SELECT c_custkey AS fei, true AS registered FROM customer WHERE c_acctbal > 0 UNION ALL SELECT fei, false FROM i)
SELECT fei, bool_or(registered) AS registered FROM a WHERE fei IN (SELECT fei FROM r) GROUP BY 1""")
def q13(t):
    reg = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("fei"))
    return pointintime.active_universe(reg, history(t).filter("kind IN ('OAI', 'VAI', 'NAI')"), F.lit(AS_OF).cast("date"), 1)


@query("q14_latest_adverse_state", f"""WITH {SIG}, l AS (SELECT *, row_number() OVER (PARTITION BY node_id, kind ORDER BY observed_at DESC, event_id) AS rn FROM sig)
SELECT node_id, kind, event_id, CASE WHEN kind = 'inspection_classification' THEN classification = 'OAI' ELSE severity IN ('high', 'critical') END AS adverse FROM l WHERE rn = 1""")
def q14(t):
    s = rules.latest_state(signals(t))
    return s.select("node_id", "kind", "event_id", rules.is_adverse(F.col("kind"), F.col("severity"), F.col("classification"), F.col("status")).alias("adverse"))


@query("q15_events_in_window", f"""WITH {SIG} SELECT node_id, count(*) AS n, max(observed_at::DATE)::VARCHAR AS newest FROM sig WHERE observed_at::DATE BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}' AND severity NOT IN ('low', 'info') GROUP BY 1""")
def q15(t):
    e = rules.events_in_window(signals(t), F.lit(AS_OF).cast("date"), 7)
    return e.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("observed_at").cast("date")).cast("string").alias("newest"))


@query("q16_red_verdict", f"""WITH {SIG}, p AS (SELECT * FROM sig WHERE observed_at::DATE <= DATE '{AS_OF}'),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, kind ORDER BY observed_at DESC, event_id) AS rn FROM p WHERE kind = 'inspection_classification') WHERE rn = 1 AND classification = 'OAI'),
ev AS (SELECT * FROM p WHERE kind <> 'inspection_classification' AND observed_at::DATE >= DATE '{AS_OF}' - 7 AND severity NOT IN ('low', 'info')),
f AS (SELECT node_id, string_agg(kind || ' ' || observed_at::DATE::VARCHAR, '; ' ORDER BY kind || ' ' || observed_at::DATE::VARCHAR) AS fired_by, count(*) AS n FROM (SELECT node_id, kind, observed_at FROM st UNION ALL SELECT node_id, kind, observed_at FROM ev) GROUP BY 1),
s AS (SELECT c_custkey AS node_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 5) * 0.25::DOUBLE END AS share FROM customer)
SELECT node_id, coalesce(share > 0.75, false) AND n IS NOT NULL AS red, share > 0.75 AS concentrated, coalesce(fired_by, '') AS fired_by,
 concat_ws('; ', CASE WHEN share IS NULL THEN 'concentration unproven' WHEN share > 0.75 THEN 'concentrated supply' END, n || ' signals fired') AS reasons FROM s LEFT JOIN f USING (node_id)""")
def q16(t):
    k = F.col("c_custkey")
    shares = t.customer.select(k.alias("node_id"), F.when(k % 5 != 0, (k % 5) * 0.25).alias("share"))
    v = rules.red_verdict(signals(t), shares, F.lit(AS_OF).cast("date"), days=7)
    return v.withColumn("fired_by", F.array_join("fired_by", "; ")).withColumn("reasons", F.array_join("reasons", "; "))


CODES = "CASE WHEN (props->>'$.k')::INT % 3 = 0 THEN '27, 118' WHEN (props->>'$.k')::INT % 3 = 1 THEN ' 472 ,9' ELSE '5' END"


@query("q18_charge_class", f"""WITH c AS (SELECT event_id, {CODES} AS codes FROM events), x AS (SELECT event_id, list_transform(string_split(codes, ','), lambda s: trim(s)) AS have FROM c)
SELECT event_id, CASE WHEN list_has_any(have, ['27', '3280']) THEN 'mfg' WHEN list_has_any(have, ['118', '472']) THEN 'paperwork' END AS kind,
 coalesce(list_min(list_intersect(have, ['27', '3280'])), list_min(list_intersect(have, ['118', '472']))) AS code FROM x""")
def q18(t):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    codes = F.when(k == 0, "27, 118").when(k == 1, " 472 ,9").otherwise("5")
    return t.events.select("event_id", values.charge_class(codes, lists.MFG_CHARGES, lists.PAPER_CHARGES).alias("c")).select("event_id", "c.kind", "c.code")


@query("q39_alternate_supplier_score", """WITH risk AS (SELECT user_id AS id, list(DISTINCT 'OAI ' || ts::DATE::VARCHAR) AS flags FROM events WHERE event_type = 'error' AND value >= 150 GROUP BY 1),
h AS (SELECT s_suppkey AS holder, s_nationkey % 4 <> 3 AS matched, s_acctbal > 0 AS api, CASE WHEN s_nationkey % 4 = 0 THEN ['CHN'] WHEN s_nationkey % 4 = 1 THEN ['DEU', 'IND'] WHEN s_nationkey % 4 = 2 THEN ['DEU', 'FRA'] ELSE [] END AS countries, coalesce(flags, []) AS flags FROM supplier LEFT JOIN risk ON s_suppkey = id),
v AS (SELECT *, CASE WHEN countries = ['DEU', 'FRA'] THEN true WHEN countries = ['CHN'] THEN false END AS taa, CASE WHEN countries = ['DEU', 'FRA'] THEN 2.0 WHEN countries = ['DEU', 'IND'] THEN 1.0 ELSE 0.0 END AS place FROM h)
SELECT holder, ((CASE WHEN matched AND api THEN 3 WHEN matched THEN 1 ELSE 0 END) + place + (CASE WHEN taa THEN 1.5 ELSE 0 END) - 2 * len(flags))::DOUBLE AS score, taa, list_has_any(countries, ['CHN', 'IND']) AS in_region, len(flags)::INT AS n_flags,
 (CASE WHEN matched AND api THEN 3 WHEN matched THEN 1 ELSE 0 END) + place + (CASE WHEN taa THEN 1.5 ELSE 0 END) - 2 * len(flags) > 0 AS viable FROM v""")
def q39(t):
    flags = t.events.filter("event_type = 'error' AND value >= 150").groupBy(F.col("user_id").alias("s_suppkey")).agg(F.collect_set(F.concat(F.lit("OAI "), F.col("ts").cast("date").cast("string"))).alias("risk_flags"))
    n = F.col("s_nationkey") % 4
    arr = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    h = t.supplier.join(flags, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("holder"), (n != 3).alias("matched"), (F.col("s_acctbal") > 0).alias("api"), F.when(n == 0, arr("CHN")).when(n == 1, arr("DEU", "IND")).when(n == 2, arr("DEU", "FRA")).otherwise(arr()).alias("countries"),
        F.lit(False).alias("hinted"), F.coalesce("risk_flags", arr()).alias("risk_flags"),
    )
    return rules.score_alternates(h).select("holder", "score", "taa", "in_region", F.size("risk_flags").alias("n_flags"), "viable")


@query("q41_eligibility_us", """WITH p AS (SELECT 'company:' || s_suppkey AS id, CASE WHEN s_suppkey % 7 = 6 THEN 'product' ELSE 'company' END AS type, CASE WHEN s_nationkey % 5 = 0 THEN NULL WHEN s_nationkey % 5 = 1 THEN 'us' ELSE 'n' || (s_nationkey % 5) END AS country, CASE s_nationkey % 5 WHEN 2 THEN true WHEN 3 THEN false END AS v FROM supplier)
SELECT id, CASE WHEN type = 'company' AND country IS NOT NULL AND country <> 'us' THEN v END AS eligible, CASE WHEN type <> 'company' THEN 'not applicable' WHEN country IS NULL THEN 'no country resolved' WHEN country = 'us' THEN 'domestic: the rule does not bind' WHEN v IS NULL THEN 'country undetermined' WHEN v THEN 'designated country' ELSE 'not a designated country' END AS reason FROM p""")
def q41(t):
    n = F.col("s_nationkey") % 5
    p = t.supplier.select(F.concat(F.lit("company:"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 7 == 6, "product").otherwise("company").alias("type"), F.when(n == 1, "us").when(n != 0, F.concat(F.lit("n"), n.cast("string"))).alias("country"), F.when(n == 2, True).when(n == 3, False).alias("country_verdict"))
    return rules.eligibility_us(p)


@query("q42_eligibility_buyer_matrix", """WITH n AS (SELECT 'company:' || s_suppkey AS id, CASE WHEN s_nationkey % 6 = 0 THEN NULL ELSE 'c' || (s_nationkey % 6) END AS country FROM supplier), b AS (SELECT unnest(['c1', 'c2', 'c9']) AS buyer),
r AS (SELECT id, buyer, CASE WHEN buyer NOT IN ('c1', 'c2', 'c3') THEN 'no rule for the buyer' WHEN country IS NULL THEN 'unresolved' WHEN country = buyer THEN 'domestic' WHEN country IN ('c1', 'c2', 'c3') THEN 'party' ELSE 'non-party' END AS reason FROM n, b)
SELECT id, buyer, CASE WHEN reason IN ('domestic', 'party') THEN true WHEN reason = 'non-party' THEN false END AS eligible, CASE WHEN buyer IN ('c1', 'c2', 'c3') THEN 'gpa' ELSE 'none' END AS rule, reason FROM r""")
def q42(t):
    n = F.col("s_nationkey") % 6
    nodes = t.supplier.select(F.concat(F.lit("company:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("company").alias("type"), F.when(n != 0, F.concat(F.lit("c"), n.cast("string"))).alias("country"))
    return rules.eligibility_buyers(nodes, t.spark.createDataFrame([("c1",), ("c2",), ("c9",)], "buyer string"), ["c1", "c2", "c3"])


@query("q59_verdict_inheritance", """SELECT 'company:' || s_suppkey AS id, 'n' || s_nationkey AS country, coalesce(CASE WHEN s_acctbal > 5000 THEN s_suppkey % 2 = 0 END, CASE WHEN n_regionkey <> 3 THEN s_nationkey % 2 = 0 END) AS verdict,
 CASE WHEN s_acctbal > 5000 THEN 'own' WHEN n_regionkey <> 3 THEN 'country' END AS basis FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q59(t):
    cid = F.concat(F.lit("company:"), F.col("s_suppkey").cast("string"))
    own = t.supplier.filter("s_acctbal > 5000").select(cid.alias("node_id"), (F.col("s_suppkey") % 2 == 0).alias("verdict"))
    land = t.nation.filter("n_regionkey <> 3").select(F.concat(F.lit("country:n"), F.col("n_nationkey").cast("string")).alias("node_id"), (F.col("n_nationkey") % 2 == 0).alias("verdict"))
    return rules.inherit_verdict(t.supplier.select(cid.alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("country")), own.unionByName(land))


@query("q60_list_membership", """WITH l AS (SELECT 'brand' || i AS key, 'entry' || (i % 3) AS entry, role FROM range(0, 12) AS g(i), (SELECT unnest(['alias', 'parent']) AS role) WHERE role = 'alias' OR i % 2 = 0)
SELECT p_partkey AS id, lower(replace(p_brand, '#', '')) AS key, m.key IS NOT NULL AS listed, m.role, m.entry FROM part LEFT JOIN (SELECT key, CASE WHEN bool_or(role = 'parent') THEN 'parent' ELSE 'alias' END AS role, any_value(entry) AS entry FROM l GROUP BY 1) m ON lower(replace(p_brand, '#', '')) = m.key""")
def q60(t):
    i = t.spark.range(12).select(F.concat(F.lit("brand"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("entry"), (F.col("id") % 3).cast("string")).alias("entry"), "id")
    listed = i.withColumn("role", F.lit("alias")).unionByName(i.filter("id % 2 = 0").withColumn("role", F.lit("parent"))).drop("id")
    return rules.list_membership(t.part.select(F.col("p_partkey").alias("id"), F.lower(F.regexp_replace("p_brand", "#", "")).alias("key")), listed)


@query("q61_impact_band", """WITH g AS (SELECT p_brand AS drug, count(DISTINCT l_suppkey) AS filings, count(*) AS ndcs, p_brand LIKE '%1' AS alone FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT drug, CASE WHEN alone OR filings <= 60 OR ndcs >= 24000 THEN 'high' ELSE 'medium' END AS band, concat_ws('; ', CASE WHEN alone THEN 'no substitute' END, CASE WHEN filings <= 60 THEN filings || ' filings' END, CASE WHEN ndcs >= 24000 THEN ndcs || ' products' END) AS drivers FROM g""")
def q61(t):
    g = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").join(t.part.select("p_partkey", F.col("p_brand").alias("drug")), "p_partkey").groupBy("drug").agg(F.count_distinct("l_suppkey").alias("filings"), F.count(F.lit(1)).alias("ndcs"))
    return g.select("drug", rules.impact_band(F.col("drug").endswith("1"), F.col("filings"), F.col("ndcs"), 60, 24000).alias("b")).select("drug", "b.band", F.array_join("b.drivers", "; ").alias("drivers"))


@query("q62_top_signals_per_node", f"""WITH {SIG}, r AS (SELECT node_id, event_id, row_number() OVER (PARTITION BY node_id ORDER BY observed_at DESC, kind) AS rank FROM sig) SELECT node_id, event_id, rank::INT AS rank FROM r WHERE rank <= 8""")
def q62(t):
    from ..operators.graph import top_signals

    return top_signals(signals(t), 8).select("node_id", "event_id", "rank")


@query("q43_upsert_merge", """WITH o AS (SELECT c_custkey AS id, c_name AS label, c_mktsegment AS seg FROM customer WHERE c_acctbal < 6000), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name END AS label, lower(c_mktsegment) AS seg FROM customer WHERE c_acctbal > 3000)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.label, o.label) AS label, coalesce(n.seg, o.seg) AS a, o.seg AS b, coalesce(CASE WHEN o.id IS NULL THEN false END, true) AS old FROM o FULL JOIN n ON o.id = n.id""")
def q43(t):
    c = t.customer
    none = F.lit(None).cast("string")
    o = c.filter("c_acctbal < 6000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.create_map(F.lit("a"), F.col("c_mktsegment"), F.lit("b"), F.col("c_mktsegment")).alias("attrs"), F.lit(True).alias("old"))
    n = c.filter("c_acctbal > 3000").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new "), "c_name")).otherwise(none).alias("label"), F.create_map(F.lit("a"), F.lower("c_mktsegment")).alias("attrs"), F.lit(None).cast("boolean").alias("old"))
    u = merge.upsert(o, n, ["id"], insert_defaults={"old": False})
    return u.select("id", "label", F.try_element_at("attrs", F.lit("a")).alias("a"), F.try_element_at("attrs", F.lit("b")).alias("b"), "old")


@query("q44_union_priority", """WITH u AS (SELECT 1 AS p, s_suppkey % 50 AS id, s_name AS v FROM supplier UNION ALL SELECT 2, s_nationkey, 'n' || max(s_suppkey) FROM supplier GROUP BY s_nationkey UNION ALL SELECT 3, p_size, p_name FROM part),
d AS (SELECT p, id, min(v) AS v FROM u GROUP BY 1, 2) SELECT id, arg_max(v, p) AS last, arg_min(v, p) AS first, count(*) AS producers FROM d GROUP BY 1""")
def q44(t):
    a = t.supplier.groupBy((F.col("s_suppkey") % 50).alias("id")).agg(F.min("s_name").alias("v"))
    b = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.concat(F.lit("n"), F.max("s_suppkey").cast("string")).alias("v"))
    c = t.part.groupBy(F.col("p_size").cast("long").alias("id")).agg(F.min("p_name").alias("v"))
    dfs = [a, b, c]
    hits = merge.collisions(dfs, ["id"])
    return merge.union_priority(dfs, ["id"]).withColumnRenamed("v", "last").join(merge.union_priority(dfs, ["id"], "first").withColumnRenamed("v", "first"), "id").join(hits, "id", "left").select("id", "last", "first", F.coalesce("producers", F.lit(1)).alias("producers"))


@query("q63_builder_merge", """WITH r AS (SELECT l_suppkey AS id, l_linenumber::BIGINT * 1000000000 + l_orderkey * 10 + l_partkey % 10 AS ord, l_returnflag AS flag, CASE WHEN l_quantity > 25 THEN l_linestatus END AS st, l_partkey FROM lineitem)
SELECT id, arg_min(flag, (ord, l_partkey)) AS flag, arg_max(st, (ord, l_partkey)) FILTER (st IS NOT NULL) AS st, count(*) AS _rows FROM r GROUP BY 1""")
def q63(t):
    r = t.lineitem.select(F.col("l_suppkey").alias("id"), F.struct((F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_orderkey") * 10 + F.col("l_partkey") % 10).alias("o"), "l_partkey").alias("ord"), F.col("l_returnflag").alias("flag"), F.create_map(F.lit("st"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus"))).alias("attrs"))
    return merge.builder_merge(r, ["id"], "ord", ["flag"]).select("id", "flag", F.try_element_at("attrs", F.lit("st")).alias("st"), "_rows")


@query("q45_contract_violations", """WITH n AS (SELECT 'company:fei:' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'facility' ELSE 'company' END AS type FROM supplier UNION ALL SELECT 'Drug:' || p_brand, 'drug' FROM part GROUP BY p_brand),
e AS (SELECT 'company:fei:' || s_suppkey AS src, 'country:x' || s_nationkey AS dst, CASE WHEN s_suppkey % 9 = 0 THEN 'owns' ELSE 'incorporated_in' END AS rel, s_suppkey % 4 AS layer, CASE WHEN s_suppkey % 8 = 3 THEN 'doc' END AS citation FROM supplier)
SELECT severity, message, count(*) AS n FROM (
 SELECT 'error' AS severity, 'id fits no pattern' AS message FROM n WHERE id LIKE 'Drug%' UNION ALL SELECT 'error', 'type does not fit the id' FROM n WHERE id LIKE 'company%' AND type <> 'company'
 UNION ALL SELECT 'error', 'layer is not 1, 2 or 3' FROM e WHERE layer = 0 UNION ALL SELECT 'error', 'layer 3 without a citation' FROM e WHERE layer = 3 AND citation IS NULL UNION ALL SELECT 'warning', 'unknown relation' FROM e WHERE rel = 'owns'
 UNION ALL SELECT 'warning', 'dst has no node' FROM e) GROUP BY ALL""")
def q45(t):
    cid = F.concat(F.lit("company:fei:"), F.col("s_suppkey").cast("string"))
    nodes = t.supplier.select(cid.alias("id"), F.when(F.col("s_suppkey") % 10 == 0, "facility").otherwise("company").alias("type")).unionByName(t.part.select(F.concat(F.lit("Drug:"), "p_brand").alias("id"), F.lit("drug").alias("type")).distinct())
    edges = t.supplier.select(cid.alias("src"), F.concat(F.lit("country:x"), F.col("s_nationkey").cast("string")).alias("dst"), F.when(F.col("s_suppkey") % 9 == 0, "owns").otherwise("incorporated_in").alias("rel"), (F.col("s_suppkey") % 4).cast("int").alias("layer"), F.when(F.col("s_suppkey") % 8 == 3, "doc").alias("citation"))
    return merge.validate(nodes, edges).groupBy("severity", "message").agg(F.count(F.lit(1)).alias("n"))
