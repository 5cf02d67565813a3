"""Registers, profiles and crosswalks over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registers as R
from ..streaming import telemetry as T
from .registry import query


@query("q76_facility_profile", """SELECT o_custkey AS fei, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS names, arg_max(o_orderpriority, (length(o_orderpriority), o_orderpriority)) AS name,
 arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'P') AS country, count(*) AS rows FROM orders GROUP BY 1""")
def q76(t):
    o = t.orders.withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    p = R.facility_profile(o, "o_custkey", "o_orderpriority", "status", "status", "o_orderstatus", "o_orderkey")
    return p.select(F.col("o_custkey").alias("fei"), F.array_join("names", "|").alias("names"), "name", "country", "rows")


@query("q77_firm_index", """WITH r AS (SELECT s_nationkey AS firm, s_suppkey AS fei, 'c' || (s_suppkey % 3) AS country, CASE WHEN s_acctbal > 5000 THEN 'PACK; API MANUFACTURE' WHEN s_acctbal > 0 THEN 'PACK;LABEL ' END AS ops FROM supplier),
o AS (SELECT firm, unnest(string_split(coalesce(ops, ''), ';')) AS op FROM r), p AS (SELECT firm, string_agg(DISTINCT trim(op), '|' ORDER BY trim(op)) AS operations FROM o WHERE trim(op) <> '' GROUP BY 1)
SELECT firm, count(DISTINCT fei) AS feis, string_agg(DISTINCT country, '|' ORDER BY country) AS countries, coalesce(any_value(operations), '') AS operations, bool_or(coalesce(contains(ops, 'API MANUFACTURE'), false)) AS api FROM r LEFT JOIN p USING (firm) GROUP BY 1""")
def q77(t):
    ops = F.when(F.col("s_acctbal") > 5000, "PACK; API MANUFACTURE").when(F.col("s_acctbal") > 0, "PACK;LABEL ")
    r = t.supplier.select(F.col("s_nationkey").alias("firm"), F.col("s_suppkey").alias("fei"), F.concat(F.lit("c"), (F.col("s_suppkey") % 3).cast("string")).alias("country"), ops.alias("ops"))
    i = R.firm_index(r, "firm", "fei", "country", "ops")
    return i.select("firm", F.size("feis").cast("long").alias("feis"), F.array_join("countries", "|").alias("countries"), F.array_join("operations", "|").alias("operations"), "api")


@query("q78_first_match_join", """WITH r AS (SELECT lower(p_name) AS k, p_partkey, p_brand, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY lower(p_name)) AS sites FROM part WHERE p_size > 5)
SELECT p.p_partkey AS id, r.sites, r.p_brand AS brand FROM part p LEFT JOIN r ON lower(p.p_name) = r.k AND rn = 1 WHERE p.p_size <= 5""")
def q78(t):
    left = t.part.filter("p_size <= 5").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"))
    right = t.part.filter("p_size > 5").select("p_partkey", F.col("p_name").alias("rname"), F.col("p_brand").alias("brand"))
    return R.first_match(left, right, F.lower("name"), F.lower("rname"), "p_partkey", ["brand"]).select("id", "sites", "brand")


@query("q79_priced_products", """WITH c AS (SELECT p_brand AS generic, lpad((p_partkey % 5000)::VARCHAR, 5, '0') || lpad(p_size::VARCHAR, 4, '0') || '07' AS ndc FROM part), d AS (SELECT ndc, min(generic) AS generic FROM c GROUP BY 1)
SELECT generic, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part JOIN d ON d.ndc = lpad((p_partkey % 5000)::VARCHAR, 5, '0') || lpad(p_size::VARCHAR, 4, '0') || '07' GROUP BY 1""")
def q79(t):
    code = F.concat_ws("-", (F.col("p_partkey") % 5000).cast("string"), F.col("p_size").cast("string"), F.lit("7"))
    prod = t.part.select(F.col("p_brand").alias("generic"), F.array(code, F.lit("bad")).alias("packages"))
    price = t.part.select(F.concat(F.lpad((F.col("p_partkey") % 5000).cast("string"), 5, "0"), F.lpad(F.col("p_size").cast("string"), 4, "0"), F.lit("07")).alias("ndc"), F.col("p_retailprice").alias("price"))
    return R.priced_products(prod, price).groupBy("generic").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("q80_filing_number", """WITH f AS (SELECT DISTINCT upper(replace(p_name, ' ', '')) AS h, p_type AS substance, p_partkey AS filing FROM part), e AS (SELECT h, substance, min(filing) AS f1 FROM f GROUP BY 1, 2), n AS (SELECT substr(h, 1, 8) AS p, substance, min(filing) AS f2 FROM f GROUP BY 1, 2)
SELECT p_partkey AS id, coalesce(f1, f2) AS filing FROM (SELECT *, upper(replace(p_name, ' ', '')) || CASE WHEN p_partkey % 2 = 0 THEN 'CO' ELSE '' END AS hh FROM part) x LEFT JOIN e ON e.h = hh AND e.substance = p_type LEFT JOIN n ON n.p = substr(hh, 1, 8) AND n.substance = p_type""")
def q80(t):
    f = t.part.select(F.col("p_name").alias("holder"), F.col("p_type").alias("substance"), F.col("p_partkey").alias("filing"))
    h = t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " co.").otherwise("")).alias("holder"), F.col("p_type").alias("substance"))
    return R.filing_number(h, f).select("id", "filing")


@query("q81_marketers_per_drug", "SELECT p_brand AS drug, count(DISTINCT l_suppkey) AS labelers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def q81(t):
    m = t.lineitem.select(F.col("l_suppkey").alias("labeler"), F.col("l_partkey").alias("product"))
    return R.marketers_per_drug(m, t.part.select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("drug")))


@query("q82_essential_marks", """SELECT p_partkey AS id, p_name LIKE 'hot %' OR p_name = 'blue ring' OR p_name LIKE 'red b%' AS critical FROM part""")
def q82(t):
    n = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_name").startswith("hot "), "Hot").when(F.col("p_name").startswith("red b"), "red b").otherwise(F.col("p_name")).alias("label"))
    e = t.spark.createDataFrame([("HOT things",), ("blue ring, large",), ("blue bolted",), ("Red B (old)",)], "entry string")
    return R.essential(n, e).select("id", "critical")


@query("q83_routed_keys", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'n' || user_id ELSE 'd' || user_id END AS key, CASE WHEN event_id % 3 = 0 AND user_id < 50 THEN 'bin ' || user_id ELSE 'Unregistered: ' || CASE WHEN event_id % 3 = 0 THEN 'n' || user_id ELSE 'd' || user_id END END AS bin_label,
 CASE WHEN event_id % 3 = 0 AND user_id < 50 THEN 'cool' ELSE 'crt' END AS storage_class, CASE WHEN event_id % 5 = 0 THEN 'de' WHEN event_id % 3 = 0 AND user_id < 50 THEN 'fr' END AS bin_country FROM events""")
def q83(t):
    u = F.col("user_id").cast("string")
    r = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("n"), u)).alias("node_id"), F.concat(F.lit("d"), u).alias("device_id"), F.when(F.col("event_id") % 5 == 0, "DE").alias("country"))
    b = t.spark.range(50).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.concat(F.lit("bin "), F.col("id").cast("string")).alias("label"), F.lit("cool").alias("storage_class"), F.lit("FR").alias("country"))
    return T.routed(r, b).select("event_id", "key", "bin_label", "storage_class", "bin_country")
