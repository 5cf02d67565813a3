"""Market structure, rankings and calibration over the star tables.

A listing is a line of an order (generic: the part's brand, labeler: the supplier, start: the ship date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import wilson
from ..operators import fuzzy, pointintime, stats
from .registry import Tables, query, r6

CUTOFF = "1998-06-01"


def listings(t: Tables) -> DataFrame:
    part = t.part.select("p_partkey", "p_brand", "p_type")
    line = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("labeler"), F.col("l_shipdate").alias("start"))
    return line.join(part, "p_partkey").select(F.col("p_brand").alias("generic"), "labeler", "start", F.col("p_type").alias("form"))


L = "listings AS (SELECT p_brand AS generic, l_suppkey AS labeler, l_shipdate AS start, p_type AS form FROM lineitem JOIN part ON l_partkey = p_partkey)"
M = f"market AS (SELECT generic, labeler, count(*) AS products FROM listings WHERE start < TIMESTAMP '{CUTOFF}' AND length(generic) >= 4 GROUP BY ALL)"
# supplier scores: a value per supplier to rank, and whether it had a return on or after the cutoff
S = f"""s AS (SELECT s_suppkey AS id, s_acctbal AS score FROM supplier),
y AS (SELECT l_suppkey AS id, count(*) FILTER (l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '{CUTOFF}' AND l_quantity > 49) > (SELECT count(*) FILTER (l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '{CUTOFF}' AND l_quantity > 49)::DOUBLE / count(DISTINCT l_suppkey) FROM lineitem) AS late FROM lineitem GROUP BY 1),
d AS (SELECT id, score, late::INT AS label FROM s JOIN y USING (id))"""


def scored_suppliers(t: Tables) -> DataFrame:
    bad = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit(CUTOFF).cast("timestamp")) & (F.col("l_quantity") > 49)
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count_if(bad).alias("n"))
    mean = n.agg((F.sum("n") / F.count(F.lit(1))).alias("mean"))
    y = n.join(F.broadcast(mean)).select("id", (F.col("n") > F.col("mean")).cast("int").alias("label"))  # one row
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score")).join(y, "id")


def order_risk(t: Tables) -> DataFrame:
    """A probability-like score per order and whether it is closed."""
    o = t.orders
    return o.select(F.col("o_orderkey").alias("id"), (F.pmod(F.col("o_totalprice"), F.lit(1000.0)) / 1000).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


O = "o AS (SELECT o_orderkey AS id, (o_totalprice % 1000.0::DOUBLE) / 1000 AS score, (o_orderstatus = 'F')::INT AS label FROM orders)"  # noqa: E741


@query("q01_hhi_by_brand_at_cutoff", f"""WITH {L}, {M}, t AS (SELECT generic, sum(products) AS n FROM market GROUP BY 1 HAVING sum(products) >= 3)
SELECT generic, round(sum(pow(products / n::DOUBLE, 2)), 6) AS hhi, count(*) AS labelers, n::BIGINT AS products FROM market JOIN t USING (generic) GROUP BY generic, n""")
def q01(t):
    m = pointintime.market_at(listings(t), F.lit(CUTOFF).cast("timestamp"))
    h = stats.hhi(m, "generic", "labeler", F.col("products")).filter("total >= 3")
    return h.select("generic", r6("hhi").alias("hhi"), F.col("parts").alias("labelers"), F.col("total").cast("long").alias("products"))


@query("q02_market_structure_forms", f"""WITH {L} SELECT generic, count(DISTINCT form) AS forms, bool_or(contains(form, 'ECON')) AS has_econ, array_to_string(list_sort(list(DISTINCT form)), ',') AS form_list
FROM listings WHERE start < TIMESTAMP '{CUTOFF}' GROUP BY 1""")
def q02(t):
    g = listings(t).filter(F.col("start") < F.lit(CUTOFF).cast("timestamp")).groupBy("generic")
    return g.agg(F.count_distinct("form").alias("forms"), F.bool_or(F.contains(F.col("form"), F.lit("ECON"))).alias("has_econ"), F.array_join(F.array_sort(F.collect_set("form")), ",").alias("form_list"))


@query("q03_price_trend_upper_median", """WITH p AS (SELECT l_partkey AS part, l_shipdate AS day, l_extendedprice / l_quantity AS price FROM lineitem),
e AS (SELECT part, count(*) AS n, arg_min(price, (day, price)) AS first, arg_max(price, (day, price)) AS last FROM p WHERE price > 0 GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT part, p_brand AS brand, (last - first) / first AS change FROM e JOIN part ON part = p_partkey)
SELECT brand, count(*) AS n, round(list_sort(list(change))[(count(*) // 2 + 1)::INT], 6) AS median FROM c GROUP BY 1 HAVING count(*) >= 2""")
def q03(t):
    p = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    c = pointintime.price_trend(p, "part", "day", "price").join(t.part.select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand")), "part")
    return stats.upper_median(c, "brand", "change").select("brand", "n", r6("median").alias("median"))


@query("q04_rank_auc", f"""WITH {S}, r AS (SELECT label, avg(rn) OVER (PARTITION BY score) AS mr FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn FROM d))
SELECT sum(label)::BIGINT AS n_pos, (count(*) - sum(label))::BIGINT AS n_neg, round((sum(mr * label) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r""")
def q04(t):
    return stats.auc(scored_suppliers(t), "score", "label").select("n_pos", "n_neg", r6("auc").alias("auc"))


@query("q05_auc_by_exposure_stratum", f"""WITH {O}, b AS (SELECT *, least((row_number() OVER (ORDER BY score, id) - 1) // greatest(1, count(*) OVER () // 5), 4)::INT AS bucket FROM o),
r AS (SELECT bucket, label, avg(rn) OVER (PARTITION BY bucket, score) AS mr FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score) AS rn FROM b))
SELECT bucket, sum(label)::BIGINT AS n_pos, (count(*) - sum(label))::BIGINT AS n_neg, round((sum(mr * label) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r GROUP BY 1""")
def q05(t):
    b = stats.equal_buckets(order_risk(t), [F.col("score"), F.col("id")], 5)
    return stats.auc(b, "score", "label", ["bucket"]).select("bucket", "n_pos", "n_neg", r6("auc").alias("auc"))


@query("q06_average_precision_p_at_k", f"""WITH {S}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk FROM d), c AS (SELECT *, sum(label) OVER (ORDER BY rk) AS tp FROM r)
SELECT k, round(sum(label) FILTER (rk <= k) / k::DOUBLE, 6) AS precision, round(sum(label) FILTER (rk <= k)::DOUBLE / sum(label), 6) AS recall, (SELECT round(sum(CASE WHEN label = 1 THEN tp / rk::DOUBLE END) / sum(label), 6) FROM c) AS average_precision
FROM r, (SELECT unnest([5, 10, 20]) AS k) GROUP BY k""")
def q06(t):
    d = scored_suppliers(t)
    p = stats.precision_at(d, "score", "label", "id", [5, 10, 20])
    ap = stats.average_precision(d, "score", "label", "id")
    return p.join(F.broadcast(ap)).select("k", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("average_precision").alias("average_precision"))  # one row


CONF = """round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy"""


def rounded_confusion(df):
    return df.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "accuracy")})


@query("q07_threshold_confusion_table", f"""WITH {O}, c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn FROM o, (SELECT unnest([0.5::DOUBLE, 0.2, 0.1, 0.05]) AS threshold) GROUP BY 1)
SELECT threshold, tp, fp, tn, fn, tp + fp AS flagged, {CONF} FROM c""")
def q07(t):
    return rounded_confusion(stats.threshold_table(order_risk(t), "score", "label"))


@query("q08_equal_bucket_calibration", f"""WITH {O}, b AS (SELECT *, least((row_number() OVER (ORDER BY score, id) - 1) // greatest(1, count(*) OVER () // 7), 6)::INT AS bucket FROM o)
SELECT bucket, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(label), 6) AS observed FROM b GROUP BY 1""")
def q08(t):
    b = stats.equal_buckets(order_risk(t), [F.col("score"), F.col("id")], 7)
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("predicted"), r6(F.avg("label")).alias("observed"))


@query("q09_wilson_reliability", f"""WITH {O}, g AS (SELECT CASE WHEN score >= 0.5 THEN 4 WHEN score >= 0.2 THEN 3 WHEN score >= 0.1 THEN 2 WHEN score >= 0.05 THEN 1 ELSE 0 END AS band, count(*) AS n, sum(label)::BIGINT AS k, avg(score) AS predicted FROM o GROUP BY 1),
w AS (SELECT *, k / n::DOUBLE AS p, (k / n::DOUBLE + 3.8416::DOUBLE / (2 * n)) AS mid, 1.96::DOUBLE * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 3.8416::DOUBLE / (4.0::DOUBLE * n * n)) AS half, 1 + 3.8416::DOUBLE / n AS d FROM g)
SELECT band, n, k, round(predicted, 6) AS predicted, round(p, 6) AS observed, round(greatest(0, (mid - half) / d), 6) AS lo, round(least(1, (mid + half) / d), 6) AS hi, predicted BETWEEN (mid - half) / d AND (mid + half) / d AS inside FROM w""")
def q09(t):
    r = stats.reliability(order_risk(t), "score", "label", [0.05, 0.1, 0.2, 0.5])
    return r.withColumns({c: r6(c) for c in ("predicted", "observed", "lo", "hi")})


@query("q10_permutation_p_auc", f"""WITH {S}, m AS (SELECT id, label, avg(rn) OVER (PARTITION BY score) AS mr FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn FROM d)),
t AS (SELECT sum(label) AS np, count(*) AS n, sum(mr * label) AS r FROM m),
k AS (SELECT rep, id, mr, row_number() OVER (PARTITION BY rep ORDER BY (id * 2654435761 + rep * 40503) % 1000003, id) AS rn FROM m, range(1, 301) AS g(rep)),
e AS (SELECT rep, sum(mr) AS rr FROM k, t WHERE rn <= np GROUP BY 1),
a AS (SELECT abs((rr - np * (np + 1) / 2.0::DOUBLE) / (np * (n - np)) - 0.5) AS dd, (r - np * (np + 1) / 2.0::DOUBLE) / (np * (n - np)) AS auc FROM e, t)
SELECT round(any_value(auc), 6) AS auc, count(*) FILTER (dd >= abs(auc - 0.5) - 1e-12) AS hits, round((count(*) FILTER (dd >= abs(auc - 0.5) - 1e-12) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM a""")
def q10(t):
    key = F.pmod(F.col("id") * F.lit(2654435761) + F.col("rep") * F.lit(40503), F.lit(1000003))
    return stats.permutation_p(scored_suppliers(t), "score", "label", "id", 300, key, (0.0, 1000003.0)).select(r6("auc").alias("auc"), "hits", r6("p").alias("p"))


@query("q17_dedupe_entry_lines", """SELECT l_orderkey, l_shipdate::DATE::VARCHAR AS day, l_returnflag, count(*) AS entry_lines, arg_min(l_suppkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3""")
def q17(t):
    from ..operators.merge import dedupe_lines

    d = t.lineitem.withColumn("day", F.col("l_shipdate").cast("date").cast("string")).withColumn("ord", F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey"))
    return dedupe_lines(d, ["l_orderkey", "day", "l_returnflag"], "ord", ["l_suppkey"])


@query("q54_country_share_plurality", """WITH n AS (SELECT l_partkey AS part, s_nationkey AS nation, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT part, round(sum(CASE WHEN nation IN (1, 2) THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS listed_share, round(max(n) / sum(n)::DOUBLE, 6) AS plurality, count(*) AS countries FROM n GROUP BY 1""")
def q54(t):
    d = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s_suppkey")).join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation")), "s_suppkey")
    return pointintime.country_share(d, "part", "nation", [1, 2]).select("part", r6("listed_share").alias("listed_share"), r6("plurality").alias("plurality"), "countries")


@query("q55_filings_and_owners", """SELECT p_brand AS substance, count(*) AS filings, count(DISTINCT l_suppkey) AS holders, count(DISTINCT coalesce(nullif(s_nationkey, 3), 1000 + l_suppkey)) AS owners
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def q55(t):
    d = t.lineitem.select("l_partkey", "l_suppkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("substance")), "l_partkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    owner = F.coalesce(F.nullif(F.col("s_nationkey").cast("long"), F.lit(3).cast("long")), F.col("l_suppkey") + 1000)
    return d.groupBy("substance").agg(F.count(F.lit(1)).alias("filings"), F.count_distinct("l_suppkey").alias("holders"), F.count_distinct(owner).alias("owners"))


def model_rows(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(F.col("o_orderkey").alias("id"), F.log1p("o_totalprice").alias("price"), F.month("o_orderdate").cast("double").alias("month"), F.pmod("o_custkey", F.lit(7)).cast("double").alias("cust7"), (F.pmod("o_custkey", F.lit(7)) + F.pmod("o_orderkey", F.lit(5)) > 6).cast("int").alias("label"))


@query("q48_oof_logistic_auc")
def q48(t):
    scored = stats.out_of_fold(model_rows(t), "id", ["price", "month", "cust7"], "label")
    return stats.auc(scored, "oof", "label", ["fold"]).select("fold", "n_pos", "n_neg", r6("auc").alias("auc"))


@query("q49_isotonic_pava")
def q49(t):
    curve = stats.pava(order_risk(t), "score", "label", "id")
    return curve.withColumn("w", wilson(F.bround(F.col("p") * F.col("n")), F.col("n"))).select(r6("at").alias("at"), r6("p").alias("p"), "n", r6("w.lo").alias("lo"), r6("w.hi").alias("hi"))


@query("q56_isotonic_fit", f"""WITH {O}, r AS (SELECT *, row_number() OVER (ORDER BY score, id) AS rn, count(*) OVER () AS n FROM o),
b AS (SELECT least((rn - 1) // 40, greatest(0, n // 40 - 1))::INT AS bin, count(*) AS n, sum(label)::DOUBLE AS k FROM r GROUP BY 1),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cn, sum(k) OVER (ORDER BY bin) AS ck, n, k FROM b),
m AS (SELECT i.bin, a.bin AS a, min((z.ck - a.ck + a.k) / (z.cn - a.cn + a.n)) AS lo FROM c i JOIN c a ON a.bin <= i.bin JOIN c z ON z.bin >= i.bin GROUP BY 1, 2)
SELECT bin, round(max(lo), 6) AS p FROM m GROUP BY 1""")
def q56(t):
    """The isotonic fit of each pooled bin."""
    blocks = stats.isotonic_blocks(stats.pooled_bins(order_risk(t), "score", "label", "id"))
    return blocks.select(F.explode(F.sequence(F.col("bin").cast("int"), F.col("to").cast("int"))).alias("bin"), r6("p").alias("p"))


@query("q50_boosted_stumps")
def q50(t):
    rows = model_rows(t)
    model = stats.stumps(rows, ["price", "month", "cust7"], "label")
    return stats.auc(rows.withColumn("s", stats.stumps_score(model)), "s", "label").select("n_pos", "n_neg", r6("auc").alias("auc"))


@query("q57_standard_scale", "WITH m AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM orders) SELECT o_orderkey AS id, round((o_totalprice - mu) / sd, 4) AS z FROM orders, m")
def q57(t):
    (mu,), (sd,) = stats.standard_scale(t.orders, ["o_totalprice"])
    return t.orders.select(F.col("o_orderkey").alias("id"), F.round((F.col("o_totalprice") - mu) / sd, 4).alias("z"))


@query("q58_er_confusion", f"""WITH {O}, c AS (SELECT count(*) FILTER (score >= 0.6 AND label = 1) AS tp, count(*) FILTER (score >= 0.6 AND label = 0) AS fp, count(*) FILTER (score < 0.6 AND label = 0) AS tn, count(*) FILTER (score < 0.6 AND label = 1) AS fn FROM o)
SELECT tp, fp, tn, fn, {CONF} FROM c""")
def q58(t):
    return rounded_confusion(fuzzy.confusion(order_risk(t), F.col("score") >= 0.6, F.col("label") == 1))
