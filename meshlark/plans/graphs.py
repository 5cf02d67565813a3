"""Graph queries over the star tables as a supply network, and what-if scenarios.

Nodes: regions r, nations n, suppliers s, parts p, orders o. Edges: region hosts nation, nation hosts supplier, part
produced_by supplier (so reversed for flow), part formulated_into order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, whatif
from .registry import Tables, query, r6


def nid(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def edges(t: Tables, once: bool = True) -> DataFrame:
    """The edges; unless each must stand there once, a line's edges stand there for every line."""
    line, one = t.lineitem, lambda df: df.distinct() if once else df
    return (
        t.nation.select(nid("r", "n_regionkey").alias("src"), nid("n", "n_nationkey").alias("dst"), F.lit("hosts").alias("rel"))
        .unionByName(t.supplier.select(nid("n", "s_nationkey").alias("src"), nid("s", "s_suppkey").alias("dst"), F.lit("hosts").alias("rel")))
        .unionByName(one(line.select(nid("p", "l_partkey").alias("src"), nid("s", "l_suppkey").alias("dst"), F.lit("produced_by").alias("rel"))))
        .unionByName(one(line.select(nid("p", "l_partkey").alias("src"), nid("o", "l_orderkey").alias("dst"), F.lit("formulated_into").alias("rel"))))
    )


E = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'hosts' AS rel FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'hosts' FROM supplier
UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'produced_by' FROM lineitem UNION ALL SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey, 'formulated_into' FROM lineitem),
f AS (SELECT CASE WHEN rel = 'produced_by' THEN dst ELSE src END AS src, CASE WHEN rel = 'produced_by' THEN src ELSE dst END AS dst, rel FROM e)"""


def seeds(t: Tables, *ids: str) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in ids], "seed string")


@query("q25_reach_from_node", f"WITH RECURSIVE {E}, x(id, depth) AS (SELECT 'n3', 0 UNION SELECT f.dst, depth + 1 FROM x JOIN f ON x.id = f.src WHERE depth < 6) SELECT id, min(depth)::INT AS depth FROM x GROUP BY 1")
def q25(t):
    return graph.reach(graph.oriented(edges(t)), seeds(t, "n3")).select("id", "depth")


@query("q26_downstream_rel_filtered", f"WITH RECURSIVE {E}, x(seed, id) AS (SELECT s, s FROM (SELECT unnest(['p7', 'p8', 'n1']) AS s) UNION SELECT x.seed, f.dst FROM x JOIN f ON x.id = f.src AND f.rel IN ('feeds', 'active_in', 'formulated_into')) SELECT * FROM x")
def q26(t):
    return graph.reach(graph.oriented(edges(t)), seeds(t, "p7", "p8", "n1"), ["feeds", "active_in", "formulated_into"]).select("seed", "id")


@query("q70_undirected_spine", f"WITH RECURSIVE {E}, u AS (SELECT src, dst FROM e WHERE rel = 'hosts' UNION SELECT dst, src FROM e WHERE rel = 'hosts'), x(id) AS (SELECT 'n2' UNION SELECT u.dst FROM x JOIN u ON x.id = u.src) SELECT * FROM x")
def q70(t):
    return graph.component(edges(t), seeds(t, "n2"), ["hosts"]).select("id")


def scores(t: Tables) -> DataFrame:
    return t.supplier.filter("s_acctbal > 6000").select(nid("s", "s_suppkey").alias("node_id"), F.round(F.pmod(F.col("s_acctbal"), F.lit(97.0)) / 97, 6).alias("p12"))


def graph_nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()


@query("q27_propagate_worst_risk", f"""WITH RECURSIVE {E}, sc AS (SELECT 's' || s_suppkey AS id, round((s_acctbal - 97 * floor(s_acctbal / 97)) / 97, 6) AS p FROM supplier WHERE s_acctbal > 6000),
x(origin, id) AS (SELECT id, id FROM sc UNION SELECT x.origin, f.dst FROM x JOIN f ON x.id = f.src AND f.rel NOT IN ('marketed_as', 'formulated_into')),
st AS (SELECT x.id, max(p) AS p12, 'inherited' AS attribution FROM x JOIN sc ON x.origin = sc.id WHERE x.id NOT IN (SELECT id FROM sc) GROUP BY 1),
k AS (SELECT id, p AS p12, 'direct' AS attribution FROM sc UNION ALL SELECT * FROM st),
wk AS (SELECT f.dst AS id, max(p12) AS p12, 'molecule' AS attribution FROM k JOIN f ON k.id = f.src AND f.rel = 'formulated_into' GROUP BY 1)
SELECT id AS node_id, p12, attribution FROM k UNION ALL SELECT * FROM wk""")
def q27(t):
    e = edges(t, once=False)
    return graph.propagate_max(e, scores(t)).select("node_id", "p12", "attribution")


@query("q28_weak_fill_attribution", f"""WITH RECURSIVE {E}, sc AS (SELECT 's' || s_suppkey AS id, round((s_acctbal - 97 * floor(s_acctbal / 97)) / 97, 6) AS p FROM supplier WHERE s_acctbal > 6000),
st AS (SELECT f.dst AS id, arg_min(sc.id, (-p, sc.id)) AS origin FROM sc JOIN f ON sc.id = f.src WHERE f.rel = 'produced_by' GROUP BY 1),
sp AS (SELECT st.id, st.origin, p FROM st JOIN sc ON st.origin = sc.id)
SELECT f.dst AS node_id, arg_min(sp.origin, (-p, sp.origin)) AS origin FROM sp JOIN f ON sp.id = f.src AND f.rel = 'formulated_into' GROUP BY 1""")
def q28(t):
    e = edges(t, once=False)
    return graph.propagate_max(e, scores(t)).filter("attribution = 'molecule'").select("node_id", "origin")


@query("q71_coverage", f"""WITH {E}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), sc AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal > 6000), st AS (SELECT DISTINCT dst AS id FROM f WHERE rel = 'produced_by' AND src IN (SELECT id FROM sc)), wk AS (SELECT DISTINCT dst AS id FROM f WHERE rel = 'formulated_into' AND src IN (SELECT id FROM st))
SELECT CASE WHEN id IN (SELECT id FROM sc) THEN 'direct' WHEN id IN (SELECT id FROM st) THEN 'inherited' WHEN id IN (SELECT id FROM wk) THEN 'molecule' ELSE 'uncovered' END AS basis, count(*) AS nodes FROM n GROUP BY 1""")
def q71(t):
    e = edges(t, once=False)
    return graph.coverage(graph_nodes(e), graph.propagate_max(e, scores(t)))


@query("q29_upstream_plant_count", f"WITH {E} SELECT id, count(DISTINCT plant) AS plants FROM (SELECT src AS id, src AS plant FROM f WHERE rel = 'produced_by' UNION ALL SELECT dst, src FROM f WHERE rel = 'produced_by' UNION ALL SELECT g.dst, f.src FROM f JOIN f g ON f.dst = g.src WHERE f.rel = 'produced_by' AND g.rel = 'formulated_into') GROUP BY 1")
def q29(t):
    e = edges(t)
    producers = e.filter("rel = 'produced_by'").select(F.col("dst").alias("id")).distinct().withColumn("fei", F.col("id"))
    return graph.upstream_sets(e, producers)


@query("q151_blast_radius", f"WITH RECURSIVE {E}, x(seed, id) AS (SELECT * FROM (SELECT src, src FROM f UNION SELECT dst, dst FROM f) UNION SELECT x.seed, f.dst FROM x JOIN f ON x.id = f.src) SELECT seed AS id, count(*) - 1 AS reached FROM x GROUP BY 1")
def q151(t):
    return graph.blast_radius(edges(t, once=False))


@query("q72_lowest_layer_country", """WITH x AS (SELECT l_suppkey AS id, l_linenumber % 3 + 1 AS layer, 'country:c' || (l_partkey % 9) AS dst FROM lineitem WHERE l_suppkey % 7 <> 3), m AS (SELECT id, arg_min(dst, (layer, dst)) AS dst FROM x GROUP BY 1)
SELECT 's' || s_suppkey AS id, coalesce(replace(dst, 'country:', ''), 'n' || s_nationkey) AS country FROM supplier LEFT JOIN m ON s_suppkey = m.id""")
def q72(t):
    e = t.lineitem.filter("l_suppkey % 7 <> 3").select(nid("s", "l_suppkey").alias("src"), F.lit("incorporated_in").alias("rel"), F.concat(F.lit("country:c"), (F.col("l_partkey") % 9).cast("string")).alias("dst"), (F.col("l_linenumber") % 3 + 1).alias("layer"))
    n = t.supplier.select(nid("s", "s_suppkey").alias("id"), F.lit("company").alias("type"), nid("n", "s_nationkey").alias("country"))
    return graph.lowest_layer_country(e, n).select("id", "country")


@query("q73_guarded_inverse", """SELECT 's' || ((a.s_suppkey + 25) % 100) AS src, 's' || a.s_suppkey AS dst, 'hosts' AS rel FROM supplier a JOIN supplier b ON b.s_suppkey = (a.s_suppkey + 25) % 100 WHERE a.s_nationkey % 2 = b.s_nationkey % 2 AND a.s_nationkey <> 4 AND b.s_nationkey <> 4""")
def q73(t):
    s = t.supplier
    e = s.select(nid("s", "s_suppkey").alias("src"), F.concat(F.lit("s"), ((F.col("s_suppkey") + 25) % 100).cast("string")).alias("dst"), F.lit("operated_by").alias("rel"))
    n = s.select(nid("s", "s_suppkey").alias("id"), F.when(F.col("s_nationkey") != 4, F.col("s_nationkey") % 2).alias("country"))
    return graph.guarded_inverse(e, n)


# The bill of materials: a part is a precursor of the api named by its brand and name, which is active in the drug of its
# brand and, for large parts, in that of its type. Suppliers make the parts of their lines; lines of 50 are whole apis.
ROOTS = "SELECT DISTINCT 'drug:' || p_brand AS id FROM part UNION SELECT 'drug:' || p_type FROM part WHERE p_size > 45"
TREE_SQL = f"""e AS (SELECT DISTINCT 'api:' || p_brand || ' ' || p_name AS src, 'active_in' AS rel, 'drug:' || p_brand AS dst FROM part
 UNION ALL SELECT DISTINCT 'api:' || p_brand || ' ' || p_name, 'active_in', 'drug:' || p_type FROM part WHERE p_size > 45
 UNION ALL SELECT 'precursor:' || p_partkey, 'feeds', 'api:' || p_brand || ' ' || p_name FROM part
 UNION ALL SELECT DISTINCT 'precursor:' || l_partkey, 'produced_by', 'company:' || l_suppkey FROM lineitem
 UNION ALL SELECT DISTINCT 'api:' || p_brand || ' ' || p_name, 'produced_by', 'company:' || l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50),
sc AS (SELECT 'none' AS scenario_id, NULL AS off_id UNION ALL SELECT 'one', 'company:' || min(s_suppkey) FROM supplier UNION ALL SELECT 'land', 'country:n' || max(n_nationkey) FROM nation UNION ALL SELECT 'lands', 'country:n' || n_nationkey FROM nation WHERE n_regionkey = 1
 UNION ALL SELECT 'poor', 'company:' || s_suppkey FROM supplier WHERE s_acctbal < 5000 UNION ALL SELECT 'api', min('api:' || p_brand || ' ' || p_name) FROM part UNION ALL SELECT 'root', min('drug:' || p_brand) FROM part UNION ALL SELECT 'gate', 'precursor:' || p_partkey FROM part WHERE p_brand = 'Brand#3'),
ids AS (SELECT DISTINCT scenario_id FROM sc),
iso AS (SELECT 'company:' || s_suppkey AS id, 'n' || s_nationkey AS iso FROM supplier WHERE s_acctbal > 0),
dr AS (SELECT id AS key, id FROM ({ROOTS})),
ap AS (SELECT dr.key || '|' || src AS key, src AS id, dr.key AS parent_key FROM dr JOIN e ON rel = 'active_in' AND dst = dr.id),
pr AS (SELECT ap.key || '|' || src AS key, src AS id, ap.key AS parent_key FROM ap JOIN e ON rel = 'feeds' AND dst = ap.id),
t0 AS (SELECT key, id, NULL AS parent_key, 'drug' AS kind, 'drug' AS tier FROM dr UNION ALL SELECT *, 'api', 'api' FROM ap UNION ALL SELECT *, 'precursor', 'precursor' FROM pr
 UNION ALL SELECT ap.key || '|' || dst, dst, ap.key, 'supplier', 'api' FROM ap JOIN e ON rel = 'produced_by' AND src = ap.id UNION ALL SELECT pr.key || '|' || dst, dst, pr.key, 'supplier', 'precursor' FROM pr JOIN e ON rel = 'produced_by' AND src = pr.id),
tr AS (SELECT t0.*, iso FROM t0 LEFT JOIN iso USING (id)),
own AS (SELECT scenario_id, key FROM tr JOIN sc ON off_id = id UNION SELECT scenario_id, key FROM tr JOIN sc ON off_id = 'country:' || iso),
w AS (SELECT i.scenario_id, tr.*, o.key IS NOT NULL AS own FROM ids i CROSS JOIN tr LEFT JOIN own o ON o.scenario_id = i.scenario_id AND o.key = tr.key),
ddr AS (SELECT *, own AS dead FROM w WHERE kind = 'drug'),
dap AS (SELECT w.*, w.own OR d.dead AS dead FROM w JOIN ddr d ON d.scenario_id = w.scenario_id AND d.key = w.parent_key WHERE w.kind = 'api'),
dpr AS (SELECT w.*, w.own OR d.dead AS dead FROM w JOIN dap d ON d.scenario_id = w.scenario_id AND d.key = w.parent_key WHERE w.kind = 'precursor'),
lv AS (SELECT scenario_id, parent_key AS key, bool_and(own) AS halted FROM w WHERE kind = 'supplier' AND tier = 'precursor' GROUP BY 1, 2),
g AS (SELECT w.scenario_id, w.parent_key AS key, bool_and(w.own OR coalesce(halted, false)) AS gated FROM w LEFT JOIN lv ON lv.scenario_id = w.scenario_id AND lv.key = w.key WHERE kind = 'precursor' GROUP BY 1, 2),
dsa AS (SELECT w.*, w.own OR d.dead OR coalesce(gated, false) AS dead FROM w JOIN dap d ON d.scenario_id = w.scenario_id AND d.key = w.parent_key LEFT JOIN g ON g.scenario_id = w.scenario_id AND g.key = w.parent_key WHERE w.kind = 'supplier' AND w.tier = 'api'),
dsp AS (SELECT w.*, w.own OR d.dead AS dead FROM w JOIN dpr d ON d.scenario_id = w.scenario_id AND d.key = w.parent_key WHERE w.kind = 'supplier' AND w.tier = 'precursor'),
cut AS (SELECT * FROM ddr UNION ALL SELECT * FROM dap UNION ALL SELECT * FROM dpr UNION ALL SELECT * FROM dsa UNION ALL SELECT * FROM dsp)"""
ROLL_SQL = f"""{TREE_SQL}, lf AS (SELECT scenario_id, parent_key AS key, count(*) AS t, count(*) FILTER (NOT dead) AS u FROM cut WHERE kind = 'supplier' GROUP BY 1, 2),
rp AS (SELECT d.scenario_id, d.key, d.id, d.parent_key, coalesce(t, 1) AS total, CASE WHEN dead THEN 0 ELSE coalesce(u, 1) END AS up FROM dpr d LEFT JOIN lf ON lf.scenario_id = d.scenario_id AND lf.key = d.key),
sp AS (SELECT scenario_id, parent_key AS key, sum(total) AS t, sum(up) AS u FROM rp GROUP BY 1, 2),
ra AS (SELECT d.scenario_id, d.key, d.id, d.parent_key, coalesce(lf.t, sp.t, 1) AS total, CASE WHEN dead THEN 0 ELSE coalesce(lf.u, sp.u, 1) END AS up FROM dap d LEFT JOIN lf ON lf.scenario_id = d.scenario_id AND lf.key = d.key LEFT JOIN sp ON sp.scenario_id = d.scenario_id AND sp.key = d.key),
sa AS (SELECT scenario_id, parent_key AS key, sum(total) AS t, sum(up) AS u FROM ra GROUP BY 1, 2),
rd AS (SELECT d.scenario_id, d.key, d.id, coalesce(t, 1) AS total, CASE WHEN dead THEN 0 ELSE coalesce(u, 1) END AS up FROM ddr d LEFT JOIN sa ON sa.scenario_id = d.scenario_id AND sa.key = d.key),
r AS (SELECT scenario_id, key, id, 'drug' AS kind, total, up FROM rd UNION ALL SELECT scenario_id, key, id, 'api', total, up FROM ra UNION ALL SELECT scenario_id, key, id, 'precursor', total, up FROM rp UNION ALL SELECT scenario_id, key, id, 'supplier', 1, (NOT dead)::INT FROM cut WHERE kind = 'supplier'),
h AS (SELECT scenario_id, key, id, kind, total::BIGINT AS total, up::BIGINT AS up, CASE WHEN up = 0 THEN 'down' WHEN up < total THEN 'at-risk' ELSE 'ok' END AS health FROM r)"""


def bom(t: Tables) -> DataFrame:
    """The edges; one may stand there twice."""
    part = t.part.select("p_partkey", "p_brand", "p_type", "p_size", F.concat(F.lit("api:"), "p_brand", F.lit(" "), "p_name").alias("api"))
    to = lambda df, src, rel, dst: df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    pre, maker = nid("precursor:", "l_partkey"), nid("company:", "l_suppkey")
    whole = t.lineitem.filter("l_quantity = 50").join(part, F.col("p_partkey") == F.col("l_partkey"))
    return (
        to(part, F.col("api"), "active_in", nid("drug:", "p_brand"))
        .unionByName(to(part.filter("p_size > 45"), F.col("api"), "active_in", nid("drug:", "p_type")))
        .unionByName(to(part, nid("precursor:", "p_partkey"), "feeds", F.col("api")))
        .unionByName(to(t.lineitem, pre, "produced_by", maker))
        .unionByName(to(whole, F.col("api"), "produced_by", maker))
        .unionByName(to(t.supplier.filter("s_acctbal > 0"), nid("company:", "s_suppkey"), "incorporated_in", nid("country:n", "s_nationkey")))
    )


def chain(t: Tables) -> whatif.Chain:
    roots = t.part.select(nid("drug:", "p_brand").alias("id")).unionByName(t.part.filter("p_size > 45").select(nid("drug:", "p_type").alias("id"))).distinct()
    return whatif.Chain(bom(t), roots)


def scenarios(t: Tables) -> DataFrame:
    """A company, a country, a region's countries, all poor companies, an api, a drug and a brand's precursors switched off."""
    named = lambda df, name, off: df.select(F.lit(name).alias("scenario_id"), off.alias("off_id"))
    api = F.concat(F.lit("api:"), "p_brand", F.lit(" "), "p_name")
    return graph.checkpointed(
        t.spark.createDataFrame([("none", None)], "scenario_id string, off_id string")
        .unionByName(named(t.supplier.agg(F.min("s_suppkey").alias("s")), "one", nid("company:", "s")))
        .unionByName(named(t.nation.agg(F.max("n_nationkey").alias("n")), "land", nid("country:n", "n")))
        .unionByName(named(t.nation.filter("n_regionkey = 1"), "lands", nid("country:n", "n_nationkey")))
        .unionByName(named(t.supplier.filter("s_acctbal < 5000"), "poor", nid("company:", "s_suppkey")))
        .unionByName(named(t.part.agg(F.min(api).alias("a")), "api", F.col("a")))
        .unionByName(named(t.part.agg(F.min("p_brand").alias("b")), "root", nid("drug:", "b")))
        .unionByName(named(t.part.filter("p_brand = 'Brand#3'"), "gate", nid("precursor:", "p_partkey")))
    )


@query("q37_cut_set", f"WITH {TREE_SQL} SELECT scenario_id, key, id, kind FROM cut WHERE dead")
def q37(t):
    return chain(t).failed(scenarios(t)).cut_set().select("scenario_id", "key", "id", "kind")


@query("q36_tree_rollup", f"WITH {ROLL_SQL} SELECT * FROM h WHERE health <> 'ok'")
def q36(t):
    return chain(t).failed(scenarios(t)).rollup()


@query("q38_allocate_share", f"""WITH {TREE_SQL}, p AS (SELECT scenario_id, coalesce(iso, 'unknown') AS iso, count(*) AS total, count(*) FILTER (NOT dead) AS up FROM cut WHERE kind = 'supplier' GROUP BY 1, 2)
SELECT scenario_id, iso, total, up, round(coalesce(up / nullif(sum(up) OVER (PARTITION BY scenario_id), 0)::DOUBLE, 0), 6) AS share FROM p""")
def q38(t):
    return chain(t).failed(scenarios(t)).allocate().withColumn("share", r6("share"))


@query("q40_rerank_against_failure", """WITH a AS (SELECT s_nationkey AS node, s_name AS holder, CASE WHEN s_suppkey % 5 = 0 THEN [] WHEN s_suppkey % 5 < 3 THEN ['c' || (s_suppkey % 5)] ELSE ['c1', 'c' || (s_suppkey % 5)] END AS iso2, round(s_acctbal / 1000, 1) AS score, s_acctbal > 0 AS viable, s_suppkey % 6 <> 0 AS standing FROM supplier),
f(scenario_id, isos) AS (VALUES ('a', ['c1']), ('b', ['c2', 'c4'])),
d AS (SELECT *, CASE WHEN len(iso2) = 0 THEN 0.0::DOUBLE WHEN list_has_any(iso2, isos) THEN -2.0 ELSE 2.0 END AS delta FROM a, f),
r AS (SELECT *, CASE WHEN standing THEN row_number() OVER (PARTITION BY scenario_id, node, standing ORDER BY score + delta DESC, score DESC, holder) END AS rank FROM d)
SELECT scenario_id, node, holder, delta, round(score + delta, 6) AS adjusted, rank::INT AS rank, coalesce(rank = 1 AND viable, false) AS best FROM r""")
def q40(t):
    k = F.col("s_suppkey") % 5
    arr = lambda *v: F.array(*v)
    a = t.supplier.select(F.col("s_nationkey").alias("node"), F.col("s_name").alias("holder"), F.when(k == 0, F.array().cast("array<string>")).when(k < 3, arr(F.concat(F.lit("c"), k.cast("string")))).otherwise(arr(F.lit("c1"), F.concat(F.lit("c"), k.cast("string")))).alias("iso2"), F.round(F.col("s_acctbal") / 1000, 1).alias("score"), (F.col("s_acctbal") > 0).alias("viable"), (F.col("s_suppkey") % 6 != 0).alias("standing"))
    f = t.spark.createDataFrame([("a", ["c1"]), ("b", ["c2", "c4"])], "scenario_id string, isos array<string>")
    return whatif.rerank(a, f).select("scenario_id", "node", "holder", "delta", r6("adjusted").alias("adjusted"), "rank", "best")


@query("q52_great_circle_partner", """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS tier, (s_suppkey * 37 % 180 - 90)::DOUBLE AS lat, (s_suppkey * 73 % 360 - 180)::DOUBLE AS lng, s_acctbal / 1000 AS score FROM supplier),
p AS (SELECT a.tier, a.id, b.id AS partner, degrees(2 * asin(least(1, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))) AS deg, b.score AS sc FROM s a JOIN s b ON a.tier = b.tier AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY tier, id ORDER BY sc - deg / 36 DESC, partner) AS rn FROM p) SELECT tier, id, partner, round(deg, 6) AS degrees, round(sc - deg / 36, 6) AS value FROM r WHERE rn = 1""")
def q52(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("tier"), (F.col("s_suppkey") * 37 % 180 - 90).cast("double").alias("lat"), (F.col("s_suppkey") * 73 % 360 - 180).cast("double").alias("lng"), (F.col("s_acctbal") / 1000).alias("score"))
    return whatif.partner(s.drop("score"), s, by=["tier"]).withColumns({"degrees": r6("degrees"), "value": r6("value")})
