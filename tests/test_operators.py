"""Edges of single operators on small rows."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from meshlark.functions import text, values
from meshlark.functions.canonical import canonical_json
from meshlark.operators import audit, fuzzy, graph, merge, order, rules, stats, whatif
from meshlark.operators.graph import checkpointed
from meshlark.sources import readers, sinks, versions
from meshlark.streaming import telemetry as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.slug, "  Zürich & Co. ", "zürich-co"),
        (text.ascii_key, "A--b C", "a-b-c"),
        (text.fei, "000", "0"),
        (text.fei, "FEI 0012", "12"),
        (text.fei, "none", ""),
        (text.fei_or_null, "000", None),
        (text.ndc11, "123-45-6", "00123004506"),
        (text.ndc11, "123456-45-6", None),
        (text.last_iso3, "x (ABC) y (DEF)", "DEF"),
        (text.last_iso3, "nothing", None),
        (text.ending_iso3, "x (ABC) y", None),
        (text.strip_accents, "Ångström São", "Angstrom Sao"),
        (text.generic_key, "Foo Injection, 5 mg; bar", "foo 5 mg"),
        (text.plain_text, "<p>a &amp; b</p>\n<i>c</i>", "a & b c"),
        (text.display_name, "ORVANE LABS GMBH", "Orvane Labs GmbH"),
        (text.display_name, "Orvane LABS", "Orvane LABS"),
        (text.display_name, "ORVANE (CHINA) PVT. LTD, S.P.A/BIO-TECH  3M", "Orvane (China) Pvt. Ltd, S.P.A/Bio-Tech  3m"),
        (text.display_name, "12 34", "12 34"),
        (lambda c: text.balanced_after(c, "the list"), "see the list (a, b (c), d) end", "a, b (c), d"),
        (lambda c: text.balanced_after(c, "the list"), "see the list (a, b", None),
        (lambda c: F.array_join(text.top_level_split(c), "|"), "A, B (x, y), or C (gloss), , D", "A|B|C|D"),
        (lambda c: F.array_join(text.rejoin_suffixes(c), "|"), "Alpha, Inc., Beta, Ltd, Gamma", "Alpha, Inc.|Beta, Ltd|Gamma"),
        (lambda c: F.array_join(text.city_candidates(c, F.lit("h")), "|"), "12 Road, Pine District, Dezhou City, Shandong, China (CHN)", "dezhou|pine|shandong"),
        (lambda c: values.parse_date(c).cast("string"), "2-Jan-24", "2024-01-02"),
        (lambda c: values.parse_date(c).cast("string"), "31/31/2024", None),
        (lambda c: values.number(c), "NaN", None),
        (lambda c: values.excel_date(c).cast("string"), "45292.7", "2024-01-01"),
        (lambda c: text.word_match(c, "oxacillin"), "dicloxacillin, (oxacillin)", True),
        (lambda c: text.word_match(c, "oxacillin"), "dicloxacillin", False),
    ],
)
def test_text_and_values(spark, f, value, want):
    assert one(spark, value, f) == want


def test_wilson_and_arc(spark):
    r = spark.range(1).select(values.wilson(F.lit(0), F.lit(0)).alias("w"), values.arc_degrees(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("a")).first()
    assert (r.w.lo, r.w.hi) == (0.0, 1.0) and abs(r.a - 90) < 1e-9


def test_map_merges(spark):
    d = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": None, "c": "3"})], "o map<string,string>, n map<string,string>")
    r = d.select(values.merge_filled(F.col("o"), F.col("n")).alias("f"), values.merge_present(F.col("o"), F.col("n")).alias("p")).first()
    assert r.f == {"a": "1", "b": "2", "c": "3"} and r.p == {"a": None, "b": "2", "c": "3"}


def test_upsert_is_idempotent_and_keeps(spark):
    schema = "id string, label string, attrs map<string,string>"
    old = spark.createDataFrame([("x", "one", {"a": "1"})], schema)
    new = spark.createDataFrame([("x", None, {"b": "2"}), ("y", "two", None)], schema)
    once = merge.upsert(old, new, ["id"])
    assert sorted(once.collect()) == sorted(merge.upsert(once, new, ["id"]).collect())
    assert {r.id: r.label for r in once.collect()} == {"x": "one", "y": "two"}


def test_validate_flags_each_fault(spark):
    nodes = spark.createDataFrame([("drug:a", "drug", "us"), ("drug:a", "api", "USA"), ("what", "drug", None)], "id string, type string, country string")
    edges = spark.createDataFrame([("drug:a", "drug:z", "feeds", 3, None), ("drug:a", "drug:a", "odd", None, "c")], "src string, dst string, rel string, layer int, citation string")
    got = {(r.severity, r.message) for r in merge.validate(nodes, edges).collect()}
    assert {("error", "id fits no pattern"), ("error", "type does not fit the id"), ("error", "id is not unique"), ("error", "layer 3 without a citation"), ("error", "layer is not 1, 2 or 3"), ("warning", "unknown relation"), ("warning", "dst has no node")} <= got


def test_reach_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "a", "r"), ("b", "c", "s")], "src string, dst string, rel string")
    got = {(r.id, r.depth) for r in graph.reach(e, spark.createDataFrame([("a",)], "seed string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_propagation_keeps_direct_scores(spark):
    e = spark.createDataFrame([("drug", "plant", "produced_by"), ("drug", "pack", "marketed_as"), ("drug", "low", "feeds")], "src string, dst string, rel string")
    s = spark.createDataFrame([("plant", 0.9), ("low", 0.1)], "node_id string, p12 double")
    n = spark.createDataFrame([(x,) for x in ("drug", "plant", "pack", "low")], "id string")
    got = {r.node_id: (r.p12, r.attribution) for r in graph.propagate_max(e, s, n).collect()}
    assert got == {"plant": (0.9, "direct"), "low": (0.1, "direct"), "drug": (0.9, "inherited"), "pack": (0.9, "molecule")}


def test_red_needs_more_than_the_bound(spark):
    sig = spark.createDataFrame([(1, "a", "recall", "high", "2024-01-01"), (2, "b", "recall", "high", "2024-01-01"), (3, "c", "recall", "low", "2024-01-01"), (4, "d", "shortage", "low", "2023-01-01"), (5, "e", "recall", "high", "2023-10-03"), (6, "f", "recall", "high", "2023-10-02")], "event_id int, node_id string, kind string, severity string, d string")
    sig = sig.select("event_id", "node_id", "kind", "severity", F.col("d").cast("timestamp").alias("observed_at"), F.lit(None).cast("string").alias("classification"), F.lit("Current").alias("status"))
    shares = spark.createDataFrame([("a", 0.75), ("b", 0.76), ("c", 0.9), ("d", 0.9), ("e", 0.9), ("f", 0.9), ("g", None)], "node_id string, share double")
    got = {r.node_id: r.red for r in rules.red_verdict(sig, shares, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True, "e": True, "f": False, "g": False}


def test_later_clean_state_clears(spark):
    sig = spark.createDataFrame([(1, "a", "inspection_classification", "OAI", "2023-01-01"), (2, "a", "inspection_classification", "NAI", "2023-06-01")], "event_id int, node_id string, kind string, classification string, d string")
    sig = sig.select("*", F.lit("high").alias("severity"), F.col("d").cast("timestamp").alias("observed_at"), F.lit(None).cast("string").alias("status")).drop("d")
    shares = spark.createDataFrame([("a", 0.9)], "node_id string, share double")
    assert rules.red_verdict(sig, shares, F.lit("2024-01-01").cast("date")).first().red is False


def test_upper_median_and_auc(spark):
    d = spark.createDataFrame([("x", float(v)) for v in (4, 1, 3, 2)] + [("y", 1.0)], "g string, v double")
    assert [tuple(r) for r in stats.upper_median(d, "g", "v").collect()] == [("x", 4, 3.0)]
    s = spark.createDataFrame([(1, 0.1, 0), (2, 0.5, 1), (3, 0.5, 0), (4, 0.9, 1)], "id int, s double, y int")
    assert stats.auc(s, "s", "y").first().auc == 0.875
    assert stats.auc(s.withColumn("y", F.lit(1)), "s", "y").first().auc is None
    flipped = stats.auc(s.withColumn("y", 1 - F.col("y")), "s", "y").first().auc
    assert flipped == 1 - 0.875


def test_pava_is_monotone_and_interpolates(spark):
    d = spark.range(130).select("id", (F.col("id") / 130).alias("s"), (F.pmod(F.xxhash64("id"), F.lit(10)) < F.col("id") / 13).cast("int").alias("y"))
    curve = stats.pava(d, "s", "y", "id", 10)
    ps = [r.p for r in curve.orderBy("at").collect()]
    assert ps == sorted(ps)
    out = stats.apply_curve(d.withColumn("s", F.col("s") * 2 - 0.5), curve, "s").collect()
    assert all(r.lo <= r.p + 1e-9 and r.p <= r.hi + 1e-9 for r in out)


def test_rows_between_points(spark):
    """Against a scan of all points: ties, a score that a third of all rows share, nulls, scores outside, no points, no rows."""
    points = [(x / 7, x) for x in range(0, 60, 3)]
    scores = [None, None, -1.0, 99.0] + [30 / 7] * 40 + [x / 11 for x in range(90)]
    rows = spark.createDataFrame(list(enumerate(scores)), "id int, s double")
    pts = spark.createDataFrame(points, "at double, p int").repartition(3)
    got = {r.id: (r.before and r.before.p, r.after and r.after.p) for r in order.bracketed(rows, "s", pts, "at").collect()}
    below = lambda s: max(((a, p) for a, p in points if a <= s), default=(0, None))[1]
    above = lambda s: min(((a, p) for a, p in points if a > s), default=(0, None))[1]
    assert got == {i: (None, None) if s is None else (below(s), above(s)) for i, s in enumerate(scores)}
    assert {(r.before, r.after) for r in order.bracketed(rows, "s", pts.limit(0), "at").collect()} == {(None, None)}
    assert order.bracketed(rows.limit(0), "s", pts, "at").count() == 0


def test_curve_bounds(spark):
    """p, lo and hi between, on and outside the points; a null score has none."""
    curve = spark.createDataFrame([(0.1, 0.05, 400), (0.4, 0.2, 300), (0.8, 0.6, 100)], "at double, p double, n long")
    rows = spark.createDataFrame([(1, 0.0), (2, 0.1), (3, 0.25), (4, 0.8), (5, 2.0), (6, None)], "id int, s double")
    out = {r.id: r for r in stats.apply_curve(rows, curve, "s").collect()}
    assert [out[i].p for i in (1, 2, 4, 5)] == [0.05, 0.05, 0.6, 0.6] and abs(out[3].p - 0.125) < 1e-9 and out[6].p is None
    ends = [out[2], out[4]]
    assert all(r.lo < r.p < r.hi for r in ends) and abs(out[3].lo - (out[2].lo + curve.select(values.wilson(F.lit(60), F.lit(300)).alias("w")).first().w.lo) / 2) < 1e-9
    assert [out[i].at_ceiling for i in (1, 3, 4, 5)] == [False, False, True, True]


def test_monotone_over_ranges(spark):
    d = spark.range(500).withColumn("v", F.col("id") * 0.5)
    assert stats.monotone(d, "id", "v").first().monotone
    assert stats.monotone(d.withColumn("v", F.when(F.col("id") == 250, F.col("v") - 0.503).otherwise(F.col("v"))), "id", "v").first().monotone
    for place in (1, 125, 250, 499):
        assert not stats.monotone(d.withColumn("v", F.when(F.col("id") == place, F.col("v") - 0.6).otherwise(F.col("v"))), "id", "v").first().monotone


def test_pava_by_chunks(spark):
    """Chunks of any width give the curve of one chunk, also where all rates fall."""
    d = spark.range(300).select("id", (F.col("id") / 300).alias("s"), (F.pmod(F.xxhash64("id"), F.lit(7)) < 3).cast("int").alias("y"))
    falling = d.withColumn("y", (F.col("id") < 150).cast("int"))
    for x in (d, falling):
        one, few = (sorted(tuple(r) for r in stats.pava(x, "s", "y", "id", 5, w).collect()) for w in (4096, 2))
        assert [r[1:] for r in one] == [r[1:] for r in few]
        assert all(abs(a[0] - b[0]) < 1e-12 for a, b in zip(one, few, strict=True))
    assert stats.pava(d.filter("id < 0"), "s", "y", "id", 5).count() == 0


def test_word_sets_are_the_distinct_tokens(spark):
    texts = ["Ångström São-Paulo a\u0301b c\u0301", "plain PLAIN 12-b\ttab\nline", None, "", "\u212aelvin İstanbul ΣΑΣ straße x東京y", "\u0301 \u0301e!É\u00a0É", "naïve naive NAÏVE _under_score", "ﬁne ½ ² x²y", "a\x7fb\x00c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    plain = {r.id: r.w and sorted(r.w) for r in df.select("id", F.array_distinct(text.tokens(F.col("t"), ())).alias("w")).collect()}
    assert {r.id: r.w and sorted(r.w) for r in text.word_sets(df, "id", "t", "w").collect()} == plain


def test_low_jaccard_counts_all_tokens_once(spark, monkeypatch):
    """Below LOW no token is ordered and no pair counted again; the pairs are those of a plain scan, at either side of it."""
    sets = {i: {f"w{k * k % (7 + i % 11)}" for k in range(1 + i % 9)} | {f"u{i}{k}" for k in range(i % 13)} for i in range(40)}
    left = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "l long, t array<string>")
    right = left.filter("l % 4 = 0").select(F.col("l").alias("r"), "t")
    share = lambda a, b: len(a & b) / len(a | b)

    def best(least):
        found = {i: min((-share(s, sets[j]), j) for j in sets if j % 4 == 0) for i, s in sets.items()}
        return {i: (j, round(-x, 9)) for i, (x, j) in found.items() if -x >= least}

    got = lambda least, **more: {r.l: (r.r, round(r.score, 9)) for r in fuzzy.token_block_join(left, right, "l", "r", "t", "t", least, **more).collect()}
    assert got(0.3) == best(0.3)
    monkeypatch.setattr(fuzzy, "ordered_sets", None)
    assert got(0.1) == got(0.1, distinct=True) == best(0.1)


def test_blocked_pairs_by_size(spark):
    """The bound on sizes drops no pair that reaches the score, sets of exactly that ratio included."""
    sets = [(i, [f"t{(i * k) % 9}" for k in range(1, i % 10 + 1)]) for i in range(30)]
    d = spark.createDataFrame(sets, "l int, tl array<string>")
    e = d.select(F.col("l").alias("r"), F.col("tl").alias("tr"))
    got = {(r.l, r.r) for r in fuzzy.search(d, e, "l", "r", "tl", "tr", 0.5, 100).collect()}
    assert got == {(a, b) for a, x in sets for b, y in sets if set(x) & set(y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5}


def test_running_sums_in_a_global_order(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 5 < 4 else f"g{i % 3}", (i * 37) % 11, i % 4) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, g string, v int, w int")
    for by in ((), ("g",)):
        got = {r.id: (r.rank, r.sum) for r in order.before(d, [F.desc("v"), "id"], {"rank": F.lit(1), "sum": F.col("w")}, by).collect()}
        assert len(got) == 200
        for i, g, v, _ in rows:
            ahead = [r for r in rows if (not by or r[1] == g) and (-r[2], r[0]) < (-v, i)]
            assert got[i] == (len(ahead), sum(r[3] for r in ahead))
    assert order.before(d.filter("id < 0"), ["id"], {"rank": F.lit(1)}).count() == 0
    assert {(r.g, r.n) for r in order.counted(d, "n", ["g"]).collect()} == {(g, sum(r[1] == g for r in rows)) for g in {r[1] for r in rows}}


def test_rows_against_a_stated_set(spark):
    rows, queries = spark.range(20), spark.range(7).withColumnRenamed("id", "q")
    want = {(i, q) for i in range(20) for q in range(7)}
    for block in (256, 2):
        got = [tuple(r) for r in order.against(rows, queries, block, 3).collect()]
        assert len(got) == len(want) and set(got) == want
    assert order.against(rows, queries.filter("q < 0")).count() == 0


BOM = [
    ("api:a", "active_in", "drug:x"), ("api:b", "active_in", "drug:x"), ("api:c", "active_in", "drug:y"), ("api:d", "active_in", "drug:y"),
    ("precursor:k", "feeds", "api:a"), ("precursor:m", "feeds", "api:a"), ("precursor:k", "feeds", "api:c"), ("precursor:n", "feeds", "api:d"), ("precursor:m", "feeds", "api:d"),
    ("api:a", "produced_by", "s1"), ("api:a", "produced_by", "s2"), ("api:b", "produced_by", "s3"), ("api:c", "produced_by", "s1"), ("api:c", "produced_by", "s4"),
    ("precursor:k", "produced_by", "s5"), ("precursor:m", "produced_by", "s5"), ("precursor:m", "produced_by", "s1"),
    ("s1", "incorporated_in", "country:aa"), ("s2", "incorporated_in", "country:bb"), ("s3", "incorporated_in", "country:aa"), ("s5", "incorporated_in", "country:cc"),
]
SCENARIOS = [("none", None), ("one", "s1"), ("land", "country:aa"), ("gate", "s5"), ("both", "s5"), ("both", "s1"), ("api", "api:a"), ("root", "drug:y"), ("twice", "s1"), ("twice", "s1"), ("twice", "country:aa"), ("pre", "precursor:n"), ("unknown", "nobody")]


def whole_rollup(tree, off):
    """{key: (dead, total, up)} by walking the tree from its roots."""
    below = {}
    for r in tree:
        below.setdefault(r["parent_key"], []).append(r)
    own = lambda r: r["id"] in off or (r["iso"] is not None and "country:" + r["iso"] in off)
    out = {}

    def walk(r, under):
        children = below.get(r["key"], [])
        dead = own(r) or under
        sources, items = [c for c in children if c["kind"] == "supplier"], [c for c in children if c["kind"] != "supplier"]
        idle = lambda p: own(p) or bool(below.get(p["key"])) and all(own(c) for c in below[p["key"]])
        gated = r["kind"] == "api" and bool(items) and all(idle(p) for p in items)
        for c in sources:
            walk(c, dead or gated)
        for c in items:
            walk(c, dead)
        pool = [out[c["key"]] for c in sources or items]
        total = sum(x[1] for x in pool) if pool else 1
        up = 0 if dead else sum(x[2] for x in pool) if pool else 1
        out[r["key"]] = (dead, total, up)

    for r in below[None]:
        walk(r, False)
    return out


def test_whatif_by_difference(spark):
    """Dead rows, changed rows, all drugs and the allocation equal a walk over the whole tree in each scenario."""
    e = spark.createDataFrame(BOM, "src string, rel string, dst string")
    tree = whatif.build_tree(e, spark.createDataFrame([("drug:x",), ("drug:y",)], "id string"))
    off = spark.createDataFrame(SCENARIOS, "scenario_id string, off_id string")
    rows = [r.asDict() for r in tree.collect()]
    base, cut = whatif.all_up(tree), whatif.cut_set(tree, off)
    changed = whatif.rollup(base, cut)
    dead, lost = [tuple(r) for r in cut.select("scenario_id", "key").collect()], {(r.scenario_id, r.key): (r.total, r.up) for r in changed.collect()}
    drugs = {(r.scenario_id, r.drug): (r.total, r.up, r.health) for r in whatif.chain_health(whatif.overlaid(base.filter("kind = 'drug'"), changed, off)).collect()}
    shares = {(r.scenario_id, r.iso): (r.total, r.up) for r in whatif.allocate(base, cut, off).collect()}
    names = {s for s, _ in SCENARIOS}
    want = {s: whole_rollup(rows, {o for n, o in SCENARIOS if n == s and o}) for s in names}
    assert sorted(dead) == sorted((s, k) for s in names for k, v in want[s].items() if v[0])
    assert lost == {(s, k): v[1:] for s in names for k, v in want[s].items() if v[2] < v[1]}
    assert {k: v[:2] for k, v in drugs.items()} == {(s, d): want[s][d][1:] for s in names for d in ("drug:x", "drug:y")}
    assert drugs[("none", "drug:x")][2] == "ok" and drugs[("one", "drug:x")][2] == "at-risk" and drugs[("root", "drug:y")][2] == "down"
    for s in names:
        sources = [(r["iso"] or "unknown", want[s][r["key"]][0]) for r in rows if r["kind"] == "supplier"]
        for iso in {i for i, _ in sources}:
            here = [gone for i, gone in sources if i == iso]
            assert shares[(s, iso)] == (len(here), here.count(False))
    assert whatif.cut_set(tree, off.filter("off_id IS NULL")).count() == 0 and whatif.rollup(base.limit(0), cut.limit(0)).count() == 0


def test_marks_behind_and_blast_radius(spark, monkeypatch):
    """Against closures by walking, with cycles, a self loop, a hub, repeated edges, shared and null marks, and small blocks."""
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "d"), ("d", "f"), ("d", "f"), ("g", "h"), *[("a", f"x{i}") for i in range(40)], *[(f"x{i}", "y") for i in range(0, 40, 3)]]
    e = spark.createDataFrame([(s, t, "feeds") for s, t in links], "src string, dst string, rel string")

    def reached(start):
        seen, todo = {start}, [start]
        while todo:
            at = todo.pop()
            new = {t for s, t in links if s == at} - seen
            seen |= new
            todo += new
        return seen

    nodes = {n for x in links for n in x}
    assert {r.id: r.reached for r in graph.blast_radius(e).collect()} == {n: len(reached(n)) - 1 for n in nodes}
    fei = {"a": "1", "e": "1", "d": "2", "x3": "3", "g": None, "x6": "4"}
    made = spark.createDataFrame([*fei.items(), ("e", "5"), ("e", "5")], "id string, fei string")
    behind = {n: {f for p, f in [*fei.items(), ("e", "5")] if f and n in reached(p)} for n in nodes}
    want = {n: len(f) for n, f in behind.items() if f}
    assert {r.id: r.plants for r in graph.upstream_sets(e, made).collect()} == want
    monkeypatch.setattr(graph, "BITS", 2)
    assert {r.id: r.plants for r in graph.upstream_sets(e, made).collect()} == want
    assert graph.upstream_sets(e, made.limit(0)).count() == 0 and graph.upstream_sets(e.limit(0), made.filter("id = 'd'")).collect() == [("d", 1)]


def test_sets_of_few_marks_are_lists(spark, monkeypatch):
    """Few marks make no bitmap; many do, alone and beside lists, within a cycle, at a node that sends on and at one that does not."""
    links = [*[(f"a{i:02}", "b") for i in range(12)], ("b", "c"), ("c", "d"), ("d", "b"), ("c", "z"), ("e", "d"), ("e", "y"), *[(f"a{i:02}", "y") for i in range(0, 12, 5)], ("f", "x")]
    e = spark.createDataFrame([(s, t, "feeds") for s, t in links], "src string, dst string, rel string")
    marks = spark.createDataFrame([(n, n) for n in {s for s, _ in links}], "id string, mark string")

    def behind(node):
        seen, todo = {node}, [node]
        while todo:
            at = todo.pop()
            new = {s for s, t in links if t == at} - seen
            seen |= new
            todo += new
        return len(seen & {s for s, _ in links})

    want, made, build = {n: behind(n) for x in links for n in x}, [], graph.bitmaps
    monkeypatch.setattr(graph, "bitmaps", lambda rows: made.append(1) or build(rows))
    assert {r.id: r.n for r in graph.marks_behind(e, marks).collect()} == want and not made
    for name, n in (("MANY", 5), ("RANGE", 8), ("BITS", 4)):
        monkeypatch.setattr(graph, name, n)
    assert {r.id: r.n for r in graph.marks_behind(e, marks).collect()} == want and made
    assert [r.number for r in graph.numbered(marks).orderBy("mark").collect()] == list(range(marks.count()))


def test_blast_radius_of_few_nodes_makes_no_bitmap(spark, monkeypatch):
    monkeypatch.setattr(graph, "bitmaps", None)
    e = spark.createDataFrame([("r", "n", "hosts"), ("n", "s", "hosts"), ("p", "s", "produced_by"), ("p", "o", "feeds"), ("p", "q", "feeds"), ("t", "n", "hosts")], "src string, dst string, rel string")
    assert {r.id: r.reached for r in graph.blast_radius(e).collect()} == {"r": 5, "t": 5, "n": 4, "s": 3, "p": 2, "o": 0, "q": 0}


def test_blast_radius_keeps_no_set_of_last_nodes(spark, monkeypatch):
    """Sets are kept for nodes that send on alone, whatever hangs below them; last nodes go in passes, as lists or as bitmaps."""
    links = [("r", "n"), ("n", "s"), ("n", "t"), ("s", "p"), ("t", "p"), ("t", "q"), ("q", "t"), *[(k, f"{k}{i:02}") for k in "pq" for i in range(30)], *[("q", f"p{i:02}") for i in range(0, 30, 7)]]
    e = spark.createDataFrame([(s, t, "feeds") for s, t in links], "src string, dst string, rel string")

    def reached(start):
        seen, todo = {start}, [start]
        while todo:
            at = todo.pop()
            new = {t for s, t in links if s == at} - seen
            seen |= new
            todo += new
        return len(seen) - 1

    want, written, sent = {n: reached(n) for x in links for n in x}, [], []
    add, along = graph.Grown.add, graph.Edges.along

    def seen_add(self, part):
        out = add(self, part)
        written.append(out.agg(F.sum(F.size("marks"))).first()[0] or 0 if "marks" in out.columns else 0)
        return out

    monkeypatch.setattr(graph.Grown, "add", seen_add)
    monkeypatch.setattr(graph.Edges, "along", lambda self, rows, *only: sent.append(only) or along(self, rows, *only))
    assert {r.id: r.reached for r in graph.blast_radius(e).collect()} == want
    assert sum(written) <= 6 * 6  # of the six nodes that send on
    assert sum(len(only) for only in sent) == 1
    for name, n in (("LEAST", 1), ("PER_EDGE", 2)):
        monkeypatch.setattr(graph, name, n)
    sent.clear()
    assert {r.id: r.reached for r in graph.blast_radius(e).collect()} == want and sum(len(only) for only in sent) > 1
    for name, n in (("MANY", 4), ("RANGE", 4), ("BITS", 2)):
        monkeypatch.setattr(graph, name, n)
    assert {r.id: r.reached for r in graph.blast_radius(e).collect()} == want


def test_redacted_at_any_depth(spark):
    deep = "[" * 100000 + "]" * 100000
    cases = {
        '{"a": {"Api_Key": {"x": 1}, "b": [{"my-TOKEN": [1]}, "secret"]}, "é": "token"}': '{"a":{"Api_Key":"[redacted]","b":[{"my-TOKEN":"[redacted]"},"secret"]},"é":"token"}',
        '[]': '[]', 'null': 'null', '{"k": 1.5}': '{"k":1.5}', '': '"[redacted]"', '{"password": "x"': '"[redacted]"', deep: '"[redacted]"',
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "j string")
    assert {r.j: r.r for r in rows.select("j", text.redact_json("j").alias("r")).collect()} == cases | {None: None}


def test_audit_detects(spark):
    rows = spark.createDataFrame([(i, str(i), "r", "me", "step", f"p{i}") for i in range(6)], "o int, ts string, run_id string, actor string, kind string, payload string")
    log = audit.chain_append(rows, ["o"])
    assert audit.chain_verify(log).first().finding == "intact"
    assert audit.chain_verify(log.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload")))).first().finding == "modified"
    gone = audit.chain_verify(log.filter("seq <> 2")).first()
    assert gone.finding == "removed, reordered, or inserted" and gone.line == 3


PAYLOADS = [
    {"s": 'a "b" \\ \n\t\x01\x7f é 😀', "n": {"z": 1, "b": None}, "l": [True, None], "x": 1e7},
    {"s": "", "n": {}, "l": [], "x": 12345678.9},
    {"s": None, "n": None, "l": None, "x": -1.5e-4},
    {"s": "plain \" text", "n": {"é": 2, "Z": 3}, "l": [False], "x": 2.5e-7},
    {"s": "t", "n": {"a": 0}, "l": [None], "x": 1e16},
    {"s": "u", "n": {"a": 0}, "l": [None], "x": -1e22},
    {"s": "v", "n": {"a": 0}, "l": [None], "x": 0.001},
    {"s": "w", "n": {"a": 0}, "l": [None], "x": 1e15},
    {"s": "w", "n": {"a": 0}, "l": [None], "x": 0.0},
]
PAYLOAD_TYPE = "struct<x:double,s:string,n:map<string,int>,l:array<boolean>>"


def test_canonical_json(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(PAYLOADS)], f"i int, p {PAYLOAD_TYPE}")
    got = rows.select("i", canonical_json(F.col("p"), rows.schema["p"].dataType).alias("j")).orderBy("i").collect()
    assert [r.j for r in got] == [json.dumps(p, sort_keys=True, separators=(",", ":")) for p in PAYLOADS]


def test_audit_of_nested_payloads(spark):
    rows = spark.createDataFrame([(i, str(i), "r", "mé", "step", p) for i, p in enumerate(PAYLOADS)], f"o int, ts string, run_id string, actor string, kind string, payload {PAYLOAD_TYPE}")
    log = audit.chain_append(rows, ["o"])
    prev = audit.GENESIS
    for i, r in enumerate(log.orderBy("seq").collect()):
        text = json.dumps({"seq": i, "ts": str(i), "run_id": "r", "actor": "mé", "kind": "step", "payload": PAYLOADS[i]}, sort_keys=True, separators=(",", ":"))
        assert r.prev_hash == prev and r.hash == hashlib.sha256((prev + text).encode()).hexdigest()
        prev = r.hash
    assert audit.chain_verify(log).first().finding == "intact"


def test_every_entity(spark):
    assert one(spark, "<b>a&eacute;&nbsp;&hellip;</b> &#x41;&amp;lt;", lambda c: text.plain_text(c, every_entity=True)) == "aé … A&lt;"
    assert one(spark, None, lambda c: text.plain_text(c, every_entity=True)) is None


def test_compare_and_ties(spark):
    scored = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.84), ("b", 1, 0.9), ("b", 2, 0.86)], "l string, r int, score double")
    assert {x.l: x.outcome for x in fuzzy.refuse_ties(scored, "l", "r").collect()} == {"a": "matched", "b": "refused"}


def test_latch_needs_an_hour(spark):
    short = [(i, "k", i * 60, 60.0) for i in range(30)]
    d = spark.createDataFrame(short, "event_id int, k string, s int, temp double").withColumn("ts", F.timestamp_seconds("s"))
    got = T.latch(T.sliding_mkt(d, "k", "ts", "temp"), "k", "ts", F.lit(25.0))
    assert not any(r.latched for r in got.collect())


def test_status_orders_differ(spark):
    d = spark.createDataFrame([("a", True)], "k string, latched boolean").select("*", F.timestamp_seconds(F.lit(0)).alias("last_ts"), F.lit(None).cast("string").alias("fault"), F.lit(False).alias("excursion"))
    now = F.timestamp_seconds(F.lit(100))
    assert T.status_asof(d, now).first().status == "stale" and T.status_asof(d, now, precedence="contract").first().status == "mkt_breach"


def test_spreadsheet_and_archive(spark, tmp_path):
    book = tmp_path / "b.xlsx"
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    assert [r.cells for r in readers.xlsx(spark, str(book)).orderBy("row").collect()] == [["name", "", "5"], ["", "in"]]
    arch = tmp_path / "a.zip"
    with zipfile.ZipFile(arch, "w") as z:
        z.writestr("REG.txt", " fei\tname \t\n 1 \t x y\t\n2\t z \t\n")
    got = readers.from_fields(readers.zipped_table(spark, str(arch), member="REG"), ["fei", "name"])
    assert sorted(map(tuple, got.collect())) == [("1", "x y"), ("2", "z")]


def test_readers_of_text(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"a": 1}, {"a": 2}]}))
    assert readers.json_results(spark, str(tmp_path / "p.json"), "a: int").count() == 2
    assert readers.empty_or(spark, str(tmp_path / "none.json"), "a int").count() == 0
    lines = spark.createDataFrame([("# hi",), ('{"a": 3}',), ("junk",)], "value string")
    assert [r.a for r in readers.ndjson_serial(lines, "a int").collect()] == [3]
    (tmp_path / "x.xml").write_text("<D><P>one\n two</P><X>no</X><FP c='1'>three</FP></D>")
    assert [r.text for r in readers.xml_paragraphs(spark, str(tmp_path / "x.xml")).orderBy("pos").collect()] == ["one two", "three"]
    doc = spark.createDataFrame([("d", 1, "CAT one"), ("d", 2, "alpha"), ("d", 3, "beta END"), ("d", 4, "half"), ("d", 5, "CAT two"), ("d", 6, "gamma END")], "doc string, pos int, text string")
    assert sorted((r.category, r.row) for r in readers.carried_rows(doc, "^CAT", "END$").collect()) == [("CAT one", "alpha beta END"), ("CAT two", "gamma END")]


def test_publish_refuses_errors(spark, tmp_path):
    path = str(tmp_path / "t")
    ok = spark.createDataFrame([("warning",)], "severity string")
    assert versions.read_table(spark, path) is None
    assert sinks.publish(spark.range(3), path, ok)
    assert not sinks.publish(spark.range(9), path, spark.createDataFrame([("error",)], "severity string"))
    assert versions.read_table(spark, path).count() == 3
    with pytest.raises(ValueError):
        sinks.require(spark.range(2), 3)


def test_publish_is_whole_wherever_it_stops(spark, tmp_path, monkeypatch):
    """A failure before, during and after the write of the part, or within the pointer, leaves the old table for readers."""
    path = str(tmp_path / "t")
    sinks.publish(spark.range(3), path)
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.publish(bad, path)
    assert versions.read_table(spark, path).count() == 3
    with monkeypatch.context() as m:
        m.setattr(versions, "point", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.publish(spark.range(7), path)
    assert versions.read_table(spark, path).count() == 3
    (tmp_path / "t" / "_pointers" / f"{2:012d}").write_text('{"parts": [')  # a pointer that was cut off
    assert versions.read_table(spark, path).count() == 3
    assert sinks.publish(spark.range(7), path) and versions.read_table(spark, path).count() == 7
    assert versions.clear_old(spark, path) == 5 and versions.read_table(spark, path).count() == 7  # 3 parts, 2 pointers


def test_view_of_parts(spark, tmp_path):
    """Small batches beside a large view write parts of their own size; a batch that comes again changes nothing."""
    from meshlark.operators import views

    schema, want = "k long, at int, v long", {}
    folder = str(tmp_path / "view")

    def feed(batch: int, keys) -> None:
        rows = [(k, batch, k * 100 + batch) for k in keys]
        want.update({k: v for k, _, v in rows})
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
        src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        views.keep_view(src, folder, f"{tmp_path}/stream", "k", ["at"]).awaitTermination()

    for batch, keys in enumerate([range(400), range(5), range(3, 9), range(1000, 1002), range(200)]):
        feed(batch, keys)
        state = versions.newest(spark, folder)
        assert [p["rows"] for p in state["parts"]] == [[400], [400, 5], [400, 9], [400, 9, 2], [402]][batch]
        assert {r.k: r.v for r in views.read_view(spark, folder).collect()} == want
    state = versions.newest(spark, folder)
    versions.point(spark, folder, state | {"batch": 99})
    feed(7, [1])  # numbered below 99: taken as done before
    assert versions.newest(spark, folder)["batch"] == 99


def test_views(spark, tmp_path):
    from meshlark.operators import views

    rows = [(1, "x", 1), (2, "y", 1), (1, "z", 2), (3, "w", 1)]
    d = spark.createDataFrame(rows, "k int, v string, at int")
    d.filter("at = 1").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    read = lambda: spark.readStream.schema(d.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    views.keep_view(read(), f"{tmp_path}/view", f"{tmp_path}/stream", "k", ["at"]).awaitTermination()
    assert {(r.k, r.v) for r in views.read_view(spark, f"{tmp_path}/view").collect()} == {(1, "x"), (2, "y"), (3, "w")}
    d.filter("at = 2").write.parquet(f"{tmp_path}/in/b")
    views.keep_view(read(), f"{tmp_path}/view", f"{tmp_path}/stream", "k", ["at"]).awaitTermination()
    assert {(r.k, r.v) for r in views.read_view(spark, f"{tmp_path}/view").collect()} == {(1, "z"), (2, "y"), (3, "w")}
    with pytest.raises(ValueError):
        views.curated_edges(spark.createDataFrame([("a", "feeds", ["b"], " ")], "src string, rel string, dsts array<string>, citation string"))
    back = sinks.csv_cache(d, f"{tmp_path}/csv")
    assert sorted(back.collect()) == sorted(d.collect())
    s = one(spark, "A b (and its subsidiaries: C, D (x))", lambda c: views.trailing_clause(c, "subsidiar"))
    assert (s.name, s.clause) == ("A b", "C, D (x)")


def test_paged_source_and_its_cache(spark, tmp_path):
    """Pages come from the cache folder where they are, without a call."""
    import hashlib

    url = "http://nowhere.invalid/api/drug/ndc.json"
    for limit, skip, got in ((1, 0, {"meta": {"results": {"total": 3}}}), (2, 0, {"results": [{"a": 1}, {"a": {"b": 2}}]}), (1, 2, {"results": [{"c": 1}]})):
        mark = hashlib.sha256(json.dumps({"url": url, "limit": limit, "skip": skip}, sort_keys=True).encode()).hexdigest()[:16]
        (tmp_path / f"{mark}.json").write_text(json.dumps(got))
    t = readers.endpoint(spark, "http://nowhere.invalid/api/", "ndc", "a string", pagesize=2, cache=str(tmp_path), pause=0)
    assert sorted(str(r.a) for r in t.collect()) == ["1", "None", '{"b": 2}']


def test_prefix_join_finds_every_similar_pair(spark):
    """Candidates by rare tokens against all pairs, at several thresholds, with a token that every row holds."""
    import random

    rng = random.Random(9)
    sets = [(i, ["common", *rng.sample([f"w{j}" for j in range(12)], rng.randrange(0, 7))]) for i in range(60)] + [(60, []), (61, ["common"]), (62, ["common"])]
    d = spark.createDataFrame(sets, "l int, t array<string>")
    e = d.withColumnRenamed("l", "r")
    whole = {(a, b): len(set(s) & set(t)) for a, s in sets for b, t in sets}
    for share in (0.1, 0.5, 0.8, 1.0):
        got = {(r.l, r.r): (r.shared, r.size_l, r.size_r) for r in fuzzy.blocked_pairs(d, e, "l", "r", "t", "t", share).collect()}
        for (a, s), (b, t) in ((x, y) for x in sets for y in sets):
            n = whole[a, b]
            if n and n / len(set(s) | set(t)) >= share:
                assert got[a, b] == (n, len(set(s)), len(set(t)))
        x, y = fuzzy.ordered_sets((d, "l", "t"), (e, "r", "t"))
        found = {(r.l, r.r) for r in fuzzy.containing(x, y, "l", "r", share).collect()}
        assert {(a, b) for (a, s) in sets for (b, t) in sets if whole[a, b] and whole[a, b] / min(len(s), len(t)) >= share} <= found


def test_a_token_of_every_row_brings_no_pairs(spark):
    """Names that share one word only: the word is the last in the order, so hardly a pair is formed."""
    d = spark.range(400).select(F.col("id").alias("l"), F.array(F.lit("labs"), F.concat(F.lit("a"), F.col("id").cast("string")), F.concat(F.lit("b"), F.col("id").cast("string"))).alias("t"))
    x, y = fuzzy.ordered_sets((d, "l", "t"), (d.withColumnRenamed("l", "r"), "r", "t"))
    assert fuzzy.candidates(x, y, "l", "r", 0.5).count() == 400 == fuzzy.containing(x, y, "l", "r", 0.667).count()


@pytest.mark.parametrize("scaler", ["train", "all"])
def test_all_folds_at_once_equal_plain_fits(spark, scaler):
    """Coefficients of every fold against numpy, one fold at a time; the scaler of the training rows or of all."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2)) * [1, 50] + [3, -7]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 3 + 0.03 * x[:, 1])))).astype(int)
    d = spark.createDataFrame([(i, float(a), float(b), 1.0, int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, same double, y int")
    fold = {r.id: r.fold for r in stats.kfold(d, "id").collect()}
    got = {r.id: r.oof for r in stats.out_of_fold(d, "id", ["a", "b", "same"], "y", scaler=scaler).collect()}
    full, folds = np.column_stack([x, np.ones(600)]), np.array([fold[i] for i in range(600)])
    for f in range(5):
        train = folds != f
        base = full if scaler == "all" else full[train]
        mu, sd = base.mean(0), np.where(base.std(0) == 0, 1, base.std(0))
        z = np.column_stack([np.ones(600), (full - mu) / sd])
        w = np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-z[train] @ w))
            w -= np.linalg.solve((z[train] * (p * (1 - p))[:, None]).T @ z[train] + np.diag([1e-9, 10, 10, 10]), z[train].T @ (p - y[train]) + np.array([0, 10, 10, 10]) * w)
        want = 1 / (1 + np.exp(-z @ w))
        assert all(abs(got[i] - want[i]) < 1e-7 for i in range(600) if fold[i] == f)


def test_long_chain_is_folded_and_checked(spark):
    """A chain of a million rows: one pass that holds its head alone, checked in ranges, resumed from the stored log."""
    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select("id", *[F.lit(c).alias(c) for c in ("ts", "run_id", "actor", "kind")], F.col("id").cast("string").alias("payload"))
    log = checkpointed(audit.chain_append(rows, ["id"]))
    assert log.count() == n
    got = audit.chain_verify(log).first()
    assert (got.ok, got.finding, got.rows) == (True, "intact", n)
    last = log.filter(F.col("seq") == n - 1).first()
    more = audit.chain_append(rows.filter("id < 3"), ["id"], log=log).orderBy("seq").collect()
    assert [r.seq for r in more] == [n, n + 1, n + 2] and more[0].prev_hash == last.hash == got.head
    bad = log.withColumn("hash", F.when(F.col("seq") == 700_000, "x").otherwise(F.col("hash")))
    found = audit.chain_verify(bad)
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
    assert (found.first().finding, found.first().line) == ("modified", 700_000)


def test_chains_over_many_ranges(spark):
    """Chains that span ranges, and one that lacks a row where a range begins."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(900).select((F.col("id") % 3).alias("run"), "id", *[F.lit(c).alias(c) for c in ("ts", "run_id", "actor", "kind")], F.struct("id").alias("payload"))
        log = checkpointed(audit.chain_append(rows, ["id"], by="run"))
        assert {(r.run, r.ok, r.rows) for r in audit.chain_verify(log, "run").collect()} == {(i, True, 300) for i in range(3)}
        for gone in (0, 100, 170):
            got = {r.run: (r.finding, r.line) for r in audit.chain_verify(log.filter((F.col("run") != 1) | (F.col("seq") != gone)), "run").collect()}
            assert got == {0: ("intact", None), 2: ("intact", None), 1: ("removed, reordered, or inserted", gone + 1)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shared_code_goes_to_the_smallest_generic(spark):
    from meshlark.operators import registers

    rows = [(f"g{(i * 7) % 40:02d}", ["1-2-3", "bad"]) for i in range(40)]
    products = spark.createDataFrame(rows, "generic string, packages array<string>").repartition(8)
    prices = spark.createDataFrame([("00001000203", 5.0)], "ndc string, price double")
    assert [(r.generic, r.price) for r in registers.priced_products(products, prices).collect()] == [("g00", 5.0)]


def test_ratchet_from_zero(spark):
    d = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 8.0), (4, 0.0)], "event_id long, value double").withColumn("k", F.lit(1))
    d = T.ratchet(d, "k", ["event_id"], "value", 0.5).withColumn("dirt", values.contamination_pct(F.col("clean"), F.col("value")))
    assert [(round(r.clean, 9), round(r.dirt, 9)) for r in d.orderBy("event_id").collect()] == [(0.0, 100.0), (0.0, 100.0), (8.0, 0.0), (4.0, 100.0)]


def test_places_of_one_name_are_reduced_first(spark):
    """3,000 candidates and 3,000 places share one name: 9,000,000 pairs unless the places are reduced to the best of a region."""
    i = F.col("id")
    places = spark.range(3000).select(F.lit("aa").alias("iso2"), F.lit("harbour").alias("name"), F.concat(F.lit("r"), (i % 3).cast("string")).alias("admin1"), (i % 80).alias("lat"), i.alias("lng"), F.when(i < 2999, i % 1000).alias("population"))
    asked = spark.range(3000).select("id", F.lit("aa").alias("iso2"), F.when(i % 2 == 0, "r1").alias("admin1"), F.array(F.lit("nowhere at all"), F.lit("harbours")).alias("names"))
    found = fuzzy.rank_places(asked, places)
    best = {(r.id % 2, r.name, r.lat, r.lng) for r in found.collect()}
    same, any_ = min((-(j % 1000), j % 80, j) for j in range(2999) if j % 3 == 1), min((-(j % 1000), j % 80, j) for j in range(2999))
    assert best == {(0, "harbours", *same[1:]), (1, "harbours", *any_[1:])} and found.count() == 3000
    assert max(r["_rows"] for r in fuzzy.place_bests(places).groupBy("name").agg(F.count("*").alias("_rows")).collect()) == 3


def test_whatif_by_parts_of_the_chain(spark):
    """A chain's failures equal those of its whole tree; no query result but a supplier's own rows needs the tree's suppliers."""
    e = spark.createDataFrame([*BOM, BOM[0], BOM[-6]], "src string, rel string, dst string")
    roots = spark.createDataFrame([("drug:x",), ("drug:y",)], "id string")
    off = spark.createDataFrame(SCENARIOS, "scenario_id string, off_id string")
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    chain = whatif.Chain(e, roots)
    tree, failed = whatif.build_tree(e, roots), chain.failed(off)
    base, cut = whatif.all_up(tree), whatif.cut_set(tree, off)
    changed = whatif.rollup(base, cut)
    assert rows(failed.cut_set()) == rows(cut)
    assert rows(failed.rollup()) == rows(changed)
    assert rows(failed.allocate()) == rows(whatif.allocate(base, cut, off))
    drugs = whatif.chain_health(whatif.overlaid(base.filter("kind = 'drug'"), changed, off))
    assert rows(failed.drugs()) == rows(drugs)
    failed.leaves = chain.leaves = None
    assert rows(failed.drugs()) == rows(drugs) and failed.allocate().count() > 0


def test_partner_meets_two_rows_a_spot(spark):
    """Against all pairs; 600 sites of a tier stand on 12 spots, and an anchor meets at most 24 of them."""
    rows = [(i, "t", float(i % 12 * 7), float(i % 4 * 30), float(i * 37 % 101)) for i in range(600)] + [(1000, "alone", 1.0, 1.0, 5.0)]
    sites = spark.createDataFrame(rows, "id long, tier string, lat double, lng double, score double")
    found = whatif.partner(sites.drop("score"), sites, by=["tier"])
    got = {r.id: (r.partner, round(r.value, 9)) for r in found.collect()}
    pairs = sites.drop("score").join(sites.select("tier", F.col("id").alias("p"), F.col("lat").alias("b"), F.col("lng").alias("c"), "score"), "tier").filter("id <> p")
    pairs = pairs.withColumn("v", F.col("score") - values.arc_degrees(F.col("lat"), F.col("lng"), F.col("b"), F.col("c")) / 36.0)
    assert got == {r.id: (r.b["p"], round(r.b["v"], 9)) for r in pairs.groupBy("id").agg(F.min(F.struct((-F.col("v")).alias("n"), "p", "v")).alias("b")).collect()}
    assert len(got) == 600


def test_sites_tier_drops_other_edges_before_their_distinct(spark):
    from meshlark.plans.catalog import QUERIES

    from .conftest import DATA

    plan = QUERIES["q102_sites_tier"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    distinct = [i for i, x in enumerate(plan) if "Aggregate [" in x and "produced_by" in x]
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    assert len(distinct) == 1
    after = range(distinct[0] + 1, len(plan))
    end = next((i for i in after if depth[i] <= depth[distinct[0]]), len(plan))
    assert any("Join LeftSemi" in x for x in plan[distinct[0] : end])


def test_words_are_made_below_the_join_of_pairs(spark):
    """A pair takes the words of its rows and splits no name again."""
    from meshlark.plans.catalog import QUERIES

    from .conftest import DATA

    for name in ("q21_compare_names", "q149_guard_ablation", "q22_er_threshold_sweep"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        above, join, _ = plan.partition("Join Inner")
        assert join and "regexp_replace" not in above, name


def test_equal_names_are_resolved_once(spark, monkeypatch):
    """Rows that differ in their id alone meet candidates as one; nulls are equal to each other, other fields keep rows apart."""
    seen, plain = [], fuzzy.ordered_sets
    monkeypatch.setattr(fuzzy, "ordered_sets", lambda *sides: (seen.append(max(df.count() for df, *_ in sides)), plain(*sides))[1])
    schema = "string, country string, fei string, duns string"
    kinds = [("Blue Ring Ltd", "in", None, None), ("Blue Ring Ltd", "cn", None, None), ("Blue Ring Ltd", None, "7", None), (None, None, None, None), ("Pharma Ltd", None, None, None), ("green bolt", None, None, None)]
    names = spark.createDataFrame([(i, *kinds[i % 6]) for i in range(300)], f"name_id long, name {schema}")
    register = spark.createDataFrame([(1, "blue ring", "in", None, None), (2, "Blue Ring Inc", "CN", None, None), (3, "steel nut", None, "7", None), (4, "pharma", None, None, None)], f"match_id long, name {schema}")
    got = {r.name_id: (r.match_id, r.outcome) for r in fuzzy.resolve(names, register).collect()}
    want = [(1, "matched"), (2, "matched"), (3, "refused"), (None, "none"), (4, "matched"), (None, "none")]
    want[2] = (None, "refused")  # by name two, by number one
    assert got == {i: want[i % 6] for i in range(300)}
    assert max(seen) == 6


def test_edges_are_one_file_a_bucket(spark):
    """Whatever the number of tasks; and a node of 1,000 edges is no hub while others have as many."""
    e = spark.range(0, 1_200_000, 1, 16).select((F.col("id") % 1200).cast("string").alias("src"), F.col("id").cast("string").alias("dst"))
    written = graph.Edges(e)
    assert len(written.table.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert written.split is None and written.along(spark.createDataFrame([("7",)], "src string")).count() == 1000


def test_propagation_without_targets(spark):
    """Repeated edges and equal scores: the smallest origin wins; a weak tie passes on in rounds; every node receives."""
    e = spark.createDataFrame([("a", "m", "feeds"), ("b", "m", "feeds"), ("b", "m", "feeds"), ("c", "m", "feeds"), ("m", "n", "feeds"), ("n", "m", "feeds"), ("n", "w", "formulated_into"), ("w", "v", "formulated_into")], "src string, dst string, rel string")
    s = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.4)], "node_id string, p12 double")
    got = {r.node_id: (r.p12, r.origin, r.attribution) for r in graph.propagate_max(e, s).collect()}
    strong, weak = (0.5, "a", "inherited"), (0.5, "a", "molecule")
    assert got == {"a": (0.5, "a", "direct"), "b": (0.5, "b", "direct"), "c": (0.4, "c", "direct"), "m": strong, "n": strong, "w": weak, "v": weak}
