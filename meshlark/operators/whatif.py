"""What a failure does: a flat bill-of-materials tree, its cut set, the roll-up, allocation and re-ranking.

A tree row is (key, id, parent_key, kind, tier, iso); its key is the parent's key and its id, as one company can stand
in two tiers. The tree has a fixed depth (drug, api, precursor, supplier), so each level is one join. Scenarios are rows
(scenario_id, off_id); a scenario with nothing off has the row (scenario_id, null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import arc_degrees
from .graph import checkpointed
from .order import against

TREE = ["key", "id", "parent_key", "kind", "tier", "iso"]


def build_tree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """roots(id): drug <- active_in api <- feeds precursor, suppliers by produced_by at both tiers, country by incorporated_in."""
    return Chain(edges, roots).tree()


class Chain:
    """The tree of build_tree by its parts: its items, written once, and who makes an item, whatever the number of its rows.

    A failure is found out for an id, not for each of its rows, and goes down the items as a list of scenarios. Suppliers
    are by far the most rows: they are joined below the items in one pass, and only where a result has rows for them.
    """

    def __init__(self, edges: DataFrame, roots: DataFrame):
        rel = lambda name: edges.filter(F.col("rel") == name).select("src", "dst")
        iso = rel("incorporated_in").groupBy(F.col("src").alias("id")).agg(F.min(F.regexp_replace("dst", "^country:", "")).alias("iso"))

        def below(parents: DataFrame, links: DataFrame, kind: str) -> DataFrame:
            """links(up, id)"""
            p = parents.select(F.col("key").alias("parent_key"), F.col("id").alias("up"))
            return p.join(links, "up").select(F.concat_ws("|", "parent_key", "id").alias("key"), "id", "parent_key", F.lit(kind).alias("kind"), F.lit(kind).alias("tier"))

        into = lambda name: rel(name).select(F.col("dst").alias("up"), F.col("src").alias("id")).distinct()
        self.feeds = checkpointed(into("feeds"))
        drug = roots.select(F.col("id").alias("key"), "id", F.lit(None).cast("string").alias("parent_key"), F.lit("drug").alias("kind"), F.lit("drug").alias("tier"))
        api = below(drug, into("active_in"), "api")
        items = drug.unionByName(api).unionByName(below(api, self.feeds, "precursor"))
        self.items = checkpointed(items.join(iso, "id", "left").select(*TREE))
        made = rel("produced_by").select(F.col("src").alias("up"), F.col("dst").alias("id")).repartition("up").dropDuplicates(["up", "id"])  # one shuffle; an item's makers lie together
        self.made = checkpointed(made.join(iso, "id", "left").select("up", "id", "iso"))

    def leaves(self, items: DataFrame, made: DataFrame, *more: str) -> DataFrame:
        """The suppliers' rows below the items, with other columns of the two."""
        p = items.filter("kind <> 'drug'").select(F.col("key").alias("parent_key"), F.col("id").alias("up"), "tier", *[c for c in more if c in items.columns])
        return p.join(made, "up").select(F.concat_ws("|", "parent_key", "id").alias("key"), "id", "parent_key", F.lit("supplier").alias("kind"), "tier", "iso", *more)

    def tree(self) -> DataFrame:
        return self.items.unionByName(self.leaves(self.items, self.made))

    def failed(self, scenarios: DataFrame) -> Failed:
        return Failed(self, scenarios)


class Failed:
    """What the scenarios do to a chain; the rules are those of cut_set and rollup."""

    def __init__(self, chain: Chain, scenarios: DataFrame):
        self.chain, self.scenarios, none = chain, scenarios, F.array().cast("array<string>")
        off = scenarios.filter("off_id IS NOT NULL").select("scenario_id", "off_id").distinct()
        ids = chain.items.select("id", "iso").unionByName(chain.made.select("id", "iso")).distinct()
        names = ids.select("id", F.explode(F.array_compact(F.array("id", F.concat(F.lit("country:"), "iso")))).alias("off_id"))
        own = checkpointed(names.join(off, "off_id").groupBy("id").agg(F.collect_set("scenario_id").alias("own")))
        self.made = chain.made.join(own, "id", "left").withColumn("own", F.coalesce("own", none))

        # what an item loses of its own suppliers, whatever stands above it
        self.makers = checkpointed(chain.made.groupBy("up").agg(F.count(F.lit(1)).alias("n")))
        self.gone = checkpointed(chain.made.join(own, "id").select("up", F.explode("own").alias("scenario_id")).groupBy("up", "scenario_id").agg(F.count(F.lit(1)).alias("lost")))
        idle = self.gone.join(self.makers, "up").filter("lost = n").select(F.col("up").alias("id"), "scenario_id")
        shut = own.select("id", F.explode("own").alias("scenario_id")).unionByName(idle).distinct()
        n = chain.feeds.groupBy("up").agg(F.count(F.lit(1)).alias("n"))
        gated = shut.join(chain.feeds, "id").groupBy("up", "scenario_id").agg(F.count(F.lit(1)).alias("met")).join(n, "up").filter("met = n")
        gated = gated.groupBy(F.col("up").alias("id")).agg(F.collect_set("scenario_id").alias("gated"))

        def dead(kind: str, above: DataFrame | None) -> DataFrame:
            rows = chain.items.filter(F.col("kind") == kind).join(own, "id", "left").withColumn("dead", F.coalesce("own", none)).drop("own")
            if above is None:
                return rows
            over = above.filter(F.size("dead") > 0).select(F.col("key").alias("parent_key"), F.col("dead").alias("over"))
            return rows.join(over, "parent_key", "left").withColumn("dead", F.array_union("dead", F.coalesce("over", none))).drop("over")

        drugs = dead("drug", None)
        apis = checkpointed(dead("api", drugs).join(gated, "id", "left").withColumn("under", F.array_union("dead", F.coalesce("gated", none))).drop("gated"))
        pres = dead("precursor", apis).withColumn("under", F.col("dead"))
        #: the items, the scenarios in which they are dead, and those in which all of their suppliers are
        self.items = checkpointed(drugs.withColumn("under", F.col("dead")).unionByName(apis).unionByName(pres))

    def dead_leaves(self) -> DataFrame:
        rows = self.chain.leaves(self.items, self.made, "own", "under").withColumn("scenario_id", F.explode(F.array_union("own", "under")))
        return rows.select("scenario_id", *TREE)

    def cut_set(self) -> DataFrame:
        """As cut_set over the tree."""
        return self.items.withColumn("scenario_id", F.explode("dead")).select("scenario_id", *TREE).unionByName(self.dead_leaves())

    def rolled(self) -> DataFrame:
        """The items with their total and `lost`, an array of (scenario_id, lost) for the scenarios that take any of it."""
        lists = lambda rows, key: rows.groupBy(key).agg(F.collect_list(F.struct("scenario_id", "lost")).alias("part"))
        mine, none = self.makers.join(lists(self.gone, "up"), "up", "left").withColumnsRenamed({"up": "id", "part": "gone"}), F.array().cast("array<struct<scenario_id:string,lost:bigint>>")

        def level(kind: str, children: DataFrame | None) -> DataFrame:
            rows = self.items.filter(F.col("kind") == kind).join(mine, "id", "left")
            if children is None:
                rows = rows.withColumns({"below": F.lit(None).cast("bigint"), "part": none})
            else:
                rows = rows.join(children.groupBy(F.col("parent_key").alias("key")).agg(F.sum("total").alias("below")), "key", "left")
                sent = children.select("parent_key", F.inline("lost")).groupBy(F.col("parent_key").alias("key"), "scenario_id").agg(F.sum("lost").alias("lost"))
                rows = rows.join(lists(sent, "key"), "key", "left")
            direct, total = F.col("n").isNotNull(), F.coalesce("n", "below", F.lit(1)).cast("bigint")
            rows = rows.withColumn("total", total).withColumn("all", F.when(direct, F.col("under")).otherwise(F.col("dead")))
            some = F.filter(F.coalesce(F.when(direct, F.col("gone")).otherwise(F.col("part")), none), lambda x: ~F.array_contains("all", x["scenario_id"]))
            whole = F.transform("all", lambda x: F.struct(x.alias("scenario_id"), F.col("total").alias("lost")))
            return checkpointed(rows.select("key", "id", "parent_key", "kind", "total", F.concat(whole, some).alias("lost")))

        pre = level("precursor", None)
        api = level("api", pre)
        return pre.unionByName(api).unionByName(level("drug", api))

    def changed(self, rolled: DataFrame) -> DataFrame:
        rows = rolled.select("key", "id", "kind", "total", F.inline("lost")).withColumn("up", F.col("total") - F.col("lost"))
        return rows.select("scenario_id", "key", "id", "kind", "total", "up", health(F.col("up"), F.col("total")).alias("health"))

    def rollup(self) -> DataFrame:
        """As rollup over the tree."""
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        leaves = self.dead_leaves().select("scenario_id", "key", "id", "kind", one.alias("total"), none.alias("up"), F.lit("down").alias("health"))
        return self.changed(self.rolled()).unionByName(leaves)

    def drugs(self) -> DataFrame:
        """Every drug in every scenario, as chain_health gives them; no supplier's row is formed."""
        drugs = self.rolled().filter("kind = 'drug'")
        return chain_health(overlaid(drugs, self.changed(drugs), self.scenarios))

    def allocate(self) -> DataFrame:
        """As allocate over the tree: items of one id that fail alike are counted, not repeated."""
        alike = self.items.filter("kind <> 'drug'").groupBy(F.col("id").alias("up"), F.array_sort("under").alias("under")).agg(F.count(F.lit(1)).alias("rows"))
        iso = F.coalesce("iso", F.lit("unknown")).alias("iso")
        rows = alike.join(self.made, "up").groupBy(iso, F.array_sort(F.array_union("own", "under")).alias("off")).agg(F.sum("rows").alias("rows"))
        rows = checkpointed(rows)
        total = rows.groupBy("iso").agg(F.sum("rows").alias("total"))
        lost = rows.select("iso", "rows", F.explode("off").alias("scenario_id")).groupBy("scenario_id", "iso").agg(F.sum("rows").alias("lost"))
        return shared_out(total, lost, self.scenarios)


def cut_set(tree: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, tree columns): the rows that are dead, and no others, so that the work of a scenario grows with what fails.

    A row is dead if it is switched off, its country halted, it stands under something dead, or it is gated. An api is gated
    if it has precursors and each is off or has suppliers that are all off; its suppliers then are dead.
    """
    t = checkpointed(tree.select(*TREE))  # read by every level
    off = scenarios.filter("off_id IS NOT NULL").select("scenario_id", "off_id").distinct()
    names = t.select(*TREE, F.explode(F.array_compact(F.array("id", F.concat(F.lit("country:"), "iso")))).alias("off_id"))
    own = checkpointed(names.join(off, "off_id").select("scenario_id", *TREE).distinct())
    cols = ["scenario_id", *TREE]
    leaf = lambda tier: f"kind = 'supplier' AND tier = '{tier}'"
    keys = lambda rows: rows.select("scenario_id", F.col("key").alias("parent_key"))

    def dead(rows: str, above: DataFrame) -> DataFrame:
        """The tree's rows that are off themselves or lie under one of `above`(scenario_id, parent_key)."""
        return own.filter(rows).unionByName(t.filter(rows).join(above, "parent_key").select(*cols)).distinct()

    def all_of(part: DataFrame, rows: str) -> DataFrame:
        """(scenario_id, key) whose children among `rows` all stand in part(scenario_id, parent_key)."""
        n = t.filter(rows).groupBy("parent_key").agg(F.count(F.lit(1)).alias("n"))
        met = part.groupBy("scenario_id", "parent_key").agg(F.count(F.lit(1)).alias("met")).join(n, "parent_key")
        return met.filter("met = n").select("scenario_id", F.col("parent_key").alias("key"))

    drugs = own.filter("kind = 'drug'")
    apis = checkpointed(dead("kind = 'api'", keys(drugs)))
    pres = checkpointed(dead("kind = 'precursor'", keys(apis)))
    # precursors by themselves, then the gate over each api
    idle = all_of(own.filter(leaf("precursor")), leaf("precursor")).join(t.filter("kind = 'precursor'").select("key", "parent_key"), "key")
    shut = own.filter("kind = 'precursor'").select("scenario_id", "key", "parent_key").unionByName(idle.select("scenario_id", "key", "parent_key")).distinct()
    blocked = keys(apis).unionByName(keys(all_of(shut, "kind = 'precursor'"))).distinct()
    return drugs.unionByName(apis).unionByName(pres).unionByName(dead(leaf("api"), blocked)).unionByName(dead(leaf("precursor"), keys(pres)))


def all_up(tree: DataFrame) -> DataFrame:
    """(key, id, parent_key, kind, iso, total, direct): the roll-up with nothing off, made once for all scenarios. A leaf is one
    source; an item pools its suppliers (direct), else its children."""
    t = checkpointed(tree.select(*TREE))
    per = lambda rows, name: rows.groupBy(F.col("parent_key").alias("key")).agg(F.sum("total").alias(name))
    leaf = t.filter("kind = 'supplier'").withColumn("total", F.lit(1).cast("long")).withColumn("direct", F.lit(False))
    sources = per(leaf, "sources")

    def pool(kind: str, children: DataFrame | None) -> DataFrame:
        mine = t.filter(F.col("kind") == kind).join(sources, "key", "left")
        mine = mine.withColumn("below", F.lit(None).cast("long")) if children is None else mine.join(per(children, "below"), "key", "left")
        return mine.select(*TREE, F.coalesce("sources", "below", F.lit(1)).cast("long").alias("total"), F.col("sources").isNotNull().alias("direct"))

    pre = pool("precursor", None)
    api = pool("api", pre)
    rows = leaf.unionByName(pre).unionByName(api).unionByName(pool("drug", api))
    return rows.select("key", "id", "parent_key", "kind", "iso", "total", "direct")


def rollup(base: DataFrame, cut: DataFrame) -> DataFrame:
    """(scenario_id, key, id, kind, total, up, health) of the rows that lose a source; all others stand as in `base` (all_up).

    What is lost goes up the tree: a dead item loses all, another what its suppliers lose, or, without suppliers, its children.
    """
    base, cut = checkpointed(base), checkpointed(cut.select("scenario_id", "key", "parent_key", "kind"))
    leaves = cut.filter("kind = 'supplier'").select("scenario_id", "key", "parent_key", F.lit(1).cast("long").alias("lost"))
    per = lambda rows, name: rows.groupBy("scenario_id", F.col("parent_key").alias("key")).agg(F.sum("lost").alias(name))
    sources = checkpointed(per(leaves, "sources"))

    def level(kind: str, children: DataFrame | None) -> DataFrame:
        gone = cut.filter(F.col("kind") == kind).select("scenario_id", "key", F.lit(True).alias("dead"))
        met = gone.join(sources, ["scenario_id", "key"], "full")
        met = met.withColumn("below", F.lit(None).cast("long")) if children is None else met.join(per(children, "below"), ["scenario_id", "key"], "full")
        part = F.when(F.col("direct"), F.col("sources")).otherwise(F.col("below"))
        met = met.join(base.filter(F.col("kind") == kind), "key").withColumn("lost", F.when(F.col("dead"), F.col("total")).otherwise(part))
        return checkpointed(met.filter("lost > 0").select("scenario_id", "key", "parent_key", "lost"))

    pre = level("precursor", None)
    api = level("api", pre)
    lost = leaves.unionByName(pre).unionByName(api).unionByName(level("drug", api))
    out = lost.drop("parent_key").join(base, "key").withColumn("up", F.col("total") - F.col("lost"))
    return out.select("scenario_id", "key", "id", "kind", "total", "up", health(F.col("up"), F.col("total")).alias("health"))


def health(up: Column, total: Column) -> Column:
    return F.when(up == 0, "down").when(up < total, "at-risk").otherwise("ok")


def overlaid(base: DataFrame, changed: DataFrame, scenarios: DataFrame) -> DataFrame:
    """rollup's columns for every row of `base` in every scenario: for a part of the tree, such as its drugs."""
    rows = against(base.select("key", "id", "kind", "total"), scenarios.select("scenario_id").distinct())
    up = F.coalesce("up", "total")
    rows = rows.join(changed.select("scenario_id", "key", "up"), ["scenario_id", "key"], "left").withColumn("up", up)
    return rows.select("scenario_id", "key", "id", "kind", "total", "up", health(F.col("up"), F.col("total")).alias("health"))


def allocate(base: DataFrame, cut: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, iso, total, up, share): even split of the suppliers left standing over their jurisdictions."""
    iso = F.coalesce("iso", F.lit("unknown")).alias("iso")
    per = base.filter("kind = 'supplier'").groupBy(iso).agg(F.count(F.lit(1)).alias("total"))
    lost = cut.filter("kind = 'supplier'").groupBy("scenario_id", iso).agg(F.count(F.lit(1)).alias("lost"))
    return shared_out(per, lost, scenarios)


def shared_out(per: DataFrame, lost: DataFrame, scenarios: DataFrame) -> DataFrame:
    per = against(per, scenarios.select("scenario_id").distinct()).join(lost, ["scenario_id", "iso"], "left")
    per = per.withColumn("up", F.col("total") - F.coalesce("lost", F.lit(0))).drop("lost")
    share = F.coalesce(F.try_divide(F.col("up").cast("double"), F.sum("up").over(Window.partitionBy("scenario_id")).cast("double")), F.lit(0.0))
    return per.withColumn("share", share)


def rerank(alternates: DataFrame, failed: DataFrame, away: float = 2.0, same: float = -2.0) -> DataFrame:
    """alternates(node, holder, iso2 array, score, viable, standing) x failed(scenario_id, isos array) -> delta, adjusted, rank.

    All sites outside the failed jurisdictions earn `away`, one inside costs `same`; an unplaced holder gets neither.
    Only those standing are ranked; the best is one only if it is viable.
    """
    a = against(alternates, failed.select("scenario_id", "isos"))
    delta = F.when(F.size("iso2") == 0, 0.0).when(F.arrays_overlap("iso2", "isos"), same).otherwise(away)
    a = a.withColumn("delta", delta).withColumn("adjusted", F.col("score") + F.col("delta"))
    w = Window.partitionBy("scenario_id", "node", "standing").orderBy(F.desc("adjusted"), F.desc("score"), "holder")
    a = a.withColumn("rank", F.when(F.col("standing"), F.row_number().over(w)))
    return a.withColumn("best", F.coalesce((F.col("rank") == 1) & F.col("viable"), F.lit(False)))


def partner(anchors: DataFrame, others: DataFrame, by: list[str], per_point: float = 36.0) -> DataFrame:
    """For each anchor(id, lat, lng) the other(id, lat, lng, score) with the greatest score less distance / per_point.

    Of others at one spot only the two best can win (the best may be the anchor itself), so an anchor meets two rows a spot.
    """
    spot = Window.partitionBy(*by, "lat", "lng").orderBy(F.desc("score"), "id")
    o = others.withColumn("_rn", F.row_number().over(spot)).filter("_rn <= 2")
    o = o.select(*by, F.col("id").alias("partner"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), "score")
    tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as a few rows here become many
    pairs = anchors.repartition(tasks, "id").join(o, by).filter("id <> partner")
    pairs = pairs.withColumn("degrees", arc_degrees(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))).withColumn("value", F.col("score") - F.col("degrees") / per_point)
    best = F.struct(F.col("value").isNull(), (-F.col("value")).alias("less"), "partner", "degrees", "value")
    return pairs.groupBy(*by, "id").agg(F.min(best).alias("_best")).select(*by, "id", "_best.partner", "_best.degrees", "_best.value")


def chain_health(rolled: DataFrame) -> DataFrame:
    """The drugs of a roll-up (of `overlaid` drugs, where the unharmed ones count too)."""
    return rolled.filter("kind = 'drug'").select("scenario_id", F.col("id").alias("drug"), "total", "up", "health")

