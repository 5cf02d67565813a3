"""Keyed merges of node and edge tables, validation, and differences between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists, values


def _same(keys) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])


def latest(df: DataFrame, keys, *order: Column) -> DataFrame:
    """The first row of each key by the order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, incoming: DataFrame, keys, map_cols=("attrs",), insert_defaults: dict | None = None) -> DataFrame:
    """New non-null values win; maps merge key by key (a present key wins even with null); defaults on insert only.

    Both tables have one row per key and the same columns.
    """
    defaults, joined = insert_defaults or {}, existing.alias("o").join(incoming.alias("n"), _same(keys), "full_outer")
    inserted = F.col(f"o.{keys[0]}").isNull()

    def value(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in map_cols:
            return F.coalesce(values.merge_present(o, n), n, o)
        return F.coalesce(n, o, F.when(inserted, F.lit(defaults[c]))) if c in defaults else F.coalesce(n, o)

    return joined.select(*[value(c).alias(c) for c in existing.columns])


def builder_merge(rows: DataFrame, keys, order: str, scalars, map_col: str = "attrs") -> DataFrame:
    """The first row wins for scalars; maps fold in order, later non-null values winning; _rows counts what fell together.

    The fold needs a group's maps in one row: a key's rows are its versions from few producers.
    """
    # maps cannot be sorted, their entries can
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), F.map_entries(F.coalesce(map_col, F.expr("map()").cast("map<string,string>"))).alias("m"))))
    agg = rows.groupBy(*keys).agg(*[F.min_by(F.struct(c), order)[c].alias(c) for c in scalars], parts.alias("_p"), F.count(F.lit(1)).alias("_rows"))
    folded = F.aggregate("_p", F.expr("cast(map() as map<string,string>)"), lambda a, x: values.merge_filled(a, F.map_from_entries(x["m"])))
    return agg.withColumn(map_col, folded).drop("_p")


def union_priority(dfs: list[DataFrame], keys, keep: str = "last") -> DataFrame:
    """Whole rows by producer order: the last (or first) table that has a key gives its row."""
    tagged = [d.withColumn("_src", F.lit(i)) for i, d in enumerate(dfs)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return latest(both, keys, F.col("_src").desc() if keep == "last" else F.col("_src").asc()).drop("_src")


def collisions(dfs: list[DataFrame], keys) -> DataFrame:
    """Keys that more than one producer has."""
    tagged = [d.select(*keys).distinct().withColumn("_src", F.lit(i)) for i, d in enumerate(dfs)]
    return reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.count(F.lit(1)).alias("producers")).filter("producers > 1")


def cited_edges(edges: DataFrame) -> DataFrame:
    """Edges without those of layer 3 that cite nothing."""
    return edges.filter("NOT (layer <=> 3 AND (citation IS NULL OR trim(citation) = ''))")


def fill_missing(nodes: DataFrame, side: DataFrame, key: str, cols) -> DataFrame:
    """Left join that fills only what is null."""
    s = side.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in cols])
    return nodes.join(s, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in cols else F.col(c) for c in nodes.columns])


def dangling(rows: DataFrame, ref: str, nodes: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(nodes.select(F.col(key).alias(ref)), ref, "left_anti")


def builtin_type(node_id: Column) -> Column:
    """The type that an id's grammar implies; null if no pattern fits."""
    return F.coalesce(*[F.when(node_id.rlike(p), F.lit(t)) for p, t in lists.NODE_PATTERNS.items()])


def validate(nodes: DataFrame, edges: DataFrame, signals: DataFrame | None = None, compliance: DataFrame | None = None, bins: DataFrame | None = None) -> DataFrame:
    """Violations (severity, where, message); none of severity error means that the tables may be published."""
    out = []

    def rule(df: DataFrame, bad: Column, where: Column, message: str, severity: str = "error") -> None:
        out.append(df.filter(bad).select(F.lit(severity).alias("severity"), where.alias("where"), F.lit(message).alias("message")))

    nid, implied = F.col("id"), builtin_type(F.col("id"))
    rule(nodes, implied.isNull(), nid, "id fits no pattern")
    rule(nodes, implied.isNotNull() & ~F.col("type").eqNullSafe(implied), nid, "type does not fit the id")
    if "country" in nodes.columns:
        rule(nodes, F.col("country").isNotNull() & ~F.col("country").rlike("^[a-z]{2}$"), nid, "country is not a lower-case ISO-2 code")
    if "resolved_by" in nodes.columns:
        rule(nodes, F.col("resolved_by").isNotNull() & ~F.col("resolved_by").isin("fei", "duns", "fuzzy"), nid, "unknown resolved_by")
        rule(nodes, nid.startswith("company:name:") & ~F.col("resolved_by").eqNullSafe("fuzzy"), nid, "a company known by name must be fuzzy")
    rule(nodes.groupBy("id").count(), F.col("count") > 1, nid, "id is not unique")
    edge = F.concat_ws(" ", "src", "rel", "dst")
    rule(edges, ~F.coalesce(F.col("layer").isin(1, 2, 3), F.lit(False)), edge, "layer is not 1, 2 or 3")
    rule(edges, (F.col("layer") == 3) & (F.trim(F.coalesce("citation", F.lit(""))) == ""), edge, "layer 3 without a citation")
    rule(edges, ~F.coalesce(F.col("rel").isin(lists.RELATIONS), F.lit(False)), edge, "unknown relation", "warning")
    for end in ("src", "dst"):
        rule(dangling(edges, end, nodes), F.lit(True), F.concat_ws(" ", "src", "rel", "dst"), f"{end} has no node", "warning")
    if signals is not None:
        rule(dangling(signals, "node_id", nodes), F.lit(True), F.col("node_id"), "signal on an unknown node", "warning")
        rule(signals, F.col("observed_at").isNull(), F.col("node_id"), "signal without a date")
    if compliance is not None:
        rule(compliance.groupBy("node_id").count(), F.col("count") > 1, F.col("node_id"), "more than one compliance row")
        rule(compliance, F.coalesce(F.cardinality("evidence"), F.lit(0)) == 0, F.col("node_id"), "verdict without evidence")
    if bins is not None:
        rule(bins, F.exists("covers_drugs", lambda d: ~d.startswith("drug:")), F.col("node_id"), "covers something that is no drug")
        rule(bins, ~F.col("storage_class").isin([s[0] for s in lists.STORAGE_CLASSES]), F.col("node_id"), "unknown storage class")
    return reduce(DataFrame.unionByName, out)


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("type", "id")


def canonical_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("layer", "rel", "src", "dst")


def dedupe_lines(df: DataFrame, keys, order: str, cols) -> DataFrame:
    """Lines of one event fall together: the first line's columns and how many there were."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("entry_lines"), *[F.min_by(F.struct(c), order)[c].alias(c) for c in cols])
