"""Reads and reports over the graph: nodes with what hangs on them, ranked lists, provenance, sentences, and a view that a
stream keeps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..sources import versions


def node_view(nodes: DataFrame, signals: DataFrame, compliance: DataFrame) -> DataFrame:
    """nodes(id, ...) with signals(node_id, kind, observed_at) counted and the newest one, and compliance(node_id, ...)."""
    by = signals.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("observed_at", "kind")).alias("_newest"))
    out = nodes.join(by, "id", "left").join(compliance.withColumnRenamed("node_id", "id"), "id", "left")
    return out.withColumn("signals", F.coalesce("_n", F.lit(0))).withColumns({"newest_kind": F.col("_newest.kind"), "newest_at": F.col("_newest.observed_at")}).drop("_n", "_newest")


def since(signals: DataFrame, day: Column) -> DataFrame:
    """Signals from a day on, newest first."""
    return signals.filter(F.col("observed_at").cast("date") >= day).orderBy(F.desc("observed_at"))


def in_country(df: DataFrame, column: str, country: str) -> DataFrame:
    return df.filter(F.lower(column) == country.lower())


def worst_of(scored: DataFrame, group: str, ident: str) -> DataFrame:
    """scored(p12, raw) -> each group's row of the greatest (p12, raw); ties: the smallest ident."""
    w = Window.partitionBy(group).orderBy(F.desc("p12"), F.desc("raw"), ident)
    return scored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_risk(scored: DataFrame, k: int, ident: str = "node_id") -> DataFrame:
    """The k greatest of direct(ly) scored rows, one for each plant (fei), with their place."""
    best = worst_of(scored.filter("attribution = 'direct'"), "fei", ident).orderBy(F.desc("p12"), F.desc("raw"), ident).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p12"), F.desc("raw"), ident)))  # k rows


def provenance(df: DataFrame, day: Column, distinct: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """One row: rows, first and last day, distinct values, and rows with a flag."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), *[F.count_distinct(c).alias(n) for n, c in distinct.items()], *[F.count_if(c).alias(n) for n, c in flags.items()])


def histogram(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def out_of_order(lines: DataFrame, doc: str, pos: str, key: str) -> DataFrame:
    """Lines whose key is less than that of the line before."""
    before = F.lag(key).over(Window.partitionBy(doc).orderBy(pos))
    return lines.withColumn("_before", before).filter(F.col("_before") > F.col(key)).drop("_before")


def placed(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The place of each row in its group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def suppliers_in_order(suppliers: DataFrame, group: list[str]) -> DataFrame:
    """suppliers(iso, label): by country, those without one last, then by label."""
    return placed(suppliers, group, F.col("iso").isNull(), F.col("iso"), F.col("label"))


def routes_in_order(routes: DataFrame, group: list[str]) -> DataFrame:
    """routes(up, iso): most sources standing first, then by country."""
    return placed(routes, group, F.desc("up"), F.col("iso"))


def evidence_lines(lines: dict[str, tuple[Column, Column]]) -> Column:
    """{name: (weight, text or null)} -> the texts, of the largest absolute weight first; ties in the order given."""
    items = F.array(*[F.when(t.isNotNull(), F.struct((-F.abs(w)).alias("w"), F.lit(i).alias("i"), t.alias("t"))) for i, (w, t) in enumerate(lines.values())])
    return F.transform(F.array_sort(F.filter(items, lambda x: x.isNotNull())), lambda x: x["t"])


def subset(part: DataFrame, whole: DataFrame, key: list[str]) -> DataFrame:
    """One row: whether every key of part is in whole, and how many are not."""
    missing = part.select(*key).distinct().join(whole.select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return missing.select((F.col("missing") == 0).alias("ok"), "missing")


def prior_and_future(onsets: DataFrame, key: str, day: Column, cutoff: Column) -> DataFrame:
    """Whether a key had an onset before the cutoff, and on or after it; a key may have both."""
    return onsets.filter(day.isNotNull()).groupBy(key).agg(F.bool_or(day < cutoff).alias("prior"), F.bool_or(day >= cutoff).alias("future"))


def trailing_clause(c: Column, word: str) -> Column:
    """struct(name, clause): what a closing parenthesis with `word ... :` lists, apart from the name before it."""
    found = F.regexp_extract(c, rf"(?is)\([^()]*{word}\w*:(.*)\)\s*$", 1)
    return F.struct(F.trim(F.regexp_replace(c, rf"(?is)\s*\([^()]*{word}\w*:.*\)\s*$", "")).alias("name"), F.nullif(F.trim(found), F.lit("")).alias("clause"))


def iso_day(c: Column, fmt: str) -> Column:
    """Text as an ISO day; text that does not parse is an error."""
    return F.date_format(F.to_date(c, fmt), "yyyy-MM-dd")


def payload_fields(payload: Column, **paths: str) -> list[Column]:
    return [F.get_json_object(payload, p).alias(n) for n, p in paths.items()]


def united(df: DataFrame, key: str, values: str) -> DataFrame:
    """The sorted union of all arrays of a key."""
    return df.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(values)))).alias(values))


def curated_edges(rows: DataFrame) -> DataFrame:
    """rows(src, rel, dsts array, citation) of a hand-kept table -> layer 3 edges; a row without a citation is an error."""
    missing = rows.filter(F.coalesce(F.trim("citation"), F.lit("")) == "").select("src", "rel").first()
    if missing:
        raise ValueError(f"no citation: {missing.src} {missing.rel}")
    return rows.select("src", "rel", F.explode("dsts").alias("dst"), F.lit(3).alias("layer"), "citation")


def sites_tier(holders: DataFrame, nodes: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """holders(id, label, substance_node), places(id, lat, lng) -> (new nodes, edges, geo): holders that are nodes
    already get only edges."""
    new = holders.select("id", "label").groupBy("id").agg(F.min("label").alias("label")).join(nodes.select("id"), "id", "left_anti")
    made = holders.select(F.col("substance_node").alias("src"), F.lit("produced_by").alias("rel"), F.col("id").alias("dst")).distinct()
    return new, made, places.join(new.select("id"), "id", "left_semi")


def facility_history(events: DataFrame, key: str, order: list[Column], k: int = 12) -> DataFrame:
    """The first k events of each plant, in order."""
    return placed(events, [key], *order).filter(F.col("place") <= k)


def thresholds(spark: SparkSession) -> DataFrame:
    """The rules' bounds as a table."""
    return spark.createDataFrame([("share_gt", float(lists.SHARE_GT)), ("event_window_days", float(lists.EVENT_WINDOW_DAYS)), ("stale_s", float(lists.STALE_S)), ("dwell_s", float(lists.DWELL_S)), ("min_window_s", float(lists.MIN_WINDOW_S))], "name string, value double")


def impact_sentence(down: Column, total: Column, what: str = "products") -> Column:
    return F.when(down == 0, F.lit(f"no {what} lose a source")).when(down == total, F.concat(F.lit("all "), total.cast("string"), F.lit(f" {what} lose every source"))).otherwise(F.concat(down.cast("string"), F.lit(" of "), total.cast("string"), F.lit(f" {what} lose every source")))


def shortlist_sentence(names: Column, most: int = 3) -> Column:
    """The first names of a list, and how many more there are."""
    rest = F.size(names) - most
    return F.when(F.size(names) == 0, "no alternative stands").otherwise(F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise("")))


#: Rankings to beat, over the columns of pointintime.features.
BASELINES = {
    "b1": lambda: (F.col("oai_all") > 0).cast("double"),
    "b2": lambda: F.col("oai_all") + F.col("refusal_mfg_3y") + F.col("vai_3y"),
    "b3": lambda: -F.col("months_since_oai"),
}


def model_table(keys: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """keys with the numeric columns of all parts (one row per key each), 0 where a part has none."""
    out = reduce(lambda a, b: a.join(b, key, "left"), parts, keys.select(key).distinct())
    return out.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in out.columns if c != key])


def over_cutoffs(cutoffs: list[str], measured: Callable[[Column], DataFrame]) -> DataFrame:
    """The same measure at several cutoffs, under each other."""
    return reduce(DataFrame.unionByName, [measured(F.lit(c).cast("timestamp")).withColumn("cutoff", F.lit(c)) for c in cutoffs])


def with_known(rows: DataFrame, ref: str, nodes: DataFrame) -> DataFrame:
    """Rows whose reference is a node."""
    return rows.join(nodes.select(F.col("id").alias(ref)), ref, "left_semi")


def country_name(c: Column, names: dict[str, str]) -> Column:
    """The display name of a country code, or the code in capitals."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(c)), F.upper(c))


def listed(names: Column) -> Column:
    """a, b and c"""
    n = F.size(names)
    return F.when(n == 0, "").when(n == 1, names[0]).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


def tree_paths(tree: DataFrame) -> DataFrame:
    """A flat tree (key = the parent's key and the id) with depth and path of each row."""
    path = F.split("key", r"\|")
    return tree.select("key", "id", "kind", (F.size(path) - 1).alias("depth"), F.array_join(path, " > ").alias("path"))


def apply_changes(view: DataFrame | None, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A keyed view after a batch of changes: the newest row of each key stays."""
    both = batch if view is None else view.unionByName(batch)
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_view(changes: DataFrame, folder: str, checkpoint: str, key: str, order: list[str]):
    """A stream of changes kept as a keyed view. Returns the started query; read_view gives the view.

    A batch is written as a part of its own; the last parts are merged with it while they hold at most twice its rows, so a
    row is rewritten a logarithmic number of times and the parts stay as few. A batch that comes again changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = versions.newest(spark, folder) or {"parts": [], "stream": checkpoint, "batch": -1}
        if state["stream"] == checkpoint and state["batch"] >= number:
            return
        kept = state["parts"]
        part = sized(spark, versions.add_part(apply_changes(None, batch, key, order), folder))
        near, rows = [], part["rows"]
        while kept and kept[-1]["rows"] <= 2 * rows:
            rows += kept[-1]["rows"]
            near.append(kept.pop())
        if near:
            part = sized(spark, versions.add_part(apply_changes(None, versions.parts_of(spark, folder, [*near, part]), key, order), folder))
        versions.point(spark, folder, {"parts": [*kept, part], "stream": checkpoint, "batch": number, "key": key, "order": order})

    def sized(spark: SparkSession, part: dict) -> dict:
        return part | {"rows": versions.parts_of(spark, folder, [part]).count()}

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_view(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest whole state of a kept view: the newest row of each key over its parts."""
    state = versions.newest(spark, folder)
    if state is None:
        return None
    rows = versions.parts_of(spark, folder, state["parts"])
    return rows if len(state["parts"]) == 1 else apply_changes(None, rows, state["key"], state["order"])


def snapshot_then_changes(view: DataFrame, changes: DataFrame) -> DataFrame:
    """What a reader of the change stream gets: the view as it stands, then what follows."""
    return view.withColumn("event", F.lit("snapshot")).unionByName(changes.withColumn("event", F.lit("change")))
