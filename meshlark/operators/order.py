"""Running sums in a global order, and a stated set of queries against a whole table, without one task that holds all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def before(df: DataFrame, order: list, sums: dict[str, Column], by=()) -> DataFrame:
    """df with a column for each of `sums`: the sum over the rows before in `order`, within `by`; 0 for the first.

    Rows are cut into ranges of the order and written, so that a row stays in its range; sums run within a range, and a
    range starts from what its group has in earlier ones. A range begins in one group, so these starts are at most as many
    as there are ranges, and they are broadcast. `order` has to tell rows apart (end it with an id); equal rows then are
    interchangeable.
    """
    by, order = list(by), [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = df.withColumns(sums).repartitionByRange(*[F.col(c) for c in by], *order)
    cut = checkpointed(ranges.withColumn("_range", F.spark_partition_id()))
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(*earlier)
    total = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(*earlier)
    starts = total.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[F.sum(c).over(ahead).alias(f"_start{i}") for i, c in enumerate(sums)], F.row_number().over(Window.partitionBy(*by).orderBy("_range")).alias("_nth")).filter("_nth > 1")
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = cut.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(F.broadcast(starts), same, "left")
    out = out.withColumns({c: F.col(c) + F.coalesce(f"_start{i}", F.lit(0)) for i, c in enumerate(sums)})
    return out.select(*dict.fromkeys([*df.columns, *sums]))


def counted(df: DataFrame, name: str, by=()) -> DataFrame:
    """df with the number of rows of its group."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    if not by:
        return df.join(F.broadcast(n))  # one row
    n = n.select(name, *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    return df.join(n, same).select(*df.columns, name)


def against(rows: DataFrame, queries: DataFrame, block: int = 256, salts: int = 16) -> DataFrame:
    """Every row with every one of a stated set of queries (scenarios, buyers), which are counted first.

    The queries stand in blocks of about `block`. One block is broadcast; several are joined with the rows by block and
    salt, so that no task holds all queries or all rows.
    """
    blocks = max(1, math.ceil(queries.count() / block))
    sets = queries.select(F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)).alias("_block"), F.struct(*queries.columns).alias("_query"))
    sets = sets.groupBy("_block").agg(F.collect_list("_query").alias("_queries"))
    if blocks == 1:
        met = rows.join(F.broadcast(sets))
    else:
        sets = sets.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        met = spread.join(sets, ["_block", "_salt"])
    return met.select(*rows.columns, F.explode("_queries").alias("_query")).select(*rows.columns, *[F.col("_query")[c].alias(c) for c in queries.columns])


def bracketed(rows: DataFrame, score: str, points: DataFrame, at: str) -> DataFrame:
    """rows with `before`, the last of `points` at or below the score, and `after`, the first one above it (structs of the
    points' columns; null where there is none, both for a null score).

    Points and rows are sorted together into ranges; a range carries on what the ranges before and after it end with, two
    rows each, so neither side is broadcast or held in one task. Equal scores may lie in several ranges.
    """
    point, row = F.struct(*points.columns), F.struct(*rows.columns)
    none = lambda df: F.lit(None).cast(df.schema.simpleString())
    salt = lambda kind: F.lit(kind).alias("_kind")
    at_points = points.filter(F.col(at).isNotNull()).select(F.col(at).cast("double").alias("_at"), salt(0), F.xxhash64(point).alias("_salt"), point.alias("_point"), none(rows).alias("_row"))
    at_rows = rows.select(F.col(score).cast("double").alias("_at"), salt(1), F.xxhash64(row).alias("_salt"), none(points).alias("_point"), row.alias("_row"))
    both = at_points.unionByName(at_rows).repartitionByRange("_at", "_kind", "_salt")
    cut = checkpointed(both.withColumn("_range", F.spark_partition_id()))
    spot = F.struct("_at", "_salt", "_point")
    ends = cut.filter("_kind = 0").groupBy("_range").agg(F.max(spot)["_point"].alias("_last"), F.min(spot)["_point"].alias("_first"))
    ranges = cut.select("_range").distinct().join(ends, "_range", "left")  # a row a range
    w = lambda *o: Window.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.last("_last", True).over(w("_range")).alias("_earlier"), F.last("_first", True).over(w(F.desc("_range"))).alias("_later"))
    here = lambda *o: Window.partitionBy("_range").orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = [F.col(c).desc() for c in ("_at", "_kind", "_salt")]
    met = cut.withColumn("_below", F.last("_point", True).over(here("_at", "_kind", "_salt"))).withColumn("_above", F.last("_point", True).over(here(*down)))
    met = met.filter("_kind = 1").join(F.broadcast(ranges), "_range")
    known = F.col("_at").isNotNull()
    before, after = F.when(known, F.coalesce("_below", "_earlier")), F.when(known, F.coalesce("_above", "_later"))
    return met.select("_row.*", before.alias("before"), after.alias("after"))
