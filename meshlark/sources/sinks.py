"""Writers that publish only what is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import versions


def require(df: DataFrame, least: int) -> DataFrame:
    """df, or an error if it has fewer rows (it looks at no more than that many)."""
    if (n := df.limit(least).count()) < least:
        raise ValueError(f"{n} rows, at least {least} are expected")
    return df


def publish(df: DataFrame, path: str, violations: DataFrame | None = None, fmt: str = "parquet") -> bool:
    """Write df as the table's next state, unless a violation is an error. The old state stays until the new one is written
    and named (versions.read_table reads it), so a failure between any two steps leaves a whole table."""
    if violations is not None and not violations.filter("severity = 'error'").isEmpty():
        return False
    versions.point(df.sparkSession, path, {"parts": [versions.add_part(df, path, fmt)]})
    return True


def json_array(df: DataFrame, order: list) -> DataFrame:
    """One row with a JSON array of all rows in order, null keys left out (for small artifacts)."""
    item = F.struct(F.struct(*order).alias("o"), F.to_json(F.struct(*df.columns)).alias("j"))
    return df.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]), ",\n "), F.lit("]")).alias("value"))


def signals_sink(df: DataFrame, path: str) -> None:
    df.orderBy(F.desc("observed_at"), F.desc("node_id")).coalesce(1).write.mode("overwrite").json(path)


def compact_json(df: DataFrame, cols: list[str]) -> Column:
    """JSON of some columns where null and false are left out but 0.0 is kept."""
    kinds = dict(df.dtypes)
    return F.to_json(F.struct(*[F.when(F.col(c), F.col(c)).alias(c) if kinds[c] == "boolean" else F.col(c) for c in cols]))


def compact(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(compact_json(df, cols).alias("value"))


def csv_cache(df: DataFrame, path: str) -> DataFrame:
    """df as CSV files with a header, read again with its own types."""
    df.write.mode("overwrite").csv(path, header=True)
    return df.sparkSession.read.schema(df.schema).csv(path, header=True)


def nested_ranking(df: DataFrame, group: str, score: str, tie: str, cols: list[str]) -> DataFrame:
    """One row per group with its rows as an array, best first."""
    item = F.struct((-F.col(score)).alias("_s"), F.col(tie).alias("_t"), F.struct(*cols).alias("r"))
    return df.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("a")).select(group, F.col("a.r").alias("ranked"))
