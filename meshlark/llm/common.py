"""What the operators share: the shared work folder, written intermediate tables, and a join that survives hot keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group counts as hot from this share of all rows on, so there are at most 1 / HOT_SHARE hot groups.
HOT_SHARE = 0.001


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary folder; a cluster session is refused, as its
    machines do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="meshlark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/meshlark/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def give_back() -> None:
    """At the end of a task: free memory goes back to the machine, as worker processes outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def hot_from(total: int) -> int:
    return max(2, int(total * HOT_SHARE) + 1)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with groups (one row per key, `size` rows of `rows` each) that keeps hot keys out of the shuffle.

    Groups from HOT_SHARE of `total` rows on are at most 1 / HOT_SHARE, so they are broadcast; the others are
    joined by a shuffle in which no key has more than that share. groups must be narrow (fixed-width columns).
    """
    hot = F.broadcast(groups.filter(F.col(size) >= hot_from(total)))
    cold = groups.filter(F.col(size) < hot_from(total))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


#: Buckets of 32,768 bits in a bitmap filter: 1 MB in all.
FILTER_BUCKETS = 256


def fresh(name: str) -> str:
    """A column name that no table of a caller has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def bitmap_marked(rows: DataFrame, own: list[Column], keys: DataFrame, mark: str) -> DataFrame:
    """rows with a boolean column `mark`: true where the key `own` is among keys (whose columns are the key), and for a
    few keys more, by a bitmap of FILTER_BUCKETS * 4 KB.

    The bitmap has one size at any input, so it may be broadcast, and the plan is the same at any size; rows that it marks
    in vain cost only work, so an exact join has to follow.
    """
    bucket, place, bits = fresh("bucket"), fresh("place"), fresh("bits")

    def hashed(df: DataFrame, cols: list[Column]) -> DataFrame:
        bit = F.pmod(F.xxhash64(*cols), F.lit(FILTER_BUCKETS * 32768))
        return df.withColumn(place, bit).withColumn(bucket, (F.col(place) / 32768).cast("int")).withColumn(place, (F.col(place) % 32768).cast("int"))

    maps = hashed(keys, [F.col(c) for c in keys.columns]).groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(bits))
    is_set = F.expr(f"coalesce(getbit(cast(conv(hex(substring({bits}, {place} div 8 + 1, 1)), 16, 10) as int), {place} % 8) = 1, false)")
    return hashed(rows, own).join(F.broadcast(maps), bucket, "left").withColumn(mark, is_set).drop(bucket, place, bits)


def bitmap_filter(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose key is in wanted, and a few more."""
    mark = fresh("mark")
    return bitmap_marked(rows, [F.col(key)], wanted.select(key), mark).filter(F.col(mark)).drop(mark)


def split_by_keys(rows: DataFrame, own: list[Column], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key `own` is not in keys, rows whose key is); nulls are equal. Rows that the bitmap does not mark are
    not shuffled, whatever they hold."""
    mark, names, theirs = fresh("mark"), [fresh("own") for _ in own], [fresh("key") for _ in own]
    marked = bitmap_marked(rows.withColumns(dict(zip(names, own, strict=True))), [F.col(n) for n in names], keys, mark)
    maybe, keys = marked.filter(F.col(mark)), keys.toDF(*theirs)
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names, theirs, strict=True)])
    out = marked.filter(~F.col(mark)).unionByName(maybe.join(keys, same, "left_anti"))
    return tuple(x.drop(mark, *names) for x in (out, maybe.join(keys, same, "left_semi")))


def once(rows: DataFrame, own: list[Column], again: DataFrame) -> DataFrame:
    """rows with one row of each key `own` that is in again."""
    if again.isEmpty():
        return rows
    rest, several = split_by_keys(rows, own, again)
    keys = [fresh("own") for _ in own]
    return rest.unionByName(several.withColumns(dict(zip(keys, own, strict=True))).dropDuplicates(keys).drop(*keys))


def source_key(c: Column) -> Column:
    """A null-free form of a grouping value: null differs from every text."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?"))
