"""Exact deduplication through a stateful stream (native).

Documents arrive as (identifier, SHA-256 digest, locator) rows. A streaming aggregation holds one state row per
digest in a disk-backed RocksDB store, without expiry: the identifier that stays, where its content lies (the file it
was read from), and how often the digest came. A hit (a digest that came more than once) is checked on full bytes: rows
that share a digest are grouped by their whole text, which collapses copies before the shuffle. Should two texts share a
digest, their rows are grouped by the text itself.

With `state_dir` the state outlives the call: a later call on other documents goes on from it, and a hit on a digest of
an earlier call is checked on the bytes at that call's locators, so documents of such calls must be read from files that
stay. Its rows are those of the later call; keep_id and group_size count all calls. A call is named by its documents: one
that failed at any point and is repeated with the same documents counts them once, and so does one that had ended. The
stream writes what each micro-batch changed; a batch that is run again replaces what it wrote.

Defined results: a null text counts as empty; texts are compared as they are; of equal texts the largest doc_id
stays (null is smallest); rows that repeat doc_id and text all carry that doc_id as keep_id and are all `kept`
(``drop_copies`` then leaves one of them); other columns are ignored by ``exact_groups`` and passed on by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_filter, fresh, join_groups, new_path, once, saved, split_by_keys

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def arrived(docs: DataFrame, folder: str) -> str:
    """The folder of this call's arrivals, written unless a call with the same rows has done so."""
    spark = docs.sparkSession
    staged = f"{folder}/staging/{fresh('call')[2:]}"
    docs.write.parquet(staged)
    written = spark.read.schema(docs.schema).parquet(staged)
    # sums of two 32-bit halves of a hash of each row, in any order
    row = F.xxhash64("doc_id", "digest")
    name = "-".join(str(x) for x in written.agg(F.count(F.lit(1)), F.coalesce(F.sum(row.bitwiseAND(0xFFFFFFFF)), F.lit(0)), F.coalesce(F.sum(F.shiftrightunsigned(row, 32)), F.lit(0))).first())
    path, jvm = f"{folder}/arrivals/{name}", spark.sparkContext._jvm
    if not exists(spark, path):
        of = jvm.org.apache.hadoop.fs.Path
        fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(of(f"{folder}/arrivals"))
        fs.rename(of(staged), of(path))
    return path


def keyed_state(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Run what is new in the folder's arrivals through its stream; the state table (digest, keep_id, locator,
    group_size) afterwards."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(f"{folder}/arrivals").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.max_by("locator", "doc_id").alias("locator"), F.count(F.lit(1)).alias("group_size"))
    out, before = f"{folder}/state", {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/stream")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    if not exists(spark, out):
        return spark.createDataFrame([], fields)
    changes = spark.read.schema(f"{fields}, batch int").parquet(out)
    if not exists(spark, f"{out}/batch=1"):
        return changes.drop("batch")
    return changes.groupBy("digest").agg(*[F.max_by(c, "batch").alias(c) for c in ("keep_id", "locator", "group_size")])


def earlier_texts(spark: SparkSession, before: DataFrame, hits: DataFrame) -> DataFrame | None:
    """doc_id, text of earlier calls' documents whose digest came again, read from the files that hold them."""
    seen = before.join(hits.select("digest").distinct(), "digest", "left_semi")
    files = [r.locator for r in seen.select("locator").distinct().collect()]  # names of files, as a scan has them
    if not files:
        return None
    if not all(files):
        raise ValueError("documents of an earlier call were not read from files: their bytes cannot be checked")
    return spark.read.parquet(*files).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, state_dir: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, locator of the copy that stays (null if
    digests clash)."""
    spark = docs.sparkSession
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    folder = state_dir.rstrip("/") if state_dir else new_path(spark, "dedup")
    arrivals = read.select("doc_id", "digest", sha256(F.col("text")).alias("sha"), F.input_file_name().alias("locator"))
    schema, path = arrivals.schema, arrived(arrivals, folder)
    arrivals = spark.read.schema(schema).parquet(path)
    before = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/arrivals").filter(~F.col("_metadata.file_path").contains(path.rsplit("/", 1)[1])) if state_dir else None
    state = keyed_state(spark, folder, schema, files_per_batch)
    total = state.agg(F.sum("group_size")).first()[0] or 0
    rows = arrivals.select("doc_id", "digest", "sha")

    # full bytes on hits: copies of a text collapse before the shuffle, so no task gets all of them
    repeated = state.filter("group_size > 1")
    checked = bitmap_filter(read, repeated, "digest")
    old = earlier_texts(spark, before, repeated.join(rows.select("digest").distinct(), "digest", "left_semi")) if before is not None else None
    if old is not None:
        checked = checked.unionByName(bitmap_filter(old.withColumn("digest", digest(F.col("text"))), repeated, "digest"))
    texts = checked.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clashes = saved(texts.groupBy("digest").count().filter("count > 1").select("digest"), "dedup-clashes")

    out = join_groups(rows, state, "digest", "group_size", total)
    if not clashes.isEmpty():
        apart = read.join(clashes, "digest", "left_semi").select("doc_id", "text", sha256(F.col("text")).alias("sha"))
        by_text = texts.join(clashes, "digest", "left_semi").select("text", "keep_id", "group_size", F.lit(None).cast("string").alias("locator"))
        out = out.join(clashes, "digest", "left_anti").drop("digest").unionByName(apart.join(by_text, "text").drop("text"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "locator")


def drop_copies(docs: DataFrame, **params) -> DataFrame:
    """docs without exact copies, with all its columns."""
    groups = saved(exact_groups(docs, **params).select("doc_id", F.unhex("text_sha256").alias("sha"), "kept"), "dedup-groups")
    own = [F.col("doc_id"), sha256(F.coalesce("text", F.lit("")))]
    out, _ = split_by_keys(docs, own, groups.filter("NOT kept").select("doc_id", "sha").distinct())
    again = saved(groups.filter("kept").groupBy("doc_id", "sha").count().filter("count > 1").drop("count"), "dedup-again")
    return once(out, own, again)
