"""An append-only hash chain: every row's hash covers the row before and the row's own content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.canonical import canonical_json, json_string
from .graph import checkpointed

GENESIS = "0" * 64


def body_parts(ts: Column, run_id: Column, actor: Column, kind: Column, payload: Column) -> tuple[Column, Column]:
    """The canonical text before and behind the number of the row: JSON with its keys in alphabetical order; payload is
    canonical JSON itself, nulls are written."""
    text = lambda c: F.coalesce(json_string(c), F.lit("null"))
    before = F.concat(F.lit('{"actor":'), text(actor), F.lit(',"kind":'), text(kind), F.lit(',"payload":'), payload, F.lit(',"run_id":'), text(run_id), F.lit(',"seq":'))
    return before, F.concat(F.lit(',"ts":'), text(ts), F.lit("}"))


def body(seq: Column, ts: Column, run_id: Column, actor: Column, kind: Column, payload: Column) -> Column:
    """The canonical text of a row."""
    before, behind = body_parts(ts, run_id, actor, kind, payload)
    return F.concat(before, F.coalesce(seq.cast("string"), F.lit("null")), behind)


FIELDS = ["ts", "run_id", "actor", "kind", "payload"]


def chain_append(rows: DataFrame, order: list[str], by: str | None = None, start: int = 0, head: str = GENESIS, log: DataFrame | None = None) -> DataFrame:
    """rows(ts, run_id, actor, kind, payload) -> with seq, prev_hash, hash; one chain per `by`, after `head`, or after the
    last row of the chain in `log`.

    payload may be text, a struct, a map or an array. A chain is sequential by its definition, so one task goes through
    its sorted rows; it holds the chain's last hash and number and nothing else, whatever the chain's length.
    """
    held = rows.schema["payload"].dataType
    before, behind = body_parts(*[F.col(c) for c in FIELDS[:-1]], canonical_json(F.col("payload"), held))
    chain = F.col(by) if by else F.lit(0)
    places = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order)]
    new = rows.select(chain.alias("_chain"), *places, *FIELDS, before.alias("_before"), behind.alias("_behind"), F.lit(None).cast("long").alias("_seq"), F.lit(None).cast("string").alias("_hash"))
    if log is not None:
        # a chain's last row comes before its new ones
        last = log.filter("hash IS NOT NULL").groupBy((F.col(by) if by else F.lit(0)).alias("_chain")).agg(F.max(F.struct("seq", "hash")).alias("l"))
        new = last.select("_chain", F.col("l.seq").alias("_seq"), F.col("l.hash").alias("_hash")).unionByName(new, allowMissingColumns=True).select(*new.columns)
    ordered = new.repartition("_chain").sortWithinPartitions("_chain", F.col("_hash").isNull(), *[f"_order{i}" for i in range(len(order))], *FIELDS[:-1], "_before")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, seq = (), head, start
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("_chain", "_before", "_behind", "_seq", "_hash"))
            for key, first, rest, stored, known in zip(*columns, strict=True):
                if now != (key,):
                    now, last, seq = (key,), head, start
                if known is not None:
                    last, seq = known, stored + 1
                    out.append((None, None, None))
                    continue
                mine = hashlib.sha256(f"{last}{first}{seq}{rest}".encode()).hexdigest()
                out.append((seq, last, mine))
                last, seq = mine, seq + 1
            kept = batch.drop_columns([c for c in batch.schema.names if c.startswith("_order") or c in ("_before", "_behind", "_seq", "_hash")])
            for name, values, kind in zip(("seq", "prev_hash", "hash"), zip(*out, strict=True) if out else ((),) * 3, (pa.int64(), pa.string(), pa.string()), strict=True):
                kept = kept.append_column(name, pa.array(values, kind))
            yield kept

    fields = [new.schema["_chain"], *[new.schema[c] for c in FIELDS], StructField("seq", LongType()), StructField("prev_hash", StringType()), StructField("hash", StringType())]
    out = ordered.mapInArrow(link, StructType([StructField(f.name, f.dataType) for f in fields])).filter(F.col("hash").isNotNull()).select("_chain", "seq", *FIELDS, "prev_hash", "hash")
    return out.withColumnRenamed("_chain", by) if by else out.drop("_chain")


def chain_verify(log: DataFrame, by: str | None = None) -> DataFrame:
    """One row per chain: ok, finding (the first), line, count, head.

    Lines are checked apart, each against the one before, within ranges of (chain, line): a range begins where the one
    before it ended, and of that only the borders of chains that go on (two rows for each range at most) are gathered.
    """
    chain = [by] if by else ["_one"]
    d = log if by else log.withColumn("_one", F.lit(0))
    d = d if "line" in log.columns else d.withColumn("line", F.col("seq"))
    again = F.sha2(F.concat("prev_hash", body(*[F.col(c) for c in ("seq", "ts", "run_id", "actor", "kind")], canonical_json(F.col("payload"), log.schema["payload"].dataType))), 256)
    slim = d.select(*chain, "line", "seq", "prev_hash", "hash", again.alias("_again"))
    cut = checkpointed(slim.repartitionByRange(*chain, "line").withColumn("_range", F.spark_partition_id()))
    parts = cut.groupBy(*chain, "_range").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("line", "hash"))["hash"].alias("last"))
    split = parts.groupBy(*chain).agg(F.sort_array(F.collect_list(F.struct("_range", "n", "last"))).alias("p")).filter(F.size("p") > 1)
    # of a chain that goes on: the last hash before each range, and how many lines lie before it
    ahead = F.expr("transform(sequence(1, size(p) - 1), i -> struct(p[i]._range as r, p[i - 1].last as was, aggregate(slice(p, 1, i), 0L, (a, x) -> a + x.n) as base))")
    borders = split.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(chain)], F.explode(ahead).alias("b")).select("*", "b.*").drop("b")
    same = (F.col("_range") == F.col("r")) & F.col(chain[0]).eqNullSafe(F.col("_c0"))
    w = Window.partitionBy("_range", *chain).orderBy("line")
    d = cut.withColumn("_lag", F.lag("hash").over(w)).withColumn("_rn", F.row_number().over(w)).join(F.broadcast(borders), same, "left")
    d = d.withColumn("_prev", F.when(F.col("_rn") > 1, F.col("_lag")).otherwise(F.coalesce("was", F.lit(GENESIS)))).withColumn("_n", F.col("_rn") - 1 + F.coalesce("base", F.lit(0)))
    bad = F.when(F.col("hash").isNull(), "not readable").when(~F.col("prev_hash").eqNullSafe(F.col("_prev")), "removed, reordered, or inserted").when(F.col("_again") != F.col("hash"), "modified").when(F.col("seq") != F.col("_n"), "sequence gap")
    d = d.withColumn("_bad", bad)
    first = F.min(F.when(F.col("_bad").isNotNull(), F.struct("line", "_bad")))
    g = d.groupBy(*chain).agg(first.alias("f"), F.count(F.lit(1)).alias("rows"), F.max(F.struct("line", "hash"))["hash"].alias("head"))
    return g.select(*([by] if by else []), F.col("f").isNull().alias("ok"), F.coalesce("f._bad", F.lit("intact")).alias("finding"), F.col("f.line").alias("line"), "rows", "head")


def runs(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("begun"), F.max("ts").alias("ended"), F.count_if(F.col("kind") == "step").alias("steps"), F.bool_or(F.col("kind") == "run_end").alias("finished")).orderBy("run_id")


def exported(log: DataFrame, by: str) -> DataFrame:
    """The roll-up of each chain's run: what `runs` tells, with ok, finding and head of its verification."""
    told = runs(log.withColumn("run_id", F.col(by).cast("string"))).withColumnRenamed("run_id", "_run")
    checked = chain_verify(log, by).select(F.col(by), "ok", "finding", "head")
    return checked.join(told, F.col(by).cast("string") == F.col("_run")).drop("_run")
