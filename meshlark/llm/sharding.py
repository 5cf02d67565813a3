"""Sharding by longest processing time: groups of equal texts stay together and go, largest first, to the shard that
has the least so far, kept in a heap (law `bytes`).

All groups pass the heap in the order of their size, and what it sees is bounded at any size of input. Groups from
1 / (shards * PARTS) of all bytes on are items of their own (at most shards * PARTS of them). Of the smaller ones, those
whose sizes agree to one part in 2 ** SPLIT form a class, and the groups of a class, each taken at the class's mean size,
are dealt one after the other by the same rule; the result of that is known from the loads without a step for each group.
There are at most 2 ** SPLIT classes for each doubling of the size. The groups of a class are numbered by digest, in
ranges, so that a class with most of the groups is numbered by many tasks, and each shard takes a run of numbers.

A document's slot is its rank in its shard: the rank within its part of the written table, on top of the counts of the
parts before.

Defined results: a null text counts as empty; a document's size is its UTF-8 bytes plus 16; rows that repeat are
documents of their own; other columns are ignored. A group larger than a fair share makes its shard larger, as groups
are never split.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, saved

OVERHEAD = 16
#: Groups that count as large, for each shard; classes for a doubling of the size, as a power of two; ranges of a class.
PARTS, SPLIT, RANGES = 100, 6, 1024


def take_turns(loads: list[float], size: float, count: int) -> list[int]:
    """How many of `count` equal items each shard gets if each goes to the least loaded (ties: the smallest number)."""
    got, order = [0] * len(loads), sorted(range(len(loads)), key=lambda s: (loads[s], s))
    # the level up to which whole items surely fill the shards, then single steps
    low, high = loads[order[0]], loads[order[0]] + size * count
    for _ in range(60):
        level = (low + high) / 2
        if sum(max(0, int((level - x) / size)) for x in loads) <= count:
            low = level
        else:
            high = level
    surely = [max(0, int((low - x) / size) - 1) for x in loads]
    heap = [(x + size * n, s) for s, (x, n) in enumerate(zip(loads, surely, strict=True))]
    heapq.heapify(heap)
    got = list(surely)
    for _ in range(count - sum(surely)):
        load, s = heap[0]
        got[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    return got


def lpt(large: list[tuple[int, str]], classes: list[tuple[int, int, int]], shards: int) -> tuple[dict[str, int], list[tuple[int, int, int, int]]]:
    """large (size, name) and classes (class, groups, bytes) by falling size -> the shard of each large item, and for
    each class (class, first, end, shard): which of its numbers go where. Ties by name, by shard."""
    loads, place, dealt = [0.0] * shards, {}, []
    items = [(float(size), 1, name) for size, name in large] + [(b / n, n, c) for c, n, b in classes]
    for size, count, what in sorted(items, key=lambda x: (-x[0], str(x[2]))):
        at = 0
        for s, n in enumerate(take_turns(loads, size, count)):
            loads[s] += size * n
            if n and isinstance(what, str):
                place[what] = s
            elif n:
                dealt.append((what, at, at + n, s))
                at += n
    return place, dealt


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")).withColumn("at", F.monotonically_increasing_id())
    rows = saved(rows, "shard-rows").withColumn("part", F.shiftright("at", 33))
    # (steps of a doubling, from the size's own power of two on)
    power = F.floor(F.log2(F.col("bytes").cast("double")))
    cls = (power * (1 << SPLIT) + F.floor((F.col("bytes") / F.pow(F.lit(2.0), power) - 1) * (1 << SPLIT))).cast("long")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    groups = saved(groups.withColumn("cls", cls).withColumn("range", F.pmod(F.xxhash64("digest"), F.lit(RANGES)).cast("int")), "shard-groups")
    total, documents = groups.agg(F.sum("bytes"), F.sum("copies")).first()
    is_large = F.col("bytes") * (shards * PARTS) >= F.lit(total)
    # at most shards * PARTS large groups, 47 * 2 ** SPLIT classes up to 100 TB and shards runs for each of them
    large = groups.filter(is_large).select(F.hex("digest").alias("name"), "bytes").collect()
    small = groups.filter(~is_large)
    classes = small.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    place, dealt = lpt([(r.bytes, r.name) for r in large], [(r.cls, r.n, r.bytes) for r in classes], shards)
    own = spark.createDataFrame([(bytearray.fromhex(k), s) for k, s in place.items()], "digest binary, shard int")
    runs = spark.createDataFrame(dealt, "cls long, first long, end long, shard int")

    sizes = small.groupBy("cls", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cls").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.col("base") + F.row_number().over(Window.partitionBy("cls", "range").orderBy("digest")) - 1
    numbered = small.join(bases, ["cls", "range"]).withColumn("number", number)
    by_class = runs.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("first", "end", "shard"))).alias("runs"))
    shard_of = F.expr("filter(runs, r -> r.first <= number AND number < r.end)[0].shard")
    placed = numbered.join(F.broadcast(by_class), "cls").select("digest", "copies", shard_of.alias("shard"))
    placed = saved(placed.unionByName(groups.select("digest", "copies").join(F.broadcast(own), "digest")), "shard-places")

    rows = join_groups(rows, placed, "digest", "copies", documents or 0)
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")) - 1
    out = rows.withColumn("rank", rank).join(base, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
