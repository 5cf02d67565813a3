"""Conversation prefix trie: every distinct beginning of a conversation is a node, owned by its smallest conversation.

Turns get a place and running prefix digests: four sums of 32 bits each over digests of (place, role, text), so that they
are added within ranges of the order and a conversation of any length is split over many tasks. The smallest conversation
and the number of members of each digest make the nodes. What a conversation owns are its depths from some first one on
(a member set only shrinks with depth), so that depth is found by binary search: each round joins every conversation's
middle digest with the minima. The depths owned by one conversation form a chain, chains hang on chains, and a chain's
totals are summed bottom-up by doubling: in each round a chain gets what lies 1, 2, 4, ... chains below it.

`rebuilt` makes the conversations: the first h turns of conversation c - c % 20, then c's own after its first h.

The digest of the members that end at a node is over one text, in order, and so sequential by its definition: their ids
are sorted by range over the cluster and packed by thousands there; one stream per node then only hashes.

Defined results: turns are ordered by turn (null first), then role, then text; a null role or text is empty; equal rows
are turns of their own; a row without a conv_id belongs to no conversation; an empty table gives no node, not even a root;
sequences are equal if their 128-bit digests are. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import before
from .common import join_groups, saved

#: Conversations in a family, whose first one lends turns; the most it lends is one less than LENT.
FAMILY, LENT = 20, 4
WORDS = r"[^\x20\x09-\x0D]+"
PARTS = ["s0", "s1", "s2", "s3"]
#: Ids of ended conversations in a packed row.
PACKED = 1 << 15


def turn_digest() -> Column:
    return F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def lent(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family, if that has them."""
    return (F.crc32(conv.cast("string").cast("binary")) % LENT).cast("long")


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, words of every turn."""
    own = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    slim = own.select("conv_id", "turn", "role", turn_digest().alias("digest"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"), "text")
    return before(slim, ["turn", "role", "text"], {"place": F.lit(1).cast("long")}, ["conv_id"]).select("conv_id", (F.col("place") + 1).alias("place"), "digest", "words")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, words) of the rebuilt conversations, and conversations (conv_id, n_turns)."""
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    sizes = sizes.withColumn("h", lent(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = saved(convs.select("conv_id", "base", "h", "taken", "n_own", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")), "trie-conversations")
    first = own.filter(F.col("place") < LENT).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").filter("place <= h")
    rest = join_groups(own, convs.select("conv_id", "h", "taken", "n_own"), "conv_id", "n_own", own.count()).filter("place > h")
    columns = ["conv_id", "depth", "digest", "words"]
    turns = first.withColumnRenamed("place", "depth").select(*columns).unionByName(rest.withColumn("depth", F.col("place") - F.col("h") + F.col("taken")).select(*columns))
    return turns, convs.select("conv_id", "n_turns")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, key (digest of the first turns), words (of the last one): from the empty beginning on."""
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    parts = turns.withColumn("mixed", mixed).select("conv_id", "depth", "words", *[F.conv(F.substring("mixed", 8 * i + 1, 8), 16, 10).cast("long").alias(f"own{i}") for i in range(4)])
    sums = before(parts, ["depth"], {c: F.col(f"own{i}") for i, c in enumerate(PARTS)}, ["conv_id"])
    key = F.unhex(F.md5(F.concat_ws(":", "depth", *[F.col(c) + F.col(f"own{i}") for i, c in enumerate(PARTS)])))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.md5(F.lit("root"))).alias("key"), F.lit(0).cast("long").alias("words"))
    return root.unionByName(sums.select("conv_id", "depth", key.alias("key"), "words"))


def owners(convs: DataFrame, paths: DataFrame, minima: DataFrame, depth: str, total: int) -> DataFrame:
    """convs with the owner of each one's beginning of `depth` turns."""
    met = convs.join(paths.select("conv_id", F.col("depth").alias(depth), "key"), ["conv_id", depth])
    return join_groups(met, minima.select("key", "owner", "n_convs"), "key", "n_convs", total).drop("key", "n_convs")


def first_owned(convs: DataFrame, paths: DataFrame, minima: DataFrame, total: int) -> DataFrame:
    """conv_id, n_turns, first: the smallest depth that a conversation owns, n_turns + 1 if none."""
    longest = convs.agg(F.max("n_turns")).first()[0]
    state = convs.withColumns({"lo": F.lit(0).cast("long"), "hi": F.col("n_turns") + 1})
    for _ in range(math.ceil(math.log2(longest + 2)) if longest is not None else 0):
        found = owners(state.filter("lo < hi").withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2)), paths, minima, "mid", total)
        owns = F.col("owner") == F.col("conv_id")
        found = found.withColumns({"lo": F.when(owns, F.col("lo")).otherwise(F.col("mid") + 1), "hi": F.when(owns, F.col("mid")).otherwise(F.col("hi"))})
        state = saved(state.filter("lo >= hi").unionByName(found.select(*state.columns)), "trie-search")
    return state.select("conv_id", "n_turns", F.col("lo").alias("first"))


def chain_totals(chains: DataFrame, sums: list[str]) -> DataFrame:
    """chains(conv_id, above, sums...), above null at the top -> conv_id, and each sum over the chain and all below it."""
    state = saved(chains.select("conv_id", "above", *sums), "trie-chains")
    total = state.count()
    while not state.filter("above IS NOT NULL").isEmpty():
        below = state.filter("above IS NOT NULL").groupBy("above").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"{c}_below") for c in sums])
        below = saved(below.join(state.select(F.col("conv_id").alias("above"), F.col("above").alias("up")), "above"), "trie-below")
        given = below.select(F.col("above").alias("conv_id"), *[f"{c}_below" for c in sums])
        grown = state.join(given, "conv_id", "left").select("conv_id", "above", *[(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums])
        moved = join_groups(grown.filter("above IS NOT NULL"), below.select("above", "up", "n"), "above", "n", total).select("conv_id", F.col("up").alias("above"), *sums)
        state = saved(grown.filter("above IS NULL").unionByName(moved), "trie-chains")
    return state.drop("above")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """ends(key, conv_id) -> key, ends_sha256: of the decimal ids in ascending order, comma-joined."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at] or i - at == PACKED:
                    out.append({"key": keys[at], "least": ids[at], "ids": pa.compress(",".join(map(str, ids[at:i])).encode(), "zstd", asbytes=True), "size": sum(map(len, map(str, ids[at:i]))) + i - at - 1})
                    at = i
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.binary()), ("least", pa.int64()), ("ids", pa.binary()), ("size", pa.int64())]))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, last, state = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]), None, hashlib.sha256()
        for batch in batches:
            done: list[dict] = []
            for key, ids, size in zip(*(batch.column(c) for c in ("key", "ids", "size")), strict=True):
                data = pa.decompress(ids.as_py(), size.as_py(), "zstd", asbytes=True)
                if key.as_py() == last:
                    state.update(b",")
                else:
                    if last is not None:
                        done.append({"key": last, "ends_sha256": state.hexdigest()})
                    last, state = key.as_py(), hashlib.sha256()
                state.update(data)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"key": last, "ends_sha256": state.hexdigest()}], schema=schema)

    ranges = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    packed = ranges.mapInArrow(pack, "key binary, least long, ids binary, size long")
    return packed.repartition("key").sortWithinPartitions("key", "least").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    said, convs = rebuilt(saved(placed(turns), "trie-turns"))
    paths = saved(prefixes(said, convs), "trie-paths")
    minima = saved(paths.groupBy("key", "depth").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "trie-nodes")
    total = paths.count()
    firsts = saved(first_owned(convs, paths, minima, total), "trie-first")

    tops = firsts.filter("first <= n_turns").withColumn("under", F.col("first") - 1)
    hung = owners(tops.filter("under >= 0"), paths, minima, "under", total).withColumnRenamed("owner", "above")
    tops = saved(tops.filter("under < 0").withColumn("above", F.lit(None).cast("long")).unionByName(hung.select(*tops.columns, "above")), "trie-tops")

    # a node's own share of its chain, before the chains that hang on it
    chain = tops.select(F.col("conv_id").alias("owner"), "first", "n_turns", "above", (F.col("n_turns") - F.col("first") + 1).alias("size"))
    nodes = join_groups(minima, chain, "owner", "size", minima.count())
    hangers = tops.filter("above IS NOT NULL").groupBy(F.col("above").alias("owner"), F.col("under").alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    nodes = nodes.join(hangers, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("n_turns")).cast("long"))
    nodes = saved(nodes.select("key", "owner", "depth", F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("above")).alias("parent"), "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("spared")), "trie-shares")

    # whole chains bottom-up, then each node of a chain from its end
    sums = ["leaf", "spared"]
    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(*[F.sum(c).alias(c) for c in sums])
    totals = chain_totals(own.join(tops.select("conv_id", "above"), "conv_id"), sums)
    brought = tops.filter("above IS NOT NULL").join(totals, "conv_id").groupBy(F.col("above").alias("owner"), F.col("under").alias("depth")).agg(*[F.sum(c).alias(f"{c}_hung") for c in sums])
    shares = nodes.join(brought, ["owner", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_hung", F.lit(0)) for c in sums}).drop(*[f"{c}_hung" for c in sums])
    whole = before(shares, [F.col("depth").desc()], {f"{c}_after": F.col(c) for c in sums}, ["owner"])

    ended = paths.withColumnRenamed("depth", "n_turns").join(convs, ["conv_id", "n_turns"]).select("key", "conv_id")
    out = whole.join(ends_hashes(ended), "key", "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaf") + F.col("leaf_after")).alias("n_leaves"),
        (F.col("spared") + F.col("spared_after")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
