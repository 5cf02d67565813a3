"""Chat formatting: snapshots of a growing conversation collapse to the longest one before rendering.

Every turn of a conversation gets a rolling prefix hash: two 64-bit hashes, salted with the turn's place, of role and
text, folded over all turns so far. A conversation whose whole hash is a proper prefix hash of a longer one is a
snapshot and goes by an anti join; of equal conversations the smallest conv_id stays.

Defined results: a turn's place is its rank by (turn, role, text); a null role or text differs from an empty one for
the comparison and renders as empty; a row with a null conv_id is a conversation of one turn; repeated rows are turns of
their own; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_hashes(n) -> list[Column]:
    return [F.xxhash64(F.lit(salt), n, F.col("role").isNull(), "role", F.col("text").isNull(), "text") for salt in (11, 29)]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns so far), h1, h2 (prefix hash), last (whether it is the whole conversation)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ranked = turns.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(w))
    salted = turn_hashes(F.col("n"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    folded = ranked.select("conv_id", "n", "turn", "role", "text", salted[0].alias("a"), salted[1].alias("b"))
    return folded.select("conv_id", "n", F.bit_xor("a").over(upto).alias("h1"), F.bit_xor("b").over(upto).alias("h2"), F.lead("n").over(w).isNull().alias("last"))


def single_turns(turns: DataFrame) -> DataFrame:
    """role, text, h1, h2, n_equal: the rows without a conv_id, collapsed where they say the same."""
    h1, h2 = turn_hashes(F.lit(1))
    alone = turns.filter("conv_id IS NULL").groupBy("role", "text").agg(F.count(F.lit(1)).alias("n_equal"))
    return alone.select("role", "text", h1.alias("h1"), h2.alias("h2"), "n_equal")


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations that stay: conv_id, n, h1, h2, n_equal (conversations with just these turns)."""
    p = saved(prefixes(turns.filter("conv_id IS NOT NULL")), "chat-prefixes")
    key = ["n", "h1", "h2"]
    alone = single_turns(turns).select(F.lit(None).cast(p.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).alias("n"), "h1", "h2", "n_equal")
    ended = p.filter("last").select("conv_id", *key, F.lit(1).cast("long").alias("n_equal")).unionByName(alone)
    whole = ended.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.sum("n_equal").alias("n_equal"))
    begun = p.filter("NOT last").select(*key).distinct()
    return whole.join(begun, key, "left_anti")


def render_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal, rendered: every maximal conversation in chat markup, turns in order."""
    stay = saved(maximal(turns).select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_equal", "h1", "h2"), "chat-maximal")
    part = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    said = turns.select("conv_id", "turn", "role", "text", part.alias("part")).join(stay.filter("conv_id IS NOT NULL").drop("h1", "h2"), "conv_id")
    said = said.groupBy("conv_id", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "part"))).alias("parts"))
    out = said.select("conv_id", "n_turns", "n_equal", F.array_join(F.col("parts.part"), "").alias("rendered"))
    alone = single_turns(turns).drop("n_equal").join(stay.filter("conv_id IS NULL AND n_turns = 1"), ["h1", "h2"])
    return out.unionByName(alone.select("conv_id", "n_turns", "n_equal", part.alias("rendered")))
