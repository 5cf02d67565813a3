"""Mixing sources to target weights by temperature (native).

Source token shares p become weights p^a / sum(p^a). The exponent a is bisected in [0, 1]: to the flattest mixture
that repeats no source more than `max_repetition` times as often as the budget allows, or to the steepest that
reaches `min_entropy` (in nats). The weights are realised as a budgeted run of blocks: every source is dealt in
epochs, each a fresh permutation of all its documents, until its quota of tokens is met; a document's place in its
source's run gives its block, so each block holds the sources in their weights, and a block is permuted again.
Without a budget, the smallest one is taken under which every source is seen whole at least once (repetitions are
then counted against the least repeated source).

Places are running sums over a permutation: within 4096 ranges of the permutation key, on top of the ranges' sums, so
a source with most of the rows is spread over that many tasks.

Defined results: tokens are the words between blanks plus 1 (an end mark), so null and empty texts weigh 1; a null
source is a source; rows that repeat doc_id, source and token count move together (`copies`); other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_groups, saved, source_key

STEPS, SECTIONS = 60, 16


def token_count(text: Column) -> Column:
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r]+")) + F.lit(1)).cast("long")


def exponent(totals: DataFrame, total: int, least: int, most: int, max_repetition: float | None, min_entropy: float | None, budget: int | None) -> float:
    """The bisected exponent. Without a budget, repetition is ruled by the largest and the smallest source alone, and the
    bisection is one expression; else each pass over the sources tries SECTIONS exponents at once."""
    if max_repetition is not None and budget is None:
        step = f"if(pow({most} / cast({least} as double), 1e0 - (b.lo + b.hi) / 2e0) <= {float(max_repetition)!r}D, named_struct('lo', b.lo, 'hi', (b.lo + b.hi) / 2e0), named_struct('lo', (b.lo + b.hi) / 2e0, 'hi', b.hi))"
        return totals.sparkSession.range(1).select(F.expr(f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0e0, 'hi', 1e0), (b, i) -> {step}).hi")).first()[0]
    lo, hi = 0.0, 1.0
    p = F.col("t") / F.lit(float(total))
    while True:
        tried = [lo + (hi - lo) * i / SECTIONS for i in range(1, SECTIONS)]
        tried = [a for a in tried if lo < a < hi]
        if not tried:
            return hi if max_repetition is not None else lo
        z = lambda a: F.sum(F.pow(p, F.lit(a)))
        if max_repetition is not None:
            enough = [F.pow(F.lit(least / total), F.lit(a - 1)) / z(a) * F.lit(budget / total) <= F.lit(float(max_repetition)) for a in tried]
        else:
            enough = [F.log(z(a)) - F.lit(a) * F.sum(F.pow(p, F.lit(a)) * F.log(p)) / z(a) < F.lit(float(min_entropy)) for a in tried]
        # the exponents that are enough are the upper ones: of a repetition limit the least of them, of an entropy the one below
        row = totals.agg(*[e.alias(f"e{i}") for i, e in enumerate(enough)]).first()
        first = next((i for i in range(len(tried)) if row[i]), len(tried))
        lo, hi = ([lo, *tried][first], [*tried, hi][first])


def source_weights(totals: DataFrame, max_repetition: float | None = 1.5, min_entropy: float | None = None, budget: int | None = None, block_tokens: int = 65536) -> DataFrame:
    """totals(s, t: tokens, ...) -> with weight, alpha, quota, n_blocks: one row per source, however many there are."""
    if (max_repetition is None) == (min_entropy is None):
        raise ValueError("give either max_repetition or min_entropy")
    one = totals.agg(F.sum("t").alias("total"), F.min("t").alias("least"), F.max("t").alias("most")).first()
    total = one["total"] or 1
    alpha = exponent(totals, total, one["least"], one["most"], max_repetition, min_entropy, budget) if one["total"] else 1.0
    power = F.pow(F.col("t") / F.lit(float(total)), F.lit(alpha))
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    spent = float(budget) if budget is not None else (totals.agg(F.max(F.col("t") * F.lit(z) / power)).first()[0] or 0.0)
    weight = power / F.lit(z)
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(spent) / block_tokens)).cast("long")
    return totals.withColumns({"weight": weight, "alpha": F.lit(alpha), "quota": F.round(weight * F.lit(spent)).cast("long"), "n_blocks": blocks})


def permuted(seed: int, epoch: Column, doc_id: Column, tokens: Column, s: Column) -> Column:
    """The key that orders a source's documents in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(doc_id.cast("string"), F.lit("-")), tokens, s))


#: The last epoch that a source's quota reaches into.
LAST_EPOCH = "greatest(0L, cast(ceil(quota / t) as bigint) - 1)"


def weighed(docs: DataFrame, block_tokens: int, **limits) -> tuple[DataFrame, DataFrame, int]:
    """(units: documents of equal doc_id, source and tokens; sources with their weights and rows; rows of units)."""
    units = docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens"))
    units = saved(units.groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).alias("copies")).withColumn("s", source_key(F.col("source"))), "mix-units")
    totals = saved(units.groupBy("s").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("docs")), "mix-totals")
    return units, saved(source_weights(totals, block_tokens=block_tokens, **limits), "mix-weights"), totals.agg(F.sum("rows")).first()[0] or 0


def runs(units: DataFrame, weights: DataFrame, total: int, epochs: str, seed: int) -> DataFrame:
    """Units in the given epochs of their source's run, with key and start (tokens before it)."""
    dealt = join_groups(units, weights, "s", "rows", total).withColumn("epoch", F.explode(F.expr(epochs)))
    dealt = dealt.withColumn("key", permuted(seed, F.col("epoch"), F.col("doc_id"), F.col("tokens"), F.col("s"))).withColumn("range", F.substring("key", 1, 3))
    mass = F.col("tokens") * F.col("copies")
    before = Window.partitionBy("s", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("s", "epoch", "range").agg(F.sum(mass).alias("m")).withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    within = Window.partitionBy("s", "epoch", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(ranges, ["s", "epoch", "range"]).withColumn("start", F.col("epoch") * F.col("t") + F.col("base") + F.coalesce(F.sum(mass).over(within), F.lit(0)))


def mix(docs: DataFrame, max_repetition: float | None = 1.5, min_entropy: float | None = None, budget: int | None = None, block_tokens: int = 65536, seed: int = 0) -> DataFrame:
    """One row per dealt document: doc_id, source, epoch, tokens, copies, weight, alpha, block_id, slot."""
    units, weights, total = weighed(docs, block_tokens, max_repetition=max_repetition, min_entropy=min_entropy, budget=budget)
    placed = runs(units, weights, total, f"sequence(0L, {LAST_EPOCH})", seed)
    placed = placed.filter(F.col("start") < F.col("quota")).withColumn("block_id", F.least(F.col("n_blocks") - 1, F.floor(F.col("start") / F.col("quota") * F.col("n_blocks"))).cast("long"))
    in_block = Window.partitionBy("block_id").orderBy(F.md5(F.concat(F.lit("b"), F.col("key"))), "s", "doc_id")
    return placed.select("doc_id", "source", "epoch", (F.col("tokens") * F.col("copies")).alias("tokens"), "copies", "weight", "alpha", "block_id", (F.row_number().over(in_block) - 1).cast("long").alias("slot"))


def mixed_documents(docs: DataFrame, max_repetition: float | None = 1.5, min_entropy: float | None = None, budget: int | None = None, block_tokens: int = 65536, seed: int = 0) -> DataFrame:
    """The mixture as documents: rows of docs, repeated as often as `mix` deals them, with all their columns.

    A source's quota holds whole epochs and the first documents of one more, so a document needs only its own key and the
    key at which its source's last epoch breaks off: texts are not shuffled but for sources under a thousandth of all rows.
    """
    units, weights, total = weighed(docs, block_tokens, max_repetition=max_repetition, min_entropy=min_entropy, budget=budget)
    last = runs(units, weights, total, f"array({LAST_EPOCH})", seed)
    ends = last.filter("start >= quota").groupBy("s").agg(F.min("key").alias("end"))
    s, whole, end, rows, times = (fresh(n) for n in ("s", "whole", "end", "rows", "times"))
    plan = saved(weights.join(ends, "s", "left").select(F.col("s").alias(s), F.expr(LAST_EPOCH).alias(whole), F.col("end").alias(end), F.col("docs").alias(rows)), "mix-plan")
    dealt = join_groups(docs.withColumn(s, source_key(F.col("source"))), plan, s, rows, plan.agg(F.sum(rows)).first()[0] or 0)
    key = permuted(seed, F.col(whole), F.col("doc_id"), token_count(F.col("text")), F.col(s))
    dealt = dealt.withColumn(times, F.col(whole) + F.when(F.col(end).isNull() | (key < F.col(end)), 1).otherwise(0)).filter(F.col(times) > 0)
    return dealt.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
