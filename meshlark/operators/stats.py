"""Statistics of rankings, calibration and small models.

Rankings need a global order: they run within ranges of it (`order.before`), over a whole table and within `by` alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import wilson
from .graph import checkpointed
from .order import before, bracketed, counted


def hhi(df: DataFrame, group, part: str, weight: Column | None = None) -> DataFrame:
    """Sum of squared shares of the parts of each group."""
    group = [group] if isinstance(group, str) else list(group)
    n = df.groupBy(*group, part).agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).cast("double").alias("_n"))
    # sum n^2 / (sum n)^2: two sums, no window over the group
    return n.groupBy(*group).agg((F.sum(F.col("_n") * F.col("_n")) / (F.sum("_n") * F.sum("_n"))).alias("hhi"), F.count(F.lit(1)).alias("parts"), F.sum("_n").alias("total"))


def upper_median(df: DataFrame, group, value: str, min_n: int = 2) -> DataFrame:
    """The value at place n div 2 of the sorted values (the upper of the two middle ones)."""
    group = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*group)
    ranked = df.filter(F.col(value).isNotNull()).select(*group, value, F.row_number().over(w.orderBy(value)).alias("_rn"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.filter((F.col("n") >= min_n) & (F.col("_rn") == F.floor(F.col("n") / 2) + 1)).select(*group, "n", F.col(value).alias("median"))


def midranks(df: DataFrame, score: str, by=()) -> DataFrame:
    """(by, score, n, pos, midrank) per distinct score; label counts from `_label` in pos."""
    g = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("pos"))
    return before(g, [score], {"_b": F.col("n")}, by).select(*by, score, "n", "pos", (F.col("_b") + (F.col("n") + 1) / F.lit(2.0)).alias("midrank"))


def auc(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    """Rank AUC with half credit for ties; null if a class is empty."""
    m = midranks(df.withColumn("_label", F.col(label).cast("int")), score, by)
    agg = m.groupBy(*by).agg(F.sum(F.col("pos") * F.col("midrank")).alias("r"), F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"))
    value = F.try_divide(F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / F.lit(2.0), F.nullif((F.col("n_pos") * F.col("n_neg")).cast("double"), F.lit(0.0)))
    return agg.select(*by, "n_pos", "n_neg", value.alias("auc"))


def permutation_p(df: DataFrame, score: str, label: str, id_col: str, n: int = 300, shuffle: Column | None = None, span: tuple[float, float] = (-(2.0**63), 2.0**63), seed: int = 7) -> DataFrame:
    """(auc, hits, p): two-sided on |AUC - 0.5|, p = (hits + 1) / (n + 1).

    The scores stay, so their mid-ranks do; each repetition draws as many positives as there are by the smallest values
    of a pseudo-random numeric key (`shuffle`, of `id_col` and rep), ties by id. The keys are counted in 256 ranges of
    `span`; ranges that are drawn whole give their sums, and only the range that holds the last one drawn is sorted. Keys
    outside the span fall into its end ranges, which stays right and only sorts more.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(score).alias("s"), F.col(label).cast("int").alias("_label"))
    ranks = checkpointed(base.join(midranks(base, "s").select("s", "midrank"), "s").select("id", "midrank", "_label"))
    totals = ranks.agg(F.sum("_label").alias("np"), F.count(F.lit(1)).alias("n"), F.sum(F.col("_label") * F.col("midrank")).alias("r"))
    key = shuffle if shuffle is not None else F.xxhash64(F.lit(seed), "rep", "id")
    reps = ranks.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_k", key)
    share = (F.col("_k").cast("double") - F.lit(span[0])) / F.lit(span[1] - span[0])
    reps = reps.select("rep", "id", "midrank", "_k", F.floor(F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))) * 255).cast("int").alias("_h"))
    w = Window.partitionBy("rep").orderBy("_h")
    hist = reps.groupBy("rep", "_h").agg(F.count(F.lit(1)).alias("c"), F.sum("midrank").alias("m")).withColumn("upto", F.sum("c").over(w)).join(F.broadcast(totals.select("np")))
    hist = checkpointed(hist.withColumn("need", F.col("np") - F.col("upto") + F.col("c")))
    last = hist.filter("need > 0 AND upto > np").select("rep", "_h", "need")  # at most one a repetition
    cut = reps.join(F.broadcast(last), ["rep", "_h"]).withColumn("_rn", F.row_number().over(Window.partitionBy("rep").orderBy("_k", "id"))).filter("_rn <= need")
    drawn = hist.filter("upto <= np").select("rep", F.col("m")).unionByName(cut.select("rep", F.col("midrank").alias("m")))
    u = lambda r: (r - F.col("np") * (F.col("np") + 1) / F.lit(2.0)) / (F.col("np") * (F.col("n") - F.col("np")))
    each = drawn.groupBy("rep").agg(F.sum("m").alias("rr")).join(F.broadcast(totals))
    each = each.select(F.abs(u(F.col("rr")) - 0.5).alias("d"), u(F.col("r")).alias("auc"))
    return each.groupBy("auc").agg(F.count_if(F.col("d") >= F.abs(F.col("auc") - 0.5) - 1e-12).alias("hits"), F.count(F.lit(1)).alias("reps")).select("auc", "hits", ((F.col("hits") + 1) / (F.col("reps") + 1)).alias("p"))


def ranked(df: DataFrame, score: str, id_col: str, by=()) -> DataFrame:
    return before(df, [F.desc(score), id_col], {"_rank": F.lit(1).cast("long")}, by).withColumn("_rank", F.col("_rank") + 1)


def average_precision(df: DataFrame, score: str, label: str, id_col: str, by=()) -> DataFrame:
    y = F.coalesce(F.col(label).cast("long"), F.lit(0))
    r = before(df, [F.desc(score), id_col], {"_rank": F.lit(1).cast("long"), "_tp": y}, by)
    return r.groupBy(*by).agg(F.try_divide(F.sum(F.when(y == 1, (F.col("_tp") + 1) / (F.col("_rank") + 1))), F.sum(F.col(label).cast("double"))).alias("average_precision"))


def precision_at(df: DataFrame, score: str, label: str, id_col: str, ks) -> DataFrame:
    r = ranked(df, score, id_col).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    y = F.col(label).cast("int")
    return r.groupBy("k").agg((F.sum(F.when(F.col("_rank") <= F.col("k"), y).otherwise(0)) / F.col("k")).alias("precision"), F.try_divide(F.sum(F.when(F.col("_rank") <= F.col("k"), y).otherwise(0)).cast("double"), F.sum(y).cast("double")).alias("recall"))


def equal_buckets(df: DataFrame, order: list[Column], n: int, by=()) -> DataFrame:
    """Buckets of equal size floor(count / n), what is over in the last."""
    placed = counted(before(df, order, {"_before": F.lit(1).cast("long")}, by), "_total", by)
    bucket = F.least(F.floor(F.col("_before") / F.greatest(F.lit(1), F.floor(F.col("_total") / n))), F.lit(n - 1)).cast("int")
    return placed.select(*df.columns, bucket.alias("bucket"))


def reliability(df: DataFrame, score: str, label: str, edges) -> DataFrame:
    """Fixed bands [edge, next): rows, mean score, observed rate, its Wilson interval, and whether the mean lies inside."""
    b = F.lit(0)
    for i, e in enumerate(edges):
        b = F.when(F.col(score) >= e, i + 1).otherwise(b)
    g = df.withColumn("band", b).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("k"), F.avg(score).alias("predicted"))
    g = g.withColumn("observed", F.col("k") / F.col("n")).withColumn("_w", wilson(F.col("k"), F.col("n")))
    return g.select("band", "n", "k", "predicted", "observed", F.col("_w.lo").alias("lo"), F.col("_w.hi").alias("hi"), F.col("predicted").between(F.col("_w.lo"), F.col("_w.hi")).alias("inside"))


def threshold_table(df: DataFrame, score: str, label: str, thresholds=(0.5, 0.2, 0.1, 0.05)) -> DataFrame:
    from .fuzzy import confusion

    t = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    return confusion(t, F.col(score) >= F.col("threshold"), F.col(label).cast("int") == 1, ["threshold"]).withColumn("flagged", F.col("tp") + F.col("fp"))


def standard_scale(df: DataFrame, features) -> tuple[list[float], list[float]]:
    """Means and population deviations (0 becomes 1)."""
    row = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return [row[f"m_{f}"] for f in features], [row[f"s_{f}"] or 1.0 for f in features]


def kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = 11) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(k)).cast("int"))


def scale_without(df: DataFrame, features, part: str, parts: int) -> list[tuple[list[float], list[float]]]:
    """Means and population deviations of the rows outside each part, from one aggregation by part."""
    rows = df.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.var_pop(f).alias(f"v_{f}") for f in features]).collect()
    out = []
    for p in range(parts):
        rest = [r for r in rows if r[part] != p]
        n = np.array([r["n"] for r in rest], float)
        mu, sd = [], []
        for f in features:
            m, v = (np.array([r[f"{c}_{f}"] for r in rest], float) for c in "mv")
            mean = float((n * m).sum() / n.sum()) if len(rest) else 0.0
            mu.append(mean)
            sd.append(float(np.sqrt((n * (v + (m - mean) ** 2)).sum() / n.sum())) or 1.0 if len(rest) else 1.0)
        out.append((mu, sd))
    return out


def logistics(df: DataFrame, features, label: str, part: str | None = None, parts: int = 1, l2: float = 10.0, scalers: list[tuple] | None = None, steps: int = 25, tol: float = 1e-9) -> list[dict]:
    """Newton's method for L2-penalised (intercept apart) logistic fits on standardised features: one fit, or one for each
    of the parts 0, 1, ... (`part` a column), on the rows outside it.

    A step is one aggregation for all fits: every row meets the models that it belongs to, and a model has one gradient and
    one Hessian, (m+1)(m+4)/2 sums whatever the rows; only they come to the driver. A fit that has settled rests.
    """
    features = list(features)
    scalers = scalers or (scale_without(df, features, part, parts) if part else [standard_scale(df, features)])
    m = len(features) + 1
    raw = [F.col(f).cast("double") for f in features]
    data = df.select(F.array(*raw).alias("x"), F.col(label).cast("double").alias("y"), (F.col(part) if part else F.lit(-1)).alias("part")).persist()
    weights, open_, counts = [np.zeros(m) for _ in range(parts)], set(range(parts)), [0] * parts
    pen = np.array([0.0] + [l2] * (m - 1))
    try:
        for _ in range(steps):
            numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
            models = F.array(*[F.struct(F.lit(k).alias("model"), numbers(weights[k]).alias("w"), numbers(scalers[k][0]).alias("mu"), numbers(scalers[k][1]).alias("sd")) for k in sorted(open_)])
            met = data.select("x", "y", "part", F.explode(models).alias("m")).filter(F.col("m.model") != F.col("part"))
            z = F.col("m.w")[0]
            cells = [F.lit(1.0)]
            for i in range(1, m):
                cells.append((F.col("x")[i - 1] - F.col("m.mu")[i - 1]) / F.col("m.sd")[i - 1])
                z = z + F.col("m.w")[i] * cells[i]
            met = met.select("m.model", "y", *[c.alias(f"x{i}") for i, c in enumerate(cells)], (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("p"))
            sums = met.groupBy("model").agg(
                F.count(F.lit(1)).alias("n"), *[F.sum((F.col("p") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(m)],
                *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(m) for j in range(i, m)])
            for row in sums.collect():
                k = row["model"]
                g = np.array([row[f"g{i}"] for i in range(m)]) + pen * weights[k]
                h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)]) + np.diag(pen) + 1e-9 * np.eye(m)
                delta = np.linalg.solve(h, g)
                weights[k], counts[k] = weights[k] - delta, row["n"]
                if np.abs(delta).max() < tol:
                    open_.discard(k)
            if not open_:
                break
    finally:
        data.unpersist()
    return [{"features": features, "mu": list(mu), "sd": list(sd), "intercept": float(w[0]), "coef": [float(c) for c in w[1:]], "n": n} for (mu, sd), w, n in zip(scalers, weights, counts, strict=True)]


def logistic(df: DataFrame, features, label: str, l2: float = 10.0, scaler: tuple | None = None, steps: int = 25, tol: float = 1e-9) -> dict:
    """One fit on all rows."""
    return logistics(df, features, label, l2=l2, scalers=[scaler] if scaler else None, steps=steps, tol=tol)[0]


def logistic_score(model: dict) -> Column:
    z = F.lit(model["intercept"])
    for f, m, s, c in zip(model["features"], model["mu"], model["sd"], model["coef"], strict=True):
        z = z + (F.col(f) - F.lit(float(m))) / F.lit(float(s)) * F.lit(c)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def contributions(model: dict) -> Column:
    """Array of struct(feature, value), largest absolute value first."""
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), ((F.col(f) - F.lit(float(m))) / F.lit(float(s)) * F.lit(c)).alias("value")) for f, m, s, c in zip(model["features"], model["mu"], model["sd"], model["coef"], strict=True)])
    return F.array_sort(parts, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(0))


def out_of_fold(df: DataFrame, id_col: str, features, label: str, k: int = 5, l2: float = 10.0, seed: int = 11, scaler: str = "train") -> DataFrame:
    """Each row scored by a model of the other folds; the scaler is fitted on them too, or on all rows (`all`)."""
    folds = kfold(df, id_col, k, seed)
    scalers = [standard_scale(df, features)] * k if scaler == "all" else None
    models = logistics(folds, features, label, "fold", k, l2, scalers)
    out = F.lit(None).cast("double")
    for f, model in enumerate(models):
        out = F.when(F.col("fold") == f, logistic_score(model)).otherwise(out)
    return folds.withColumn("oof", out)


def stumps(df: DataFrame, features, label: str, rounds: int = 60, lr: float = 0.3, min_leaf: int = 20) -> list[tuple[str, float, float, float]]:
    """Boosted stumps (feature, threshold, left, right) on the logistic gradient; thresholds at the quartiles of the
    distinct values. One aggregation a round tries every split; the model is a list of bounded length."""
    splits = []
    for f in features:
        r = counted(before(df.select(f).distinct(), [f], {"_before": F.lit(1).cast("long")}), "n")
        q = [x[0] for x in r.filter(F.expr("_before IN (n div 4, n div 2, 3 * n div 4)")).orderBy("_before").select(f).collect()]
        splits += [(f, float(v)) for v in dict.fromkeys(q)]
    base = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    base = float(np.log(base / (1 - base)))
    model: list[tuple[str, float, float, float]] = [("", 0.0, base, base)]
    data = df.select(*features, F.col(label).cast("double").alias("_y")).persist()
    try:
        for _ in range(rounds):
            resid = F.col("_y") - stumps_score(model)
            row = data.withColumn("_r", resid).agg(*[x for i, (f, t) in enumerate(splits) for x in (F.sum(F.when(F.col(f) <= t, F.col("_r")).otherwise(0.0)).alias(f"l{i}"), F.count_if(F.col(f) <= t).alias(f"n{i}"))], F.sum("_r").alias("all"), F.count(F.lit(1)).alias("n")).first()
            best, gain = None, 1e-12
            for i, (f, t) in enumerate(splits):
                nl, sl = row[f"n{i}"], row[f"l{i}"]
                nr, sr = row["n"] - nl, row["all"] - sl
                if min(nl, nr) >= min_leaf and (g := sl * sl / nl + sr * sr / nr) > gain + 1e-12:
                    best, gain = (f, t, lr * sl / nl, lr * sr / nr), g
            if best is None:
                break
            model.append(best)
    finally:
        data.unpersist()
    return model


def stumps_score(model) -> Column:
    z = F.lit(model[0][2])
    for f, t, left, right in model[1:]:
        z = z + F.when(F.col(f) <= t, left).otherwise(right)
    return 1 / (1 + F.exp(-z))


def pooled_bins(df: DataFrame, score: str, label: str, id_col: str, min_bin: int = 40) -> DataFrame:
    """(bin, at, n, k): rows in score order in bins of min_bin, a short tail in the bin before."""
    r = counted(before(df.select(score, label, id_col), [score, id_col], {"_before": F.lit(1).cast("long")}), "_n")
    b = F.least(F.floor(F.col("_before") / min_bin), F.greatest(F.lit(0), F.floor(F.col("_n") / min_bin) - 1))
    return r.groupBy(b.alias("bin")).agg(F.avg(score).alias("at"), F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("k"))


def pool_falling(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks (bin, to, s, n, k) merged while the rate k / n falls; a block spans the bins from bin to to."""
    fields = ["bin", "to", "s", "n", "k"]
    blocks: list[list] = []
    for row in pdf.sort_values("bin")[fields].itertuples(index=False):
        blocks.append(list(row))
        while len(blocks) > 1 and blocks[-2][4] * blocks[-1][3] > blocks[-1][4] * blocks[-2][3]:
            _, to, *sums = blocks.pop()
            blocks[-1][1:] = [to, *(a + c for a, c in zip(blocks[-1][2:], sums, strict=True))]
    return pd.DataFrame(blocks, columns=fields).assign(chunk=pdf["chunk"].iloc[0])


def pava(df: DataFrame, score: str, label: str, id_col: str, min_bin: int = 40, width: int = 4096) -> DataFrame:
    """(at, p, n): the isotonic curve over pooled bins; neighbours merge while the rate falls, and a block's place is
    the mean score of its rows."""
    return isotonic_blocks(pooled_bins(df, score, label, id_col, min_bin), width).select("at", "p", "n")


def isotonic_blocks(bins: DataFrame, width: int = 4096) -> DataFrame:
    """bins(bin, at, n, k) -> (bin, to, at, p, n): blocks of neighbouring bins whose rates do not fall.

    Blocks are merged within chunks of `width` bins, then of 16 times as many and so on, until no rate falls from a chunk
    to the next; in which order neighbours merge does not change the curve.
    """
    blocks = bins.select("bin", F.col("bin").alias("to"), (F.col("at") * F.col("n")).alias("s"), "n", F.col("k").cast("long").alias("k"))
    while True:
        chunks = blocks.withColumn("chunk", F.floor(F.col("bin") / width))
        blocks = checkpointed(chunks.groupBy("chunk").applyInPandas(pool_falling, "bin long, to long, s double, n long, k long, chunk long"))
        rate = F.col("k") / F.col("n")
        ends = blocks.groupBy("chunk").agg(F.min_by(rate, "bin").alias("first"), F.max_by(rate, "bin").alias("last"))  # a row a chunk
        fallen = ends.withColumn("was", F.lag("last").over(Window.orderBy("chunk"))).filter("was > first")
        if fallen.isEmpty():
            return blocks.select("bin", "to", (F.col("s") / F.col("n")).alias("at"), rate.alias("p"), "n")
        width *= 16


def apply_curve(df: DataFrame, curve: DataFrame, score: str) -> DataFrame:
    """p, lo, hi, at_ceiling: linear between the curve's points, flat outside; bounds interpolate the points' Wilson bounds.

    curve(at, p, n) may be of any length; a null score has a null p. Rows and points meet in ranges (order.bracketed).
    """
    bounds = wilson(F.bround(F.col("p") * F.col("n")), F.col("n"))
    points = checkpointed(curve.select("at", "p", bounds["lo"].alias("lo"), bounds["hi"].alias("hi")))
    d = bracketed(df, score, points, "at").join(F.broadcast(points.agg(F.max(F.struct("at", "p"))["p"].alias("_top"))))  # one row
    a, b = F.coalesce("before", "after"), F.coalesce("after", "before")
    t = F.when(F.col("before").isNull() | (b["at"] <= a["at"]), 0.0).otherwise((F.col(score) - a["at"]) / (b["at"] - a["at"]))
    mix = lambda f: a[f] + t * (b[f] - a[f])
    return d.withColumns({"p": mix("p"), "lo": mix("lo"), "hi": mix("hi")}).withColumn("at_ceiling", F.col("p") >= F.col("_top")).drop("before", "after", "_top")


def monotone(df: DataFrame, order: str, value: str, tol: float = 0.004) -> DataFrame:
    """One row: whether the value never falls by more than tol along the order (equal places by value). Rows are compared
    within ranges of the order, and ranges at their borders."""
    cut = df.select(F.col(order).alias("o"), F.col(value).alias("v")).repartitionByRange("o", "v")
    cut = checkpointed(cut.withColumn("r", F.spark_partition_id()))
    spot = F.struct("o", "v")
    borders = cut.groupBy("r").agg(F.min(spot)["v"].alias("first"), F.max(spot)["v"].alias("last"))  # a row a range
    falls = cut.select((F.lag("v").over(Window.partitionBy("r").orderBy("o", "v")) - F.col("v")).alias("fall"))
    falls = falls.unionByName(borders.select((F.lag("last").over(Window.orderBy("r")) - F.col("first")).alias("fall")))
    return falls.agg(F.bool_and(F.coalesce("fall", F.lit(0.0)) <= tol).alias("monotone"))


def ships(gain: Column, p: Column, wins: Column, min_gain: float = 0.05, max_p: float = 0.01, min_wins: int = 2) -> Column:
    return (gain >= min_gain) & (p < max_p) & (wins >= min_wins)
