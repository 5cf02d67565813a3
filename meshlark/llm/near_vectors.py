"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Every usable vector x (scaled to length 1) is held as s*q + e: an int8 vector q, a scale s and the length of the error
e. Then |x.y - s_x s_y q_x.q_y| <= |e_x| + (1 + |e_x|) |e_y|, so a tile product of the int8 vectors shows which pairs can
reach the threshold; only those are computed again, in double precision from the vectors as given. The product runs in
single precision on s*q, with two more components that add the bound, and the threshold is lowered by the most that its
own rounding can cost, which grows with the dimension.

Vectors are dealt into blocks by a hash of their id, and every two blocks meet in one task, so all
rows are compared with all. A tile gives each of its vectors its number of links and its smallest relative, not the
pairs. The work grows with the square of the rows, as the method has it; memory of a task is one tile.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing (as do
vectors of another length); a null vec_id links with nothing and has a null component; rows that repeat vec_id and
embedding are one vector; rows that share a vec_id with other components have one result together: two vec_ids are
linked, once, if any of their vectors are (all vectors of a vec_id are in one block); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components
from .near_text import least_relatives

TILE = 4096
STRIP = 512
#: Above this share of possible pairs in a strip, all of it is computed again at once.
DENSE_SHARE = 0.02
#: Half the distance of neighbouring single-precision numbers at 1.
ROUNDING = 2.0**-24


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of length 1 -> int8 rows, scales, bounds of the error's length (with room for rounding)."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    err = np.sqrt(((x - s[:, None] * q) ** 2).sum(axis=1))
    return q, s, err * (1 + 1e-9) + 1e-12


def rounding_bound(dim: int) -> float:
    """The most that rounding changes a single-precision product of two operands of this many components, whose values
    and bounds (errors are 1 at most) add up to less than 8 in absolute terms: each operand and step may be off by one."""
    return 8 * (dim + 6) * ROUNDING / (1 - (dim + 6) * ROUNDING)


def operands(q: np.ndarray, s: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right sides whose product is s_x s_y q_x.q_y + |e_x| + (1 + |e_x|) |e_y|."""
    scaled, one = q * s[:, None], np.ones(len(q))
    return tuple(np.column_stack(c).astype(np.float32) for c in ((scaled, err, 1 + err), (scaled, one, err)))


def tile_links(a: tuple, b: tuple | None, threshold: float) -> np.ndarray:
    """The link matrix of two blocks (or of one with itself): blocks are (ids, vectors, left side, right side, norms)."""
    right = b or a
    linked = np.zeros((len(a[0]), len(right[0])), bool)
    rhs = np.ascontiguousarray(right[3].T)
    least = np.float32(threshold - rounding_bound(a[1].shape[1]))
    for at in range(0, len(a[0]), STRIP):
        rows = slice(at, at + STRIP)
        maybe = a[2][rows] @ rhs >= least
        spots = np.flatnonzero(maybe)
        if len(spots) > DENSE_SHARE * maybe.size:
            exact = (a[1][rows] @ right[1].T) / (a[4][rows, None] * right[4][None, :])
            linked[rows] = maybe & (exact >= threshold)
        elif len(spots):
            i, j = np.divmod(spots, maybe.shape[1])
            exact = np.einsum("ij,ij->i", a[1][rows][i], right[1][j]) / (a[4][rows][i] * right[4][j])
            linked[at + i[exact >= threshold], j[exact >= threshold]] = True
    return linked


def by_id(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Links of distinct ids from links of vectors, whose ids are sorted."""
    for axis, ids in ((0, left), (1, right)):
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        if len(first) < len(ids):
            linked = np.logical_or.reduceat(linked, first, axis=axis)
    return linked


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    held = vectors.schema["embedding"].dataType.elementType.typeName()
    real = "float" if held == "float" else "double"
    rows = saved(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{real}>").alias("embedding")).distinct(), "vec-rows")
    fit = f"size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < {real}('Infinity')) AND exists(embedding, x -> x != 0)"
    usable = rows.filter(f"coalesce({fit}, false) AND vec_id IS NOT NULL").withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-usable.count() // tile))
    usable = usable.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    kind = np.float32 if real == "float" else np.float64

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch["dim"].to_numpy()
            flat, ends = batch["embedding"].flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
            block, ids = batch["block"].to_numpy(), batch["vec_id"].to_numpy()
            out = []
            for d in np.unique(dims):
                for k in np.unique(block[dims == d]):
                    at = np.flatnonzero((dims == d) & (block == k))
                    out.append((int(d), int(k), ids[at].tobytes(), np.concatenate([flat[ends[i] : ends[i] + d] for i in at]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["dim", "block", "ids", "vectors"])

    pieces = usable.mapInArrow(packed, "dim int, block int, ids binary, vectors binary")
    tiles = F.expr(f"transform(sequence(0, {blocks - 1}), j -> struct(least(block, j) as i, greatest(block, j) as j))")
    dealt = pieces.withColumn("t", F.explode(tiles)).select("t.i", "t.j", "dim", "block", "ids", "vectors")

    def block_of(parts: list[tuple[bytes, bytes]], dim: int) -> tuple:
        ids = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
        x = np.concatenate([np.frombuffer(p[1], kind) for p in parts]).reshape(-1, dim).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        top = np.abs(x).max(axis=1, keepdims=True)
        norms = np.sqrt(((x / top) ** 2).sum(axis=1)) * top[:, 0]
        return (ids, x, *operands(*quantise(x / top / (norms / top[:, 0])[:, None])), norms)

    def compare(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        parts: dict[tuple[int, int], list] = {}
        for dim, k, x, v in zip(table["dim"].to_pylist(), table["block"].to_pylist(), table["ids"].to_pylist(), table["vectors"].to_pylist(), strict=True):
            parts.setdefault((dim, k), []).append((x, v))
        known = [np.unique(np.concatenate([np.frombuffer(x, np.int64) for (_, b), some in parts.items() if b == k for x, _ in some] or [np.zeros(0, np.int64)])) for k in (i, j)]
        all_linked = None
        for dim in sorted({d for d, _ in parts}):
            if (dim, i) not in parts or (dim, j) not in parts:
                continue
            a = block_of(parts[dim, i], dim)
            b = block_of(parts[dim, j], dim) if i != j else a
            linked = by_id(tile_links(a, b, threshold), a[0], b[0])
            if linked.shape == (len(known[0]), len(known[1])):
                all_linked = linked if all_linked is None else all_linked | linked
            else:  # vectors of several lengths
                all_linked = np.zeros((len(known[0]), len(known[1])), bool) if all_linked is None else all_linked
                all_linked[np.ix_(np.searchsorted(known[0], np.unique(a[0])), np.searchsorted(known[1], np.unique(b[0])))] |= linked
        if all_linked is None:
            return pa.table({"vec_id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "relative": pa.array([], pa.int64())})
        if i == j:
            np.fill_diagonal(all_linked, False)
            ids, links = known[0], all_linked.sum(axis=1)
        else:
            ids, links = np.concatenate(known), np.concatenate([all_linked.sum(axis=1), all_linked.sum(axis=0)])
        at = np.flatnonzero(links)
        at = at[np.argsort(ids[at], kind="stable")]
        if i == j:
            sub = all_linked[np.ix_(at, at)]
        else:
            sub = np.zeros((len(at), len(at)), bool)
            left, right = np.flatnonzero(at < len(known[0])), np.flatnonzero(at >= len(known[0]))
            cross = all_linked[np.ix_(at[left], at[right] - len(known[0]))]
            sub[np.ix_(left, right)] = cross
            sub[np.ix_(right, left)] = cross.T
        return pa.table({"vec_id": pa.array(ids[at]), "links": pa.array(links[at].astype(np.int64)), "relative": pa.array(ids[at][least_relatives(sub)])})

    found = saved(dealt.groupBy("i", "j").applyInArrow(compare, "vec_id long, links long, relative long"), "vec-links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    roots = components(found.filter("vec_id > relative").select(F.col("vec_id").alias("u"), F.col("relative").alias("v")).distinct())
    known = links.join(roots.withColumnRenamed("u", "vec_id"), "vec_id", "left")
    out = rows.select("vec_id").distinct().join(known, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
