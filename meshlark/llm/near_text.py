"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents become sets of hashed five-word shingles. Equal sets form a class. In each of TREES trees a class has a label of
MAX_DEPTH short MinHash values, packed into one number, so that the sorted labels of a tree are its prefix trie: a node is
a run of neighbours that share their first levels. The matched prefix is shortened from MAX_DEPTH on until the forest
finds pairs at the threshold with the target recall, by the formula and as measured: every task plants, for some of its
own documents, a partner as far away as the threshold allows, and counts in how many trees the two meet at each depth.
The labels are sorted by range over the cluster; within a range each class is tied to the first one of its node, and
where a node goes on in the next range, the two sides of the border are tied.

The connected classes bound where links can be. Inside each of them the
classes are cut into bands of size (sets whose sizes differ by more than the threshold cannot link) and blocks, and
every pair of blocks is verified exactly: shared shingles are counted by a matrix product where many documents hold
them and pair by pair where few do. A block pair gives each class its number of links and its smallest relative, never
the pairs, so that a large group of near copies costs tasks and not rows.

Defined results: words are lower-cased runs of ASCII letters, digits and non-ASCII characters; a text of one to four
words has one shingle of them all; a null, empty or wordless text links with nothing; shingles are equal if their
64-bit hashes are; rows that repeat doc_id and text are copies that link; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_filter, give_back, join_groups, once, saved, split_by_keys
from .components import components
from .words import shingle_sets

SHINGLE = 5
TREES, MAX_DEPTH = 32, 7
#: Bits of a level: all levels of a tree fit one positive number.
BITS = 9
#: Documents for which a task plants partners, and the smallest sets that get one.
PLANTED, PLANT_FROM = 64, 9
BLOCK = 512
#: Shingles that so many documents of a block pair hold are counted by a matrix product.
DENSE = 24
#: Bytes of texts, and texts, that are hashed at once; shingles that are signed at once.
TEXT_BYTES, TEXTS, AT_ONCE = 1 << 20, 256, 60_000


def prefix_recall(met: float, trees: int = TREES) -> float:
    """The chance that a pair meets in some tree, if it meets in each with this one."""
    return 1 - (1 - met) ** trees


def forest_depth(threshold: float, target: float, measured: list[float]) -> int:
    """The longest prefix whose recall at the threshold reaches the target, by the formula and by the measured shares of
    trees in which planted pairs meet (for depth 1, 2, ...; none if nothing was planted). A target that even one level does
    not reach is refused."""
    for depth in range(MAX_DEPTH, 0, -1):
        if min([prefix_recall(threshold**depth), *(prefix_recall(m) for m in measured[depth - 1 : depth])]) >= target:
            return depth
    raise ValueError(f"{TREES} trees do not reach a recall of {target} at similarity {threshold}")


def sets_of(texts: list[str | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; some texts at a time."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").lower().encode())
        size += len(held[-1])
        if size >= TEXT_BYTES or len(held) >= TEXTS:
            yield from shingle_sets(held, k)
            held, size = [], 0
    if held:
        yield from shingle_sets(held, k)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def class_number(key: bytes) -> int:
    """A class's number in the forest; should two classes share one, they count as tied and are verified."""
    return int.from_bytes(key[:8], "little", signed=True)


def tree_labels(sets: list[np.ndarray], seed: int = 1) -> np.ndarray:
    """For each non-empty set its label in each tree: MAX_DEPTH MinHash values of BITS bits, the first one on top."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    rng = np.random.default_rng(seed)
    odd, salt = rng.integers(0, 1 << 32, (2, TREES * MAX_DEPTH), np.uint32)
    low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    out, x = np.zeros((len(starts), TREES), np.int64), np.empty_like(low)
    for i in range(TREES * MAX_DEPTH):
        np.multiply(low, odd[i] | np.uint32(1), out=x)
        x ^= salt[i]
        least = np.minimum.reduceat(x, starts) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
        out[:, i // MAX_DEPTH] = out[:, i // MAX_DEPTH] << BITS | least
    return out


def same_levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first levels two labels share."""
    x = (a ^ b)[..., None] >> (BITS * np.arange(MAX_DEPTH - 1, -1, -1))
    return (x == 0).sum(axis=-1)


def planted_partner(s: np.ndarray, threshold: float, seed: int = 3) -> np.ndarray:
    """A set whose similarity with s is the least that the threshold allows: some values lost, some added."""
    n = len(s)
    lost = int(n * (1 - threshold) / (1 + threshold))
    added = int((n - lost) / threshold + 1e-9) - n
    rng = np.random.default_rng([seed, n, int(s[0])])
    return np.concatenate([s[np.sort(rng.permutation(n)[lost:])], rng.integers(0, 1 << 63, added).astype(np.uint64) * np.uint64(2)])


def signatures(docs: DataFrame, threshold: float, k: int) -> DataFrame:
    """doc_id, sha (of the text), cls (key of the set), num, n (its size), labels (one for each tree), and for a few
    documents met: in how many trees it and a partner at the threshold share one, two, ... levels."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planted = 0

        def flush(ids: list, shas: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal planted
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            labels, met = np.zeros((len(sets), TREES), np.int64), [None] * len(sets)
            if len(full):
                labels[full] = tree_labels([sets[i] for i in full])
            some = np.flatnonzero(sizes >= PLANT_FROM)[: PLANTED - planted]
            if len(some):
                planted += len(some)
                levels = same_levels(labels[some], tree_labels([planted_partner(sets[i], threshold) for i in some]))
                for i, x in zip(some, levels, strict=True):
                    met[i] = [int((x >= d).sum()) for d in range(1, MAX_DEPTH + 1)]
            keys = [set_key(s) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, labels.size + 1, TREES), pa.int32()), pa.array(labels.ravel()))
            columns = [pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.array(keys, pa.binary()), pa.array([class_number(x) for x in keys], pa.int64()), pa.array(sizes), lists, pa.array(met, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "cls", "num", "n", "labels", "met"])

        for batch in batches:
            ids, shas = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            sets, held, at = [], 0, 0
            for i, s in enumerate(sets_of((x.as_py() for x in batch.column(1)), k), 1):
                sets.append(s)
                held += len(s)
                if held >= AT_ONCE or i == len(ids):
                    yield flush(ids[at:i], shas[at:i], sets)
                    sets, held, at = [], 0, i
        give_back()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_sha().alias("sha"))
    return read.mapInArrow(sign, "doc_id long, sha binary, cls binary, num long, n long, labels array<long>, met array<long>")


def text_sha() -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def shared_counts(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sorted lists share."""
    m = len(lists)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    _, column, held = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, begin = owner[order], np.concatenate([[0], np.cumsum(held)[:-1]])
    out = np.zeros((m, m), np.float32)
    dense = np.flatnonzero(held > DENSE)
    for at in range(0, len(dense), 4096):
        some = dense[at : at + 4096]
        has = np.zeros((len(some), m), np.float32)
        rows = np.repeat(np.arange(len(some)), held[some])
        cells = np.concatenate([owner[b : b + h] for b, h in zip(begin[some], held[some], strict=True)])
        has[rows, cells] = 1
        out += has.T @ has
    flat = np.zeros(m * m, np.int64)
    for f in range(2, DENSE + 1):
        some = begin[held == f]
        if len(some):
            docs = owner[some[:, None] + np.arange(f)]
            i, j = np.triu_indices(f, 1)
            for at in range(0, len(some), max(1, 2_000_000 // len(i))):
                part = docs[at : at + max(1, 2_000_000 // len(i))]
                flat += np.bincount((part[:, i] * m + part[:, j]).ravel(), minlength=m * m)
    sparse = flat.reshape(m, m)
    return out + sparse + sparse.T


def least_relatives(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the smallest index that its links lead to."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify_tile(table: pa.Table, threshold: float) -> pa.Table:
    """Rows (side, cls, copies, shingles) of a block pair -> cls, links, relative for those that link."""
    seen: dict[tuple[int, bytes], int] = {}
    for i, x in enumerate(zip(table["side"].to_pylist(), table["cls"].to_pylist(), strict=True)):
        seen.setdefault(x, i)
    keep = sorted(seen, key=lambda x: (x[1], x[0]))
    sides, cls = np.array([x[0] for x in keep], np.int64), [x[1] for x in keep]
    raw = table["shingles"]
    lists = [np.frombuffer(raw[seen[x]].as_py(), np.uint64) for x in keep]
    copies = np.array(table["copies"].to_pylist(), np.int64)[[seen[x] for x in keep]]
    linked = np.zeros((len(keep), len(keep)), bool)
    if len(keep) > 1:
        both = shared_counts(lists)
        size = np.array([len(x) for x in lists], np.float64)
        linked = both / (size[:, None] + size[None, :] - both) >= threshold
        if sides.any():
            linked &= sides[:, None] != sides[None, :]
        np.fill_diagonal(linked, False)
    links, least = linked @ copies, least_relatives(linked)
    at = np.flatnonzero(links)
    return pa.table({"cls": pa.array([cls[i] for i in at], pa.binary()), "links": pa.array(links[at], pa.int64()), "relative": pa.array([cls[least[i]] for i in at], pa.binary())})


def candidate_edges(classes: DataFrame, depth: int) -> DataFrame:
    """(u, v) with v < u: classes of one node, each tied to the first of its range, and ranges tied at their borders."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (tree, label, num) -> kind 0: a tie (u, v); kind 1 and 2: the first and last row of the range."""
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, 0

        def rows(kind: int, u, v, tree=None, label=None) -> pa.RecordBatch:
            n, none = len(u), pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(u), pa.array(v), none if tree is None else pa.array(tree), none if label is None else pa.array(label)], ["kind", "part", "u", "v", "tree", "label"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, label, num = (batch.column(i).to_numpy() for i in range(3))
            if last is None:
                yield rows(1, num[:1], num[:1], tree[:1], label[:1])
                last = (tree[0], label[0])
                first = num[0]
            before_tree, before_label = np.append(last[0], tree[:-1]), np.append(last[1], label[:-1])
            new = (tree != before_tree) | (same_levels(label, before_label) < depth)
            at = np.maximum.accumulate(np.where(new, np.arange(len(num)), -1))
            head = np.where(at < 0, first, num[at])
            apart = head != num
            yield rows(0, np.maximum(head, num)[apart], np.minimum(head, num)[apart])
            last, first, end = (tree[-1], label[-1]), head[-1], num[-1:]
        if last is not None:
            yield rows(2, end, end, np.array([last[0]]), np.array([last[1]]))

    tries = classes.select("num", F.posexplode("labels").alias("tree", "label")).select(F.col("tree").cast("long").alias("tree"), "label", "num")
    tries = tries.repartitionByRange("tree", "label", "num").sortWithinPartitions("tree", "label", "num")
    found = saved(tries.mapInArrow(tie, "kind int, part int, u long, v long, tree long, label long"), "near-forest")
    # two rows for each range of the sort
    ends = sorted(found.filter("kind > 0").collect(), key=lambda r: (r.part, r.kind))
    meet = lambda a, b: (a.kind, b.kind, a.tree) == (2, 1, b.tree) and a.u != b.u and same_levels(np.array([a.label]), np.array([b.label]))[0] >= depth
    borders = [(max(a.u, b.u), min(a.u, b.u)) for a, b in zip(ends, ends[1:], strict=False) if meet(a, b)]
    return found.filter("kind = 0").select("u", "v").unionByName(classes.sparkSession.createDataFrame(borders, "u long, v long")).distinct()


def near_rows(docs: DataFrame, threshold: float = 0.8, k: int = SHINGLE, target: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, sha (of its text), worded, class_id, set_id, n_links, and stays: true for the rows of
    one text in each group, that of the least (doc_id with null last, cls, sha), and for all texts without words."""
    signed = saved(signatures(docs, threshold, k), "near-signed")
    sums = signed.agg(F.count(F.lit(1)).alias("rows"), F.count("met").alias("planted"), *[F.sum(F.col("met")[d]).alias(f"met{d}") for d in range(MAX_DEPTH)]).first()
    total = sums["rows"]
    depth = forest_depth(threshold, target, [sums[f"met{d}"] / (sums["planted"] * TREES) for d in range(MAX_DEPTH)] if sums["planted"] else [])
    classes = signed.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sha"))["sha"].alias("rep_sha"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("num").alias("num"), F.first("labels").alias("labels"))
    classes = saved(classes, "near-classes")
    near = components(candidate_edges(classes, depth))
    near = near.unionByName(near.select(F.col("root").alias("u"), "root").distinct())
    members = classes.drop("labels").join(near.withColumnRenamed("u", "num"), "num").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(threshold)).cast("double")).cast("int"))
    members = saved(members, "near-members")

    counts = saved(members.groupBy("root", "band").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "near-blocks")
    beside = lambda d, name: counts.select("root", (F.col("band") + d).alias("band"), F.col("blocks").alias(name))
    around = counts.join(beside(1, "below"), ["root", "band"], "left").join(beside(-1, "above"), ["root", "band"], "left").fillna(0, ["below", "above"])
    around = around.withColumn("spot", F.struct("root", "band")).drop("root", "band")
    placed = join_groups(members.withColumn("spot", F.struct("root", "band")), around, "spot", "size", max(1, members.count()))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    tiles = F.expr("""concat(
        transform(sequence(0, blocks - 1), j -> struct(band as low, 0 as step, least(block, j) as i, greatest(block, j) as j, if(j < block, 1, 0) as side)),
        if(above > 0, transform(sequence(0, greatest(above, 1) - 1), j -> struct(band as low, 1 as step, block as i, j as j, 0 as side)), array()),
        if(below > 0, transform(sequence(0, greatest(below, 1) - 1), i -> struct(band - 1 as low, 1 as step, i as i, block as j, 1 as side)), array()))""")
    placed = saved(placed.select("cls", "rep", "copies", "root", tiles.alias("tiles")), "near-placed")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(sets_of((x.as_py() for x in batch["text"]), k))
            rest = batch.drop_columns(["text"])
            same = pa.array([set_key(s) == c for s, c in zip(sets, rest["cls"].to_pylist(), strict=True)], pa.bool_())
            yield rest.append_column("shingles", pa.array([s.tobytes() for s in sets], pa.binary())).filter(same)

    # only the texts of classes that may link are shuffled
    wanted = bitmap_filter(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), placed.select(F.col("rep").alias("doc_id")), "doc_id")
    wanted = wanted.join(placed, wanted["doc_id"].eqNullSafe(placed["rep"])).select("text", "cls", "copies", "root", "tiles")
    tile_type = placed.schema["tiles"].dataType.simpleString()
    cut = wanted.mapInArrow(cut_up, f"cls binary, copies long, root long, tiles {tile_type}, shingles binary")
    dealt = cut.select("cls", "copies", "shingles", "root", F.explode("tiles").alias("t")).select("root", "t.low", "t.step", "t.i", "t.j", "t.side", "cls", "copies", "shingles")
    verified = dealt.groupBy("root", "low", "step", "i", "j").applyInArrow(lambda t: verify_tile(t, threshold), "cls binary, links long, relative binary")
    verified = saved(verified, "near-verified")
    links = verified.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(verified.filter("cls > relative").select(F.col("cls").alias("u"), F.col("relative").alias("v")))
    known = classes.select("cls", "rep", "rep_sha", "copies").join(links, "cls", "left").join(roots.withColumnRenamed("u", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    known = saved(known, "near-known")
    first = F.min(F.struct(F.col("rep").isNull(), "rep", "cls"))["cls"]
    least = known.groupBy("root").agg(F.min("rep").alias("class_id"), first.alias("first"), F.count(F.lit(1)).alias("size"))
    known = join_groups(known, least, "root", "size", max(1, classes.count())).select("cls", "copies", F.col("rep").alias("set_id"), F.when(F.col("cls") == F.col("first"), F.col("rep_sha")).alias("stay_sha"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    stays = F.coalesce(F.col("doc_id").eqNullSafe(F.col("set_id")) & (F.col("sha") == F.col("stay_sha")), F.lit(False))
    out = join_groups(signed.filter("n > 0").select("doc_id", "sha", "cls"), known, "cls", "copies", total)
    out = out.select("doc_id", "sha", F.lit(True).alias("worded"), "class_id", "set_id", "n_links", stays.alias("stays"))
    alone = signed.filter("n = 0").select("doc_id", "sha", F.lit(False).alias("worded"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"))
    return out.unionByName(alone)


def near_groups(docs: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id its links lead to), set_id (of the smallest document with
    equal shingles), n_links (other documents linked directly), kept (doc_id = class_id)."""
    out = near_rows(docs, **params).select("doc_id", "class_id", "set_id", "n_links")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_copies(docs: DataFrame, **params) -> DataFrame:
    """docs with exactly one row of each group, with all its columns; documents without words stay. Rows go by doc_id and
    text, so that others of the same doc_id (or without one) are left alone; of rows that repeat both, any one stays."""
    rows = saved(near_rows(docs, **params).select("doc_id", "sha", "worded", "stays"), "near-rows")
    own = [F.col("doc_id").cast("long"), text_sha()]
    out, _ = split_by_keys(docs, own, rows.filter("NOT stays").select("doc_id", "sha").distinct())
    again = saved(rows.filter("stays AND worded").groupBy("doc_id", "sha").count().filter("count > 1").drop("count"), "near-again")
    return once(out, own, again)
