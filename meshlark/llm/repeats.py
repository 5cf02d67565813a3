"""Repeated passages by suffix order: every byte under a string of 50 bytes that an earlier document also holds goes.

The collection of all texts is cut into independent ones. Every string of 50 bytes (a window) has a least hash among its
runs of 20 bytes; windows that are equal have equal ones, so whatever can match meets where that value leads. Neighbouring
windows with one value make a piece of at most 80 bytes.

1. Texts are packed (PACK bytes to a row, compressed), and each pack names the values of its windows: 32 bits of a
   value go to the place that the other bits name. A value that comes from several documents is wanted, one of very
   many runs of windows is frequent. Only the windows of wanted values go on.
2. Each pack sends its distinct pieces with the smallest doc_id that holds them to the bucket of their value. Windows of
   frequent values go one by one, by their whole content, so that no bucket holds all surroundings of a frequent passage.
3. A bucket sets aside its distinct pieces that share no window with another one, as no other has their value, or none with
   it the least hash of a longer run: the smallest document that holds such a piece is that of its windows. It cuts the
   others into collections of about COLLECTION symbols and builds each one's
   Burrows-Wheeler transform column by column (`Collection`): a round inserts one symbol of every string, from their ends,
   and reads and writes two sequential files, the transform and the common prefixes. Runs of suffixes whose common
   prefixes reach 50 give every window the smallest document that holds it.
4. These come back to the packs: a window is removed from a document with a larger doc_id than that.

The files of a collection are scratch of their task, as a sort's spilled runs are: they have no name, no one else
reads them, and a task that is run again begins anew.

Defined results: a null text is empty; a text of under 50 bytes loses nothing; rows that repeat a doc_id are one document
(they do not remove each other's bytes), each with its own result; a row without a doc_id neither loses bytes nor makes
others lose any; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, saved
from .words import MIX, MIX2

LENGTH, GRAM = 50, 20
#: Bytes of the runs that tell apart windows of one value.
LONGER = 40
#: Bytes of texts in a pack; windows that are hashed at once; most windows in a piece.
PACK, AT_ONCE, MOST = 1 << 20, 1 << 19, LENGTH - GRAM + 1
#: Values that a place counts, bytes of texts for a bucket of pieces, symbols of a collection.
VALUES, BUCKET, COLLECTION = 2_000_000, 12 << 20, 120_000
#: A value of so many runs of windows is frequent (below, its pieces are 5 MB at most); bits of a part of a bucket.
FREQUENT, PART = 65536, 0xFF
LEVEL = 6
#: No symbol (as a pair of bytes, no UTF-8 has it): stands before the first symbol of a string. LENGTH is a multiple of 10.
END = 0xFFFF


def squeezed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def compress(x: np.ndarray) -> bytes:
    return squeezed(x.tobytes())


def decompress(data: bytes, kind, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of the runs of `gram` bytes (16 at least) that begin at each byte but the last ones."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    n = len(data) - gram + 1
    h = eights[:n] * MIX
    for at in (*range(8, gram - 8, 8), gram - 8):
        h ^= h >> np.uint64(29)
        h *= MIX2
        h ^= eights[at : at + n] * MIX
    h ^= h >> np.uint64(32)
    h *= MIX2
    h ^= h >> np.uint64(29)
    return h


def window_values(data: bytes, gram: int = GRAM) -> np.ndarray:
    """The least hash of each window of LENGTH bytes."""
    m, span, most = gram_hashes(data, gram), 1, LENGTH - gram + 1
    while 2 * span <= most:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (most - span)], m[most - span :]) if most > span else m


class Pack:
    """Some texts: where their windows of one value lie."""

    def __init__(self, data: bytes, sizes: np.ndarray, ids: np.ndarray):
        """ids: a document's rank in the pack, -1 for one without an id."""
        self.data, self.sizes = data, sizes
        self.begins = np.cumsum(np.append(0, sizes))
        starts, counts, values, owner = [], [], [], []
        last = len(data) - LENGTH + 1
        # windows that lie within a document that has an id
        inside = np.zeros(max(0, last), bool)
        for a, n, i in zip(self.begins.tolist(), sizes.tolist(), ids.tolist(), strict=False):
            if n >= LENGTH and i >= 0:
                inside[a : a + n - LENGTH + 1] = True
        for at in range(0, max(0, last), AT_ONCE):
            v = window_values(data[at : min(at + AT_ONCE, last) + LENGTH - 1])
            real = inside[at : at + len(v)]
            new = np.append(True, (v[1:] != v[:-1]) | ~real[:-1])
            new[np.flatnonzero(~real)] = True
            own = np.flatnonzero(new)
            size = np.diff(np.append(own, len(v)))
            own, size = own[real[own]], size[real[own]]
            # long runs of one value are cut
            parts = -(-size // MOST)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            own, size = np.repeat(own, parts) + nth * MOST, np.minimum(np.repeat(size, parts) - nth * MOST, MOST)
            starts.append(own + at)
            counts.append(size)
            values.append(v[own])
        empty = np.zeros(0, np.int64)
        self.start, self.count = (np.concatenate([empty, *x]).astype(np.int64) for x in (starts, counts))
        self.value = np.concatenate([empty.astype(np.uint64), *values])
        self.doc = ids[np.searchsorted(self.begins, self.start, "right") - 1] if len(self.start) else empty

    def own_values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values, where each run's value stands among them, and whether several documents hold it."""
        values, at = np.unique(self.value, return_inverse=True)
        low, high = np.full(len(values), 1 << 62, np.int64), np.full(len(values), -1, np.int64)
        np.minimum.at(low, at, self.doc)
        np.maximum.at(high, at, self.doc)
        return values, at, low != high

    def pieces(self, codes: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[bytes, int, int, int]]]:
        """codes of the distinct values (1: wanted, 2: frequent) -> (start, document's rank, piece) of each run that is wanted,
        and the pieces: text, bucket, part of the bucket, and the rank of the document that holds it first."""
        code = codes[at]
        once, each = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        nth = np.arange(self.count[each].sum()) - np.repeat(np.cumsum(self.count[each]) - self.count[each], self.count[each])
        start = np.concatenate([self.start[once], np.repeat(self.start[each], self.count[each]) + nth])
        size = np.concatenate([self.count[once], np.ones(len(nth), np.int64)]) + LENGTH - 1
        doc = np.concatenate([self.doc[once], np.repeat(self.doc[each], self.count[each])])
        key = np.concatenate([(self.value[once] * MIX >> np.uint64(1)).astype(np.int64), np.full(len(nth), -1)])
        order = np.argsort(doc, kind="stable")
        start, doc, known, out, which = start[order], doc[order], {}, [], []
        for a, n, d, k in zip(start.tolist(), size[order].tolist(), doc.tolist(), key[order].tolist(), strict=True):
            text = self.data[a : a + n]
            i = known.get(text)
            if i is None:
                i = known[text] = len(out)
                if k < 0:
                    k = zlib.crc32(text)
                    k |= k << 32
                out.append((text, (k >> 24) % buckets, k & PART, d))
            which.append(i)
        return start, doc, np.array(which, np.int64), out


def least_between(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of lcp[low + 1 .. high] for each pair low < high."""
    out, left = np.zeros(len(low), np.uint8), high - low
    level = np.frexp(left)[1] - 1
    table, span = lcp, 1
    for k in range(int(level.max(initial=-1)) + 1):
        some = np.flatnonzero(level == k)
        if len(some):
            out[some] = np.minimum(table[low[some] + 1], table[high[some] - span + 1])
        table, span = np.minimum(table[:-span], table[span:]), 2 * span
    return out


class Column:
    """A file of numbers that is read from its start to its end and then written anew."""

    def __init__(self, first: np.ndarray):
        self.kind, self.files = first.dtype, [tempfile.TemporaryFile(buffering=0) for _ in range(2)]
        self.write(first)

    def write(self, x: np.ndarray) -> None:
        self.files.reverse()
        self.files[0].seek(0)
        self.files[0].write(x)
        self.size = len(x)

    def read(self) -> np.ndarray:
        self.files[0].seek(0)
        return np.fromfile(self.files[0], self.kind, self.size)

    def close(self) -> None:
        for f in self.files:
            f.close()


class Collection:
    """The Burrows-Wheeler transform and the common prefixes (up to LENGTH) of a collection of pieces.

    A symbol is a run of `unit` bytes, so that a piece enters as `unit` strings, one for each distance of its end from the
    piece's. A collection with less than 65,535 distinct runs of five bytes takes those, by their rank; any other takes
    pairs of bytes. In round j the suffixes of length j are inserted, one of each string that is so long. Where the
    suffix one shorter stands before is a symbol of the transform; the rank of that place among equal symbols is the new
    suffix's place among all that begin with it. Its common prefix with the suffix before it is one more than the least
    between the two places that they come from, and so is that of the suffix after it.
    """

    def __init__(self, pieces: list[bytes], units: tuple[int, ...] = (5, 2)):
        text = b"".join(pieces)
        eights = np.ndarray((len(text),), "<u8", text + bytes(8), 0, (1,))
        for self.unit in units:
            runs = eights[: max(0, len(text) - self.unit + 1)] & np.uint64((1 << 8 * self.unit) - 1)
            if self.unit == 2:
                symbols = runs.astype(np.uint16)
                break
            names, symbols = np.unique(runs, return_inverse=True)
            if len(names) < END:
                symbols = symbols.astype(np.uint16)
                break
        unit = self.unit
        self.enough = LENGTH // unit
        self.bytes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(self.bytes)
        ends = np.concatenate([ends - f for f in range(unit)])
        self.size = np.concatenate([(self.bytes - f) // unit for f in range(unit)])
        self.n = len(ends)
        self.at = np.arange(self.n)  # where each string's last suffix stands
        self.transform, self.prefixes = Column(symbols[ends - unit]), Column(np.zeros(self.n, np.uint8))
        order = np.argsort(-self.size, kind="stable")  # strings of j symbols and more come first
        longer = np.searchsorted(-self.size[order], -np.arange(1, int(self.size.max(initial=0)) + 1), "right")
        for j, active in enumerate(longer.tolist(), 1):
            some = order[:active]
            goes_on = self.size[some] > j
            before = np.full(active, END, np.uint16)
            before[goes_on] = symbols[ends[some[goes_on]] - unit * (j + 1)]
            self.insert(some, before)

    def insert(self, strings: np.ndarray, before: np.ndarray) -> None:
        """One symbol of each of the strings; `before` has the symbols that stand before them."""
        bwt, lcp = self.transform.read(), self.prefixes.read()
        rank = np.argsort(bwt, kind="stable")  # places by their symbol
        asked, who = np.zeros(len(bwt), bool), np.empty(len(bwt), np.int32)
        asked[self.at[strings]] = True
        who[self.at[strings]] = np.arange(len(strings))
        at = np.flatnonzero(asked[rank])
        place = rank[at]
        mine, symbol, new = who[place], bwt[place], at + self.n  # behind the empty suffixes
        old = np.ones(len(bwt) + len(at), bool)
        old[new] = False
        grown = np.empty(len(old), np.uint16)
        grown[old] = bwt
        grown[new] = before[mine]
        self.transform.write(grown)
        # common prefixes with the neighbours that begin with the same symbol
        back, ahead = rank[np.maximum(at - 1, 0)], rank[np.minimum(at + 1, len(rank) - 1)]
        has_back, has_ahead = (at > 0) & (bwt[back] == symbol), (at + 1 < len(rank)) & (bwt[ahead] == symbol)
        low, high = np.concatenate([back[has_back], place[has_ahead]]), np.concatenate([place[has_back], ahead[has_ahead]])
        least = np.minimum(least_between(lcp, low, high) + 1, self.enough)
        grown, n = np.empty(len(old), np.uint8), has_back.sum()
        grown[old] = lcp
        grown[new] = 0
        grown[new[has_ahead] + 1] = least[n:]
        grown[new[has_back]] = least[:n]
        self.prefixes.write(grown)
        self.at[strings[mine]] = new

    def first_documents(self, docs: np.ndarray) -> np.ndarray:
        """The smallest document of each window, for the windows of all pieces one after the other, walked through the
        finished transform from the strings' ends."""
        bwt, lcp = self.transform.read(), self.prefixes.read()
        step = np.empty(len(bwt), np.int64)
        step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt)) + self.n
        group = np.cumsum(lcp < self.enough)
        counts = self.bytes - LENGTH + 1
        first = np.cumsum(counts) - counts + self.bytes
        first = np.concatenate([first - f for f in range(self.unit)])
        out, at, strings = np.empty(counts.sum(), np.int64), np.arange(self.n), np.arange(self.n)
        for j in range(1, int(self.size.max(initial=0)) + 1):
            long = self.size[strings] >= j
            at, strings = step[at[long]], strings[long]
            if j >= self.enough:
                out[first[strings] - self.unit * j] = group[at]
        least = np.full(int(group[-1]) + 1 if len(group) else 1, np.iinfo(np.int64).max, np.int64)
        np.minimum.at(least, out, np.repeat(docs, counts))
        return least[out]

    def close(self) -> None:
        self.transform.close()
        self.prefixes.close()


def repeated(names: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Which of n owners have a name that another one has too."""
    order = np.argsort(names, kind="stable")
    names, owners = names[order], owners[order]
    new = names[1:] != names[:-1]
    group, several = np.cumsum(np.append(0, new))[: len(names)], np.zeros(len(names), bool)
    several[group[1:][~new & (owners[1:] != owners[:-1])]] = True
    out = np.zeros(n, bool)
    out[owners[several[group]]] = True
    return out


def meeting(pieces: list[bytes]) -> list[int]:
    """Which of the distinct pieces may share a window with another one, in order: an equal window has the same value, which is
    one for all windows of a piece, and the same least hash of LONGER bytes."""

    def blocks(some: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
        per = max(1, AT_ONCE // (MOST + LENGTH))
        for at in range(0, len(some), per):
            own = np.array(some[at : at + per], np.int64)
            sizes = np.array([len(pieces[i]) for i in own], np.int64)
            yield own, sizes, b"".join(pieces[i] for i in own)

    empty = np.zeros(0, np.uint64)
    values = np.concatenate([empty, *(window_values(text)[np.cumsum(sizes) - sizes] for _, sizes, text in blocks(list(range(len(pieces)))))])
    some, names, owners = np.flatnonzero(repeated(values, np.arange(len(pieces)), len(pieces))).tolist(), [empty], [np.zeros(0, np.int64)]
    for own, sizes, text in blocks(some):
        counts = sizes - LENGTH + 1
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        who, name = np.repeat(own, counts), window_values(text, LONGER)[np.repeat(np.cumsum(sizes) - sizes, counts) + nth]
        new = np.append(True, (name[1:] != name[:-1]) | (who[1:] != who[:-1]))
        names.append(name[new] ^ values[who[new]] * MIX)
        owners.append(who[new])
    return np.flatnonzero(repeated(np.concatenate(names), np.concatenate(owners), len(pieces))).tolist()


def first_documents(pieces: list[bytes], docs: list[int], parts: list[int]) -> list[np.ndarray]:
    """For each of the distinct pieces the smallest document of each of its windows; pieces with equal windows are of one
    part."""
    out = [np.full(len(p) - LENGTH + 1, d, np.int64) for p, d in zip(pieces, docs, strict=True)]
    order, at = sorted(meeting(pieces), key=parts.__getitem__), 0
    while at < len(order):
        end, symbols = at, 0
        while end < len(order) and (symbols < COLLECTION or parts[order[end]] == parts[order[end - 1]]):
            symbols += len(pieces[order[end]])
            end += 1
        some = order[at:end]
        sizes = np.array([len(pieces[i]) for i in some], np.int64)
        collection = Collection([pieces[i] for i in some])
        found = collection.first_documents(np.array([docs[i] for i in some], np.int64))
        collection.close()
        for i, x in zip(some, np.split(found, np.cumsum(sizes - LENGTH + 1)[:-1]), strict=True):
            out[i] = x
        at = end
    return out


PACKED = "pack long, ids array<long>, sizes array<long>, bytes long, texts binary"


def packs(docs: DataFrame) -> DataFrame:
    """Rows of about PACK bytes of texts, compressed."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 33, [], [], 0

        def row() -> pa.RecordBatch:
            out = {"pack": number, "ids": list(ids), "sizes": [len(t) for t in texts], "bytes": held, "texts": squeezed(b"".join(texts))}
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_pylist([out], schema=pa.schema([("pack", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bytes", pa.int64()), ("texts", pa.binary())]))

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append((text.as_py() or "").encode())
                held += len(texts[-1])
                if held >= PACK:
                    yield row()
                    number, held = number + 1, 0
        if ids:
            yield row()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tasks, PACKED)


def unpacked(batch: pa.RecordBatch, i: int) -> tuple[Pack, np.ndarray, np.ndarray]:
    """(pack, sorted distinct ids, each document's id; without one the least of all)."""
    own = batch["ids"][i].as_py()
    ids = np.array([x for x in own if x is not None], np.int64)
    ids = np.unique(ids)
    rank = np.array([-1 if x is None else int(np.searchsorted(ids, x)) for x in own], np.int64)
    sizes = np.array(batch["sizes"][i].as_py(), np.int64)
    data = pa.decompress(batch["texts"][i].as_py(), batch["bytes"][i].as_py(), "zstd", asbytes=True)
    return Pack(data, sizes, rank), ids, rank


def placed_values(values: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, place, 32 bits) of values: the order by place."""
    mixed = values * MIX2
    place = (mixed >> np.uint64(32)).astype(np.int64) % places
    order = np.argsort(place, kind="stable")
    return order, place[order], (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]


def named_values(packed: DataFrame, places: int) -> DataFrame:
    """pack, place, n, marks, runs: what a pack sends to each place, and how many runs of windows have each value."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values, at, _ = unpacked(batch, i)[0].own_values()
                order, place, marks = placed_values(values, places)
                own, begin = np.unique(place, return_index=True)
                parts = np.split(marks, begin[1:])
                runs = np.split(np.minimum(np.bincount(at, minlength=len(values)), 0xFFFF).astype(np.uint16)[order], begin[1:])
                yield pa.RecordBatch.from_arrays([pa.array([batch["pack"][i].as_py()] * len(own), pa.int64()), pa.array(own), pa.array([len(p) for p in parts][: len(own)], pa.int64()), pa.array([p.tobytes() for p in parts][: len(own)], pa.binary()), pa.array([compress(r) for r in runs][: len(own)], pa.binary())], ["pack", "place", "n", "marks", "runs"])
        give_back()

    return packed.mapInArrow(tasks, "pack long, place long, n long, marks binary, runs binary")


def judged(table: pa.Table) -> pa.Table:
    """The rows of one place -> pack, place, n, codes: 1 for a mark of several packs, 2 for one of these with very many runs."""
    sizes = np.array(table["n"].to_pylist(), np.int64)
    marks = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["marks"]])
    runs = np.concatenate([decompress(x.as_py(), np.uint16, n) for x, n in zip(table["runs"], sizes.tolist(), strict=True)])
    order = np.argsort(marks, kind="stable")
    begin = np.flatnonzero(np.append(True, marks[order][1:] != marks[order][:-1]))
    count = np.diff(np.append(begin, len(marks)))
    many = np.add.reduceat(runs[order], begin, dtype=np.int64) >= FREQUENT
    codes = np.empty(len(marks), np.uint8)
    codes[order] = np.repeat((count > 1).astype(np.uint8) * (1 + many), count)
    return table.drop_columns(["marks", "runs"]).append_column("codes", pa.array([compress(c) for c in np.split(codes, np.cumsum(sizes)[:-1])], pa.binary()))


def wanted(pack: Pack, places: list[dict], n_places: int) -> tuple[np.ndarray, np.ndarray]:
    """codes of the pack's distinct values, and where each run's value stands among them."""
    values, at, several = pack.own_values()
    order, _, _ = placed_values(values, n_places)
    found = np.concatenate([np.zeros(0, np.uint8), *(decompress(p["codes"], np.uint8, p["n"]) for p in sorted(places or [], key=lambda p: p["place"]))])
    codes = np.zeros(len(values), np.uint8)
    codes[order] = found
    return np.maximum(codes, several), at


def by_bucket(pieces: list[tuple[bytes, int, int, int]]) -> dict[int, list[int]]:
    """Which of a pack's pieces go to each bucket, in order."""
    out: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        out.setdefault(p[1], []).append(i)
    return dict(sorted(out.items()))


def sent_pieces(met: DataFrame, places: int, buckets: int) -> DataFrame:
    """pack, bucket, and the pieces: n, bytes, sizes, parts, docs (smallest doc_id of each) and texts."""
    types = "pack long, bucket long, n long, bytes long, sizes binary, parts binary, docs binary, texts binary"

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.binary()) for n, t in (x.split() for x in types.split(", "))])
        for batch in batches:
            for i in range(batch.num_rows):
                pack, ids, _ = unpacked(batch, i)
                *_, pieces = pack.pieces(*wanted(pack, batch["places"][i].as_py(), places), buckets)
                rows = []
                for b, own in by_bucket(pieces).items():
                    texts = [pieces[k][0] for k in own]
                    text = b"".join(texts)
                    rows.append({"pack": batch["pack"][i].as_py(), "bucket": b, "n": len(own), "bytes": len(text), "sizes": compress(np.array([len(t) for t in texts], np.uint8)), "parts": compress(np.array([pieces[k][2] for k in own], np.uint8)), "docs": compress(np.diff(ids[[pieces[k][3] for k in own]], prepend=0)), "texts": squeezed(text)})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        give_back()

    return met.mapInArrow(tasks, types)


def solved(table: pa.Table) -> pa.Table:
    """The rows of one bucket -> pack, bucket, n (windows), firsts: the smallest document of each window of the pieces."""
    known: dict[bytes, int] = {}
    docs: list[int] = []
    parts: list[int] = []
    sent: list[list[int]] = []
    for n, size, *columns in zip(*(table[c].to_pylist() for c in ("n", "bytes", "sizes", "parts", "docs", "texts")), strict=True):
        sizes, own_parts, own_docs = (decompress(x, kind, n) for x, kind in zip(columns, (np.uint8, np.uint8, np.int64), strict=False))
        text, at, own = pa.decompress(columns[-1], size, "zstd", asbytes=True), 0, []
        for length, part, doc in zip(sizes.tolist(), own_parts.tolist(), np.cumsum(own_docs).tolist(), strict=True):
            i = known.setdefault(text[at : at + length], len(docs))
            if i == len(docs):
                docs.append(doc)
                parts.append(part)
            elif doc < docs[i]:
                docs[i] = doc
            own.append(i)
            at += length
        sent.append(own)
    found = first_documents(list(known), docs, parts)
    firsts = [np.concatenate([found[i] for i in own]) for own in sent]
    give_back()
    return pa.table({"pack": table["pack"], "bucket": table["bucket"], "n": pa.array([len(x) for x in firsts], pa.int64()), "firsts": pa.array([compress(x) for x in firsts], pa.binary())})


def removed(pack: Pack, ids: np.ndarray, codes: np.ndarray, at: np.ndarray, found: dict[int, np.ndarray], buckets: int) -> np.ndarray:
    """Which bytes of the pack go."""
    gone = np.zeros(len(pack.data) + 1, np.int64)
    start, doc, which, pieces = pack.pieces(codes, at, buckets)
    if len(start):
        counts = np.array([len(p[0]) - LENGTH + 1 for p in pieces], np.int64)
        begin, groups = np.zeros(len(pieces), np.int64), by_bucket(pieces)
        own = np.array([i for g in groups.values() for i in g], np.int64)
        begin[own] = np.cumsum(counts[own]) - counts[own]
        firsts = np.concatenate([found[b] for b in groups])
        n = counts[which]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        windows = (np.repeat(start, n) + nth)[firsts[np.repeat(begin[which], n) + nth] < np.repeat(ids[doc], n)]
        np.add.at(gone, windows, 1)
        np.subtract.at(gone, windows + LENGTH, 1)
    return np.cumsum(gone[:-1]) > 0


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that
    stay; with_text: also those bytes (kept)."""
    packed = saved(packs(docs), "repeats-packs")
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    places, buckets = math.ceil((total + 1) / (VALUES * 16)), math.ceil((total + 1) / BUCKET)
    judge = "pack long, place long, n long, codes binary"
    codes = named_values(packed, places).groupBy("place").applyInArrow(judged, judge)
    codes = saved(codes.groupBy("pack").agg(F.collect_list(F.struct("place", "n", "codes")).alias("places")), "repeats-values")
    met = packed.join(codes, "pack", "left")
    pieces = sent_pieces(met, places, buckets)
    firsts = pieces.groupBy("bucket").applyInArrow(solved, "pack long, bucket long, n long, firsts binary")
    firsts = saved(firsts.groupBy("pack").agg(F.collect_list(F.struct("bucket", "n", "firsts")).alias("firsts")), "repeats-firsts")
    types = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack, ids, _ = unpacked(batch, i)
                found = {x["bucket"]: decompress(x["firsts"], np.int64, x["n"]) for x in batch["firsts"][i].as_py() or []}
                gone = removed(pack, ids, *wanted(pack, batch["places"][i].as_py(), places), found, buckets)
                data, bounds = np.frombuffer(pack.data, np.uint8), pack.begins.tolist()
                first = gone & ~np.append(False, gone[:-1])
                first[pack.begins[:-1][pack.sizes > 0]] |= gone[pack.begins[:-1][pack.sizes > 0]]
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                sums = [np.diff(np.append(0, np.cumsum(x))[pack.begins]) for x in (gone, first)]
                shas = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values, pa.array(pack.sizes), *map(pa.array, sums), pa.array(shas, pa.string()), pa.array(kept if with_text else [None] * len(kept), pa.binary())], [x.split()[0] for x in types.split(", ")])
        give_back()

    out = packed.join(codes, "pack", "left").join(firsts, "pack", "left").mapInArrow(tasks, types)
    return out if with_text else out.drop("kept")
