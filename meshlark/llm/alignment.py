"""Cross-tokenizer alignment: which tokens of two vocabularies lie over the same bytes, and how often over the corpus.

Every text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Where tokens of both end, the text is cut
into groups; every stretch between two neighbouring ends (of either side) is one link of the A and the B token over it.
A link's key is one int64: the B id in the upper half, the A id in the lower one, so that a B id's pairs are neighbours.

Counting: a task keeps its partial counts by np.unique and writes them once; the partial counts are sorted by range over
the cluster, and a range's runs of equal keys are summed as they stream by into one shard: sorted keys and counts, in the
shared folder. A B id's highest count comes from the same pass (one number for each id of the vocabulary reaches the
driver, with one line for each shard). Lookup: the documents' own keys, written with them in the first pass, are searched
in the shards that they fall in, which are memory-mapped where the shared folder is a mounted one, else read one by one.

Defined results: a null or empty text has no tokens, nor has one whose joined token bytes on either side differ from a
space and the text (one with U+2581, as B reads it as a space): its counts are zero and groups_sha256 is ''. Strings of
special tokens are plain text. Rows that repeat are counted each for itself; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, new_path, saved, store_of

#: Characters of texts that are aligned at once; distinct keys that a task counts before it writes them.
CHARACTERS, HELD = 1_000_000, 2_000_000
#: Keys of documents that are looked up at once.
LOOKED_UP = 2_000_000
#: Bytes of parts of texts and their ids in B that a task remembers, and what an entry takes beside them; no id of B.
REMEMBERED, ENTRY, BAD = 56 << 20, 180, 0xFFFF
#: Blanks and what follows them.
SPACED = re.compile(" *[^ ]+| +")
#: Letters, marks and blanks that every regex engine sorts alike; texts with others are cut by the library itself, and so
#: are texts with very long runs of blanks.
COMMON = re.compile("[^\x00-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞€]|\\s{5000}")


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others, in
    order, for U+0100 onward."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.lru_cache(2)
def vocabularies(a_path: str, b_path: str) -> tuple:
    """(encode A, B's library, token bytes of A and B, their lengths): of a fixed size, so a worker keeps them between tasks."""
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = Tokenizer.from_file(a_path)
    whole.encode_special_tokens = True
    letters, special = byte_letters(), {t.content for t in whole.get_added_tokens_decoder().values()}
    a_bytes = [b""] * whole.get_vocab_size()
    for token, i in whole.get_vocab().items():
        a_bytes[i] = b"" if token in special else bytes(letters[c] for c in token)
    import public_tokenizers

    # the same vocabulary in a faster library: a merge's place in the list is the id of what it makes
    fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(a_bytes) if b}, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        own = b"" if pieces.is_control(i) or pieces.is_unknown(i) else piece.replace("▁", " ").encode()
        b_bytes.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else own)

    def encode_a(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids if COMMON.search(text) else fast.encode_ordinary(text)

    return encode_a, pieces, a_bytes, b_bytes, *(np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes))


class Pieces:
    """The ids of texts in B as 16-bit numbers. No piece holds a blank behind another letter, so blanks with the letters behind
    them are encoded by themselves, each once as long as REMEMBERED bytes hold it; one whose pieces' bytes differ from it
    holds BAD. The table lives as long as its task."""

    def __init__(self, pieces, b_bytes: list[bytes]):
        # the library encodes an empty text as nothing, without its blank
        self.pieces, self.bytes, self.known, self.held = pieces, b_bytes, {" ": array("H", [pieces.piece_to_id("▁")]).tobytes()}, 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [SPACED.findall(" " + t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.known))
        for part, ids in zip(new, self.pieces.encode([p[1:] for p in new], num_threads=1), strict=True):
            same = b"".join(map(self.bytes.__getitem__, ids)) == part.encode()
            self.known[part] = array("H", ids if same else [BAD]).tobytes()
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for part in new:
            size = ENTRY + len(part) + len(self.known[part])
            if self.held + size > REMEMBERED:
                del self.known[part]
            else:
                self.held += size
        return out


class Aligner:
    """Aligns texts, some at a time."""

    def __init__(self, a_path: str, b_path: str):
        self.encode_a, pieces, self.a_bytes, b_bytes, self.a_size, self.b_size = vocabularies(a_path, b_path)
        self.encode_b = Pieces(pieces, b_bytes)

    def __call__(self, texts: list[str]) -> Alignment:
        raw = [b" " + t.encode() if t else b"" for t in texts]
        a, b = [self.encode_a(" " + t) if t else [] for t in texts], [np.frombuffer(x, np.uint16) for x in self.encode_b(texts)]
        for i, x in enumerate(raw):
            if x and (b[i].max() == BAD or b"".join(map(self.a_bytes.__getitem__, a[i])) != x):
                raw[i], a[i], b[i] = b"", [], b[i][:0]
        return Alignment([len(x) for x in raw], a, b, self.a_size, self.b_size)


class Alignment:
    """What aligning some texts gives: links (keys) and, for each text, where its links and groups begin."""

    def __init__(self, sizes: list[int], a: list[list[int]], b: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray):
        self.n_a, self.n_b = ([len(x) for x in ids] for ids in (a, b))
        self.a, self.b = np.fromiter(itertools.chain.from_iterable(a), np.int64, sum(self.n_a)), np.concatenate(b).astype(np.int64)
        mark = np.zeros(sum(sizes) + 1, np.uint8)
        for bit, ids, size in ((1, self.a, a_size), (2, self.b, b_size)):
            mark[np.cumsum(size[ids])] |= bit
        ends = np.flatnonzero(mark)
        mark = mark[ends]
        is_a, is_b, both = mark & 1, mark >> 1, mark == 3
        self.keys = self.b[np.cumsum(is_b, dtype=np.int64) - is_b] << 32 | self.a[np.cumsum(is_a, dtype=np.int64) - is_a]
        group = np.cumsum(both) - both
        self.group_a, self.group_b = group[is_a == 1], group[is_b == 1]
        self.link_at = np.searchsorted(ends, np.cumsum([0, *sizes]), "right")
        self.n_groups = np.diff(np.append(0, np.cumsum(both))[self.link_at])

    def groups(self) -> list[bytes]:
        """a1,a2|b1;a3|b2,b3 for each text."""
        order = np.concatenate([2 * self.group_a, 2 * self.group_b + 1])
        at = np.argsort(order, kind="stable")
        order, ids = order[at], np.concatenate([self.a, self.b])[at]
        mark = np.where(order == np.append(order[1:], -1), 0, 1 + (order & 1))
        words, size = decimal_table()
        codes = 3 * ids + mark
        data = words[codes].ravel()
        data = data[data != 0].tobytes()
        tokens = np.cumsum([0, *(x + y for x, y in zip(self.n_a, self.n_b, strict=True))])
        bounds = np.append(0, np.cumsum(size[codes]))[tokens].tolist()
        return [data[i : max(i, j - 1)] for i, j in zip(bounds, bounds[1:], strict=False)]


@functools.lru_cache(1)
def decimal_table() -> tuple[np.ndarray, np.ndarray]:
    """Row 3 * id + (0, 1, 2): a 16-bit id in decimal with a comma, a bar or a semicolon, padded with zero bytes; its length."""
    texts = np.array([f"{i}{mark}".encode() for i in range(1 << 16) for mark in ",|;"], "S8")
    return texts.view(np.uint8).reshape(-1, 8), np.char.str_len(texts).astype(np.int64)


def packed_keys(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted distinct keys, and how often each came, in few bytes: differences, by their bytes' rank."""
    steps = np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.array([len(keys)], "<i8").tobytes() + np.ascontiguousarray(steps).tobytes() + times.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked_keys(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 8 + 12 * size, "zstd", asbytes=True), np.uint8)[8:]
    steps = np.ascontiguousarray(raw[: 8 * size].reshape(8, size).T).view("<i8").ravel()
    return np.cumsum(steps), np.ascontiguousarray(raw[8 * size :].reshape(4, size).T).view("<i4").ravel().astype(np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts."""
    out, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(out), np.int64)
    np.add.at(sums, at, np.concatenate(counts))
    return out, sums


FIRST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_keys long, packed binary, key long, n long"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document with its packed keys, and rows (key, n) of each task's partial counts."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in FIRST.split(", "))])
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        settled, align = 0, Aligner(a_path, b_path)

        def partial() -> Iterator[pa.RecordBatch]:
            out, sums = summed(keys, counts) if keys else (np.zeros(0, np.int64),) * 2
            for i in range(0, len(out), 1 << 16):
                n = len(out[i : i + (1 << 16)])
                columns = [pa.nulls(n, f.type) for f in schema][:-2]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out[i : i + n]), pa.array(sums[i : i + n])], schema=schema)
            keys.clear()
            counts.clear()

        def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
            x = align(texts)
            own = [np.unique(x.keys[i:j], return_counts=True) for i, j in zip(x.link_at.tolist(), x.link_at.tolist()[1:], strict=False)]
            out, sums = summed(*zip(*own, strict=True))
            keys.append(out)
            counts.append(sums)
            shas = [hashlib.sha256(g).hexdigest() if g else "" for g in x.groups()]
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(x.n_a, pa.int64()), pa.array(x.n_b, pa.int64()), pa.array(x.n_groups, pa.int64()), pa.array(np.diff(x.link_at), pa.int64()), pa.array(shas, pa.string()),
                 pa.array([len(k) for k, _ in own], pa.int64()), pa.array([packed_keys(*o) for o in own], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)

        for batch in batches:
            ids, texts, size, at = batch.column(0).to_pylist(), [], 0, 0
            for i, text in enumerate(batch.column(1), 1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= CHARACTERS or i == len(ids):
                    yield flush(ids[at:i], texts)
                    texts, size, at = [], 0, i
                    if sum(map(len, keys)) - settled > HELD:
                        out, sums = summed(keys, counts)
                        keys[:], counts[:], settled = [out], [sums], len(out)
                        if settled > HELD:
                            yield from partial()
                            settled = 0
        yield from partial()
        align.encode_b.known.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tasks, FIRST)


def write_shards(partial: DataFrame, folder: str) -> list:
    """Sort (key, n) by range, sum the runs, and write one shard for each range. Rows (path, first, size, b_ids, b_most):
    where it lies, its first key, and the highest count of each B id in it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        path, size, first = f"{folder}/{uuid.uuid4().hex}", 0, None
        most: dict[int, int] = {}
        last_key = last_sum = None
        names = [f"{root}/{path.rsplit('/', 1)[1]}.{x}" for x in ("keys", "counts")]
        files: list = []

        def put(keys: np.ndarray, sums: np.ndarray) -> None:
            nonlocal size, first
            if not len(keys):
                return
            if not files:
                store.create_dir(root, recursive=True)
                files.extend(store.open_output_stream(n) for n in names)
                first = int(keys[0])
            files[0].write(keys.astype("<i8").tobytes())
            files[1].write(sums.astype("<i8").tobytes())
            size += len(keys)
            b, begin = np.unique(keys >> 32, return_index=True)
            for i, m in zip(b.tolist(), np.maximum.reduceat(sums, begin).tolist(), strict=True):
                most[i] = max(m, most.get(i, 0))

        for batch in batches:
            keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, sums = keys[begin], np.add.reduceat(n, begin)
            if last_key is not None:
                if keys[0] == last_key:
                    sums[0] += last_sum
                else:
                    put(np.array([last_key]), np.array([last_sum]))
            last_key, last_sum = int(keys[-1]), int(sums[-1])  # the run may go on in the next batch
            put(keys[:-1], sums[:-1])
        if last_key is not None:
            put(np.array([last_key]), np.array([last_sum]))
        for f in files:
            f.close()
        if size:
            yield pa.RecordBatch.from_pylist([{"path": path, "first": first, "size": size, "b_ids": np.array(list(most), "<i8").tobytes(), "b_most": np.array(list(most.values()), "<i8").tobytes()}])

    ranges = partial.repartitionByRange("key").sortWithinPartitions("key")
    return ranges.mapInArrow(write, "path string, first long, size long, b_ids binary, b_most binary").collect()


def shard_arrays(path: str, size: int) -> list[np.ndarray]:
    """A shard's keys and counts: mapped where the folder is mounted, else read."""
    store, root = store_of(path)
    if isinstance(store, pafs.LocalFileSystem):
        return [np.memmap(f"{root}.{x}", "<i8", "r", shape=(size,)) for x in ("keys", "counts")]
    return [np.frombuffer(store.open_input_file(f"{root}.{x}").read(), "<i8") for x in ("keys", "counts")]


def looked_up(docs: DataFrame, shards: list) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, by the keys' counts in the shards."""
    shards = sorted((r["first"], r["path"], r["size"]) for r in shards if r["size"]), [(r["b_ids"], r["b_most"]) for r in shards]
    places, parts = shards
    b, m = (np.concatenate([np.frombuffer(x[i], "<i8") for x in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
    best = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(best, b, m)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.array([x[0] for x in places], np.int64)

        def flush(part: pa.RecordBatch) -> pa.RecordBatch:
            sizes = part["n_keys"].to_numpy()
            own = [unpacked_keys(x.as_py(), n) for x, n in zip(part["packed"], sizes.tolist(), strict=True)]
            keys, times = (np.concatenate([o[i] for o in own]) for i in (0, 1))
            wanted, at = np.unique(keys, return_inverse=True)
            counts, shard = np.zeros(len(wanted), np.int64), np.searchsorted(firsts, wanted, "right") - 1
            for s in np.unique(shard).tolist():
                some = slice(*np.searchsorted(shard, [s, s + 1]).tolist())
                sorted_keys, sums = shard_arrays(*places[s][1:])
                counts[some] = sums[np.searchsorted(sorted_keys, wanted[some])]
            counts = counts[at]
            bounds = np.cumsum([0, *sizes.tolist()])
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])
            columns = [part[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(total(times * (counts == best[keys >> 32]))), pa.array(total(times * counts)), part["groups_sha256"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        for batch in batches:
            upto = np.cumsum(batch["n_keys"].to_numpy())
            at = 0
            while at < batch.num_rows:
                held = upto[at - 1] if at else 0
                n = max(1, int(np.searchsorted(upto, held + LOOKED_UP, "right")) - at)
                yield flush(batch.slice(at, n))
                at += n
        give_back()

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_keys", "packed").mapInArrow(look, out)


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id),
    count_sum (over links), groups_sha256."""
    spark = docs.sparkSession
    first = saved(aligned(docs, a_path, b_path), "align-first")
    shards = write_shards(first.filter("key IS NOT NULL").select("key", "n"), new_path(spark, "align-shards"))
    return looked_up(first.filter("key IS NULL"), shards)


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, n: how many links corpus-wide hold the pair."""
    counts = aligned(docs, a_path, b_path).filter("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
    return counts.select(F.col("key").bitwiseAND(0xFFFFFFFF).alias("a_id"), F.shiftright("key", 32).alias("b_id"), "n")

