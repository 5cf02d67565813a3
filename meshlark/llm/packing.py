"""Packing into sequences: first-fit decreasing with a tournament tree, in random groups.

Documents are tokenized where they are read; each is cut into full sequences and a rest (only the pieces' place, length
and checksum leave the task). A full piece is a sequence by itself, whatever its document's length. The rests are dealt
into random groups of about `group_pieces`, and each group is packed by itself: pieces by falling length, each into the
first sequence with room, found in a tournament tree over the room left.

Defined results: a null text counts as empty and packs as the end mark alone; rows that repeat are packed each for
itself; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, saved

END = 1
LENGTH = 2048
#: Bytes of words and ids that a task remembers, and what an entry takes beside them; texts, and characters of them, that
#: are looked up at once.
REMEMBERED, ENTRY, AT_ONCE, CHARACTERS = 28 << 20, 180, 256, 2_000_000

LATIN_LETTERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
LATIN_NUMBERS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's pre-tokenizer on lower-cased Latin-1 bytes whose blanks are plain ones.
LATIN_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + LATIN_LETTERS + rb"]+|[" + LATIN_NUMBERS + rb"]|[^ " + LATIN_LETTERS + LATIN_NUMBERS + rb"]+")
#: Lower-cases, and makes every blank a plain one.
LATIN_LOWER = bytes(32 if c in b"\t\n\v\f\r\x85\xa0" else ord(chr(c).lower()) for c in range(256))
PLAIN = bytes(c for c in range(256) if re.match(rb"[" + LATIN_LETTERS + rb" .,]", bytes([c])))
#: Where these stand, a run of marks is longer than one.
RUNS = (b"..", b",,", b".,", b",.")


def latin_words(text: bytes) -> list[bytes]:
    if text.translate(None, PLAIN) or any(x in text for x in RUNS):
        return LATIN_WORDS.findall(text)
    return text.replace(b".", b" . ").replace(b",", b" , ").split()


@functools.lru_cache(2)
def tokenizers_of(path: str) -> tuple:
    """The vocabulary's tokenizer, one for its single words, and its special tokens: of a fixed size, so a worker process
    keeps them between its tasks."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    words = parts | {"added_tokens": [], "normalizer": None, "pre_tokenizer": parts["pre_tokenizer"]["pretokenizers"][-1]}
    return Tokenizer.from_str(json.dumps(parts)), Tokenizer.from_str(json.dumps(words)), [x["content"] for x in parts["added_tokens"]]


class WordIds:
    """The ids of texts as little-endian 32-bit bytes, by a lower-case vocabulary whose pre-tokenizer drops blanks.

    A text of Latin-1 characters is in normal form; it is lower-cased and cut into words by tables, and the library
    encodes each word once, as long as REMEMBERED bytes hold it. Any other text, or one with a special token, goes to the
    library whole. The table of words lives as long as its task.
    """

    def __init__(self, path: str):
        self.whole, self.single, self.special = tokenizers_of(path)
        self.words: dict[bytes, bytes] = {}
        self.held = 0

    def many(self, texts: list[str]) -> list[bytes]:
        lists: list[list[bytes] | None] = []
        for text in texts:
            try:
                latin = text.encode("latin-1")
            except UnicodeEncodeError:
                latin = None
            lists.append(None if latin is None or any(x in text for x in self.special) else latin_words(latin.translate(LATIN_LOWER)))
        new = list(set().union(*[x for x in lists if x]).difference(self.words))
        got = self.single.encode_batch_fast([w.decode("latin-1") for w in new], add_special_tokens=False) if new else []
        self.words.update((w, struct.pack(f"<{len(e)}I", *e.ids)) for w, e in zip(new, got, strict=True))
        get = self.words.__getitem__
        out = [b"".join(map(get, x)) if x is not None else self.by_library(text) for x, text in zip(lists, texts, strict=True)]
        for w in new:
            size = ENTRY + len(w) + len(self.words[w])
            if self.held + size > REMEMBERED:
                del self.words[w]
            else:
                self.held += size
        return out

    def by_library(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def cut(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document's ids (bytes, end mark included)."""
    view, step = memoryview(ids), 4 * length
    return [(i // 4, len(view[i : i + step]) // 4, zlib.crc32(view[i : i + step])) for i in range(0, len(ids), step)]


class Room:
    """Room left in each sequence: a tournament tree of maxima; first(n) is the first sequence with n to spare."""

    def __init__(self, size: int, length: int):
        self.leaves = 1 << max(0, (size - 1).bit_length())
        self.top = [length] * (2 * self.leaves)

    def first(self, n: int) -> int:
        i = 1
        while i < self.leaves:
            i *= 2
            if self.top[i] < n:
                i += 1
        return i - self.leaves

    def take(self, at: int, n: int) -> int:
        """Fill n of sequence `at`; the room it had."""
        i = at + self.leaves
        had = self.top[i]
        self.top[i] = had - n
        while i > 1:
            i //= 2
            best = max(self.top[2 * i], self.top[2 * i + 1])
            if self.top[i] == best:
                break
            self.top[i] = best
        return had


def first_fit_decreasing(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, for pieces in the order given after sorting by falling length (stable)."""
    n = len(lengths)
    room, seq, off = Room(max(n, 1), length), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = room.first(size)
        off[i] = length - room.take(at, size)
        seq[i] = at
    return seq, off


#: Sequence ids of full pieces begin here; a group's begin at its number times 2 ** 32.
FULL = 1 << 62


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, group_pieces: int = 2048, seed: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    end = np.array([END], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = WordIds(tokenizer_path), 0

        def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal row
            got: list[tuple] = []
            for doc, found in zip(ids, words.many(texts), strict=True):
                row += 1
                found += end
                got += [(doc, start, n, crc, len(found) // 4, row) for start, n, crc in cut(found, length)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

        for batch in batches:
            ids, texts, size, at = batch.column(0).to_pylist(), [], 0, 0
            for i, text in enumerate(batch.column(1), 1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if len(texts) == AT_ONCE or size >= CHARACTERS or i == len(ids):
                    yield flush(ids[at:i], texts)
                    texts, size, at = [], 0, i
        words.words.clear()
        give_back()

    cut_up = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")
    # the id that a row has in its task: the same whenever the written table is read
    cut_up = saved(cut_up.withColumn("at", F.monotonically_increasing_id()), "packing-pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = cut_up.filter(F.col("length") == length).select(*columns, (F.col("at") + FULL).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = cut_up.filter(F.col("length") < length)
    groups = max(1, rests.count() // max(1, group_pieces))
    rests = rests.select(*columns, F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "row", "at"), F.lit(groups)).alias("group"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        seq, off = first_fit_decreasing(table["length"].to_numpy(), length)
        ids = (table["group"].to_numpy() << 32) + seq
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(off, pa.int64()))

    return full.unionByName(rests.groupBy("group").applyInArrow(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
