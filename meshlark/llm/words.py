"""Words of texts and their hashes, for the operators that run in Python workers. All of it works on many texts at once
and holds no table of words: a word's hash is computed from its bytes, eight at a time."""

from __future__ import annotations

import hashlib

import numpy as np

#: ASCII letters and digits and all non-ASCII bytes belong to words; everything else separates them.
SEPARATORS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Keeps the first n of eight bytes.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed by the library.
LONG = 512


def split_words(text: bytes) -> list[bytes]:
    return text.translate(SEPARATORS).split()


def hashes_at(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end]."""
    raw = data + bytes(8)
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    size = ends - starts
    out = size.astype(np.uint64) * MIX2
    at, step = np.flatnonzero(size <= LONG), 0
    while len(at):
        left = size[at] - step
        h = (out[at] ^ (eights[starts[at] + step] & MASKS[np.minimum(left, 8)])) * MIX
        h ^= h >> np.uint64(32)
        h *= MIX2
        out[at] = h ^ (h >> np.uint64(29))
        at, step = at[left > 8], step + 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, where each text's words begin and after the last one, and the words' places:
    the joined bytes, starts and ends)."""
    data = b" ".join(texts).translate(SEPARATORS)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = np.frombuffer(data, np.uint8) != 32
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes_at(data, starts, ends), np.searchsorted(starts, begins), data, starts, ends


def hash_of(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return hashes_at(b"".join(words), ends - np.array([len(w) for w in words], np.int64), ends)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of k words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= MIX
        out ^= out >> np.uint64(29)
        out += hashes[i : i + n]
    return out


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct rolling hashes of k words of each text, sorted; of a text with fewer words the one of them all."""
    hashes, at, *_ = word_hashes(texts)
    rolled, out = grams(hashes, k), []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        s = rolled[a : b - k + 1].copy() if b - a >= k else grams(hashes[a:b], b - a) if b > a else hashes[:0]
        s.sort()
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s)
    return out
