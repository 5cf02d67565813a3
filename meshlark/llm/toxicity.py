"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a learned vector of its hash and the mean of learned vectors of its character runs. Blanks and
punctuation separate words, in ASCII and outside it; a word of over LONGEST bytes (or a passage in a script without
blanks) enters as overlapping pieces, each of them a word, so that no byte of it is left out. A text is cut into windows
of LENGTH words that overlap by half; in a window, one network reads forwards and one backwards, attention
weighs the words' states, and a logistic unit gives the window's probability. A document's score is that of its worst
window, over all windows of the whole text.

Training takes at most `sample` labelled documents whose crc32(doc_id) mod 3 is not 1, in the order of a hash of doc_id,
and of these, in the same order, those with which the total stays within `words` words; each of them is learned from
whole. A document's label holds for its worst window: rounds of scoring all windows and
fitting the worst one of each document alternate.

Defined results: a null text counts as empty, and an empty one gets the score of no words; labels other than 0 and 1
are not learned from; without both labels in the sample, every score is the share of label 1 (0 if there is none); a
doc_id that is labelled more than once counts with its largest label, and one that stands on several texts is learned from
with the text of the least SHA-256; other columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, give_back, saved
from .words import split_words

LENGTH, STRIDE = 48, 24
WORDS, GRAM_BITS, WORD_DIM, GRAM_DIM, STATE, ATTEND = 1 << 14, 15, 8, 12, 12, 8
#: Lengths of the character runs; share of words whose own vector is hidden in training, so that their characters count.
RUNS, HIDDEN = (3, 5, 7), 0.5
SAMPLE, SAMPLE_WORDS, ROUNDS, WARM, BATCH, LEAST_STEPS, LEAST_DOCS, RATE = 3000, 2_000_000, 6, 2, 64, 40, 4, 0.01
#: Bytes of a piece of a word at most, and bytes that neighbours share at least: each run lies within a piece.
LONGEST, OVERLAP = 24, max(RUNS) - 1
#: Words whose gates a task remembers; windows that are run at once (their words must fit); words whose gates are computed at once.
REMEMBERED, WINDOWS, CHUNK = 1 << 16, 1024, 4096
#: Windows that training scores with one table of gates.
SCORED = 8192
#: Texts, and characters of them, that are scored at once.
TEXTS, AT_ONCE = 128, 1_000_000
LIMIT = 0.7
F32 = np.float32


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def windows(n: int) -> list[int]:
    """Where the windows of a text of n words begin: together they cover all of it."""
    return list(range(0, max(1, n - STRIDE), STRIDE))


@functools.lru_cache(1)
def blanks() -> frozenset[str]:
    """Blanks and punctuation outside ASCII, the zero-width space among them."""
    return frozenset(c for c in map(chr, range(128, 0x20000)) if unicodedata.category(c)[0] in "ZP" or c in "\x85\u200b")


def pieces(word: bytes) -> list[bytes]:
    """A word in pieces of at most LONGEST bytes, cut between characters, that share at least OVERLAP bytes."""
    out, at, end = [], 0, 0
    while end < len(word):
        end = min(at + LONGEST, len(word))
        while end < len(word) and word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end - OVERLAP
        while word[at] & 0xC0 == 0x80:
            at -= 1
    return out


def words_of(text: str | None) -> list[bytes]:
    low = (text or "").lower()
    if not low.isascii():
        for c in blanks().intersection(low):
            low = low.replace(c, " ")
    words = split_words(low.encode())
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [x for w in words for x in (pieces(w) if len(w) > LONGEST else (w,))]


def word_runs(words: list[bytes], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word (of at most `longest` bytes), hashes of its character runs (ends marked), and its bytes."""
    ids = np.fromiter((zlib.crc32(w) % (WORDS - 1) + 1 for w in words), np.int32, len(words))
    size = np.fromiter(map(len, words), np.uint8, len(words))
    raw = np.array([b"<" + w + b">" for w in words], f"S{longest + 2}").view(np.uint8).reshape(len(words), -1)
    runs = []
    for n in RUNS:
        h = np.full((len(words), max(0, longest + 3 - n)), n, np.uint32)
        for i in range(n):
            h = (h ^ raw[:, i : i + h.shape[1]]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
        runs.append(((h * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.uint16))
    return ids, np.concatenate(runs, 1), size


def run_weights(size: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Weights of the character runs of words of these bytes: those that a word does not have weigh nothing."""
    there = np.concatenate([np.arange(max(0, longest + 3 - n)) + n <= size[:, None].astype(np.int32) + 2 for n in RUNS], 1).astype(F32)
    return there / np.sqrt(np.maximum(there.sum(1, keepdims=True), 1))


def word_inputs(words: list[bytes], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, grams, size = word_runs(words, longest)
    return ids, grams, run_weights(size, longest)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, where each key begins in it, and the keys."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    starts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    return order, starts, held[starts]


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *s, by=None: (rng.standard_normal(s) * (by or s[0] ** -0.5)).astype(F32)
        n = WORD_DIM + GRAM_DIM
        self.p = {"word": draw(WORDS, WORD_DIM, by=0.1), "gram": draw(1 << GRAM_BITS, GRAM_DIM, by=0.1), "A": draw(2 * STATE, ATTEND), "v": draw(ATTEND), "o": draw(2 * STATE), "c": np.zeros(1, F32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(n, 3 * STATE), f"U{d}": draw(STATE, 3 * STATE), f"b{d}": np.zeros(3 * STATE, F32)}

    def gates(self, ids, grams, there, seen=F32(1)) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of distinct words, and what they add to the gates of both directions (a row of zeros first)."""
        p = self.p
        x = np.concatenate([p["word"][ids] * seen, np.einsum("nkd,nk->nd", p["gram"][grams], there)], 1)
        g = np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], 1)
        return x, np.concatenate([np.zeros((1, g.shape[1]), F32), g])

    def fill_gates(self, words: list[bytes], out: np.ndarray) -> None:
        """Write the gates of many words, a bounded number at a time; words of like length go together."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), CHUNK):
            some = order[a : a + CHUNK]
            out[some] = self.gates(*word_inputs([words[i] for i in some], max(1, len(words[some[-1]]))))[1][1:]

    def scores(self, words: list[bytes], at: np.ndarray) -> np.ndarray:
        """Logits of windows over rows of words (from 1)."""
        used, local = np.unique(np.append(0, at), return_inverse=True)
        gates = np.zeros((len(used), 6 * STATE), F32)
        self.fill_gates([words[i - 1] for i in used[1:]], gates[1:])
        local = local[1:].reshape(at.shape)
        return np.concatenate([self.run(gates, local[i : i + WINDOWS]) for i in range(0, len(at), WINDOWS)])

    def run(self, gates: np.ndarray, at: np.ndarray, keep: bool = False):
        """at: windows of rows of gates (0: no word). The windows' logits, and with keep what backward needs."""
        p, (n, length) = self.p, at.shape
        mask = (at > 0).astype(F32)
        states, trail = np.zeros((n, length, 2 * STATE), F32), {}
        for d, half, order in (("f", 0, range(length)), ("b", 1, range(length - 1, -1, -1))):
            u, g0, h = p[f"U{d}"], gates[:, half * 3 * STATE : (half + 1) * 3 * STATE], np.zeros((n, STATE), F32)
            steps = []
            for t in order:
                g, m = g0[at[:, t]], mask[:, t, None]
                hu = h @ u
                zr = np.tanh((g[:, : 2 * STATE] + hu[:, : 2 * STATE]) * F32(0.5)) * F32(0.5) + F32(0.5)
                z, r = zr[:, :STATE], zr[:, STATE:]
                new = np.tanh(g[:, 2 * STATE :] + r * hu[:, 2 * STATE :])
                step = m * (1 - z)
                if keep:
                    steps.append((t, h, z, r, new, hu[:, 2 * STATE :], m))
                h = h + step * (new - h)
                states[:, t, half * STATE : (half + 1) * STATE] = h
            trail[d] = steps
        a = np.tanh(states @ p["A"])
        e = a @ p["v"] + (mask - 1) * F32(1e9)
        e -= e.max(1, keepdims=True)
        w = np.exp(e) * mask
        w /= np.maximum(w.sum(1, keepdims=True), F32(1e-9))
        pooled = np.einsum("nt,ntd->nd", w, states)
        logits = pooled @ p["o"] + p["c"]
        return (logits, states, trail, a, w, pooled) if keep else logits

    def gradients(self, inputs, at: np.ndarray, y: np.ndarray, seen: np.ndarray) -> dict[str, np.ndarray]:
        p, (ids, grams, there) = self.p, inputs
        x, gates = self.gates(ids, grams, there, seen)
        logits, states, trail, a, w, pooled = self.run(gates, at, keep=True)
        d = ((1 / (1 + np.exp(-logits)) - y) / len(y)).astype(F32)
        out = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
        dp = d[:, None] * p["o"]
        ds = w[:, :, None] * dp[:, None, :]
        dw = np.einsum("nd,ntd->nt", dp, states)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        out["v"] = np.einsum("nt,nta->a", de, a)
        da = de[:, :, None] * p["v"] * (1 - a * a)
        out["A"] = np.einsum("ntd,nta->da", states, da)
        ds += da @ p["A"].T
        dgates = np.zeros_like(gates)
        order, starts, rows = grouped(at.ravel())
        for k, half in (("f", 0), ("b", 1)):
            u, dh, du = p[f"U{k}"], np.zeros((len(at), STATE), F32), np.zeros_like(p[f"U{k}"])
            each = np.zeros((*at.shape, 3 * STATE), F32)
            for t, h, z, r, new, hn, m in reversed(trail[k]):
                dh = dh + ds[:, t, half * STATE : (half + 1) * STATE]
                step = dh * m
                dz = step * (h - new) * z * (1 - z)
                dn = step * (1 - z) * (1 - new * new)
                dr = dn * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                du += h.T @ dhu
                each[:, t] = np.concatenate([dz, dr, dn], 1)
                dh = dh * (1 - m) + step * z + dhu @ u.T
            dgates[rows, half * 3 * STATE : (half + 1) * 3 * STATE] = np.add.reduceat(each.reshape(-1, 3 * STATE)[order], starts)
            dg = dgates[1:, half * 3 * STATE : (half + 1) * 3 * STATE]
            out |= {f"U{k}": du, f"W{k}": x.T @ dg, f"b{k}": dg.sum(0)}
        dx = dgates[1:, : 3 * STATE] @ p["Wf"].T + dgates[1:, 3 * STATE :] @ p["Wb"].T
        out["word"], out["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        order, starts, rows = grouped(ids)
        out["word"][rows] = np.add.reduceat((dx[:, :WORD_DIM] * seen)[order], starts)
        word, place = np.nonzero(there)
        order, starts, rows = grouped(grams[word, place])
        out["gram"][rows] = np.add.reduceat((dx[word, WORD_DIM:] * there[word, place][:, None])[order], starts)
        return out


def fit(samples: list[tuple[int, list[bytes]]], rounds: int = ROUNDS, seed: int = 0) -> Network:
    """samples: (label, words) per document."""
    net, rng = Network(seed), np.random.default_rng(seed)
    words = sorted({w for _, ws in samples for w in ws}) or [b"-"]
    row = {w: i + 1 for i, w in enumerate(words)}
    parts = [word_runs(words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)]
    ids, grams, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
    del parts
    at, owner, label = [], [], np.array([y for y, _ in samples], F32)
    for i, (_, ws) in enumerate(samples):
        at.append(windows_of(np.fromiter((row[w] for w in ws), np.int32, len(ws)), np.array([0, len(ws)]))[0])
        owner.append(np.full(len(at[-1]), i, np.int64))
    at, owner = np.concatenate(at), np.concatenate(owner)
    # what stands in few documents says nothing about others: its vectors stay zero, as those of unknown words and runs are
    rare = {"word": np.zeros(WORDS, np.int64), "gram": np.zeros(1 << GRAM_BITS, np.int64)}
    edges = np.searchsorted(owner, np.arange(len(samples) + 1))
    for a, b in zip(edges, edges[1:], strict=False):
        here = np.unique(at[a:b])
        here = here[here > 0] - 1
        rare["word"][np.unique(ids[here])] += 1
        rare["gram"][np.unique(grams[here][run_weights(size[here]) > 0])] += 1
    rare = {k: v < LEAST_DOCS for k, v in rare.items()}
    for k, v in rare.items():
        net.p[k][v] = 0
    mean, var, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    share = min(0.95, max(0.05, float(label.mean())))
    net.p["c"][:] = np.log(share / (1 - share))
    for turn in range(rounds):
        blind = turn < WARM
        if not blind:
            score = np.concatenate([net.scores(words, at[i : i + SCORED]) for i in range(0, len(at), SCORED)])
            order = np.lexsort((score, owner))
            worst = order[np.append(owner[order][1:] != owner[order][:-1], True)]
        luck = np.lexsort((rng.random(len(at)), owner))
        rank = np.arange(len(at)) - np.searchsorted(owner[luck], owner[luck])
        some = luck[rank < np.where(label[owner[luck]] == 1, 4 * blind, 2 if blind else 1)]
        chosen = some if blind else np.unique(np.concatenate([worst, some]))
        parts = max(1, len(chosen) // BATCH)
        passes = range(-(-LEAST_STEPS // parts))
        for part in [x for _ in passes for x in np.array_split(rng.permutation(chosen), parts)]:
            used, local = np.unique(at[part], return_inverse=True)
            local = local.reshape(len(part), LENGTH)
            if used[0] == 0:
                used = used[1:]
            else:
                local = local + 1
            g = net.gradients((ids[used - 1], grams[used - 1], run_weights(size[used - 1])), local, label[owner[part]], (rng.random((len(used), 1)) >= HIDDEN).astype(F32))
            step += 1
            for k, v in g.items():
                if k in rare:
                    v[rare[k]] = 0
                np.clip(v, -1, 1, out=v)
                mean[k] += F32(0.1) * (v - mean[k])
                var[k] += F32(0.01) * (v * v - var[k])
                net.p[k] -= (RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * mean[k] / (np.sqrt(var[k]) + 1e-8)).astype(F32)
    return net


def windows_of(rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words, and where each text's words begin and the last one's end -> windows (0: no word) and the text of each."""
    starts = [a + np.array(windows(b - a)) for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False)]
    owner = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
    spots = np.concatenate(starts)[:, None] + np.arange(LENGTH)
    inside = spots < begins[owner + 1][:, None]
    return np.where(inside, rows[np.minimum(spots, max(0, len(rows) - 1))] if len(rows) else 0, 0).astype(np.int32), owner


def training_sample(docs: DataFrame, labels: DataFrame, sample: int, words: int) -> list[tuple[int, list[bytes]]]:
    """(label, words) of the documents to learn from; `sample` documents and `words` words bound what reaches the driver."""
    known = labels.filter("toxic IN (0, 1)").filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    luck = F.xxhash64(F.lit(7), "doc_id")
    known = known.orderBy(luck, "doc_id").limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), luck.alias("luck"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = words_of(batch["text"][i].as_py())
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row["doc_id"], row["toxic"], row["luck"], pa.array([len(found)], pa.int64()), pa.array([b" ".join(found)], pa.binary())], ["doc_id", "toxic", "luck", "n", "words"])

    text = F.coalesce("text", F.lit(""))
    # at most `sample` narrow rows are broadcast, and as many texts are grouped
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(known), "doc_id")
    found = found.groupBy("doc_id", "toxic", "luck").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    found = saved(found.mapInArrow(cut, "doc_id long, toxic int, luck long, n long, words binary"), "toxic-sample")
    taken, total = [], 0
    for r in sorted(found.select("doc_id", "luck", "n").collect(), key=lambda r: (r.luck, r.doc_id)):
        if total + r.n <= words:
            taken.append(r.doc_id)
            total += r.n
    rows = sorted(found.filter(F.col("doc_id").isin(taken)).select("doc_id", "toxic", "words").collect(), key=lambda r: r.doc_id)
    seen: dict[bytes, bytes] = {}  # one object per word
    return [(r.toxic, [seen.setdefault(w, w) for w in bytes(r.words).split()]) for r in rows]


class Scorer:
    """Scores texts with a fitted network; remembers what REMEMBERED words add to the gates, in a table of fixed size."""

    def __init__(self, net: Network):
        self.net, self.row = net, {}
        self.known = np.zeros((REMEMBERED + 1, 6 * STATE), F32)

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words' gates; the words of WINDOWS windows at most."""
        new = list(set(words).difference(self.row))
        if len(self.row) + len(new) > REMEMBERED:
            self.row = {}
            new = list(set(words))
        first = len(self.row) + 1
        self.net.fill_gates(new, self.known[first : first + len(new)])
        self.row.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.row.__getitem__, words), np.int32, len(words))

    def many(self, texts: list[str | None]) -> np.ndarray:
        lists = [words_of(t) for t in texts]
        words = [w for ws in lists for w in ws]
        begins = np.cumsum([0, *map(len, lists)])
        at, owner = windows_of(np.arange(1, len(words) + 1), begins)
        worst = np.full(len(texts), -np.inf)
        for i in range(0, len(at), WINDOWS):
            some = at[i : i + WINDOWS]
            low, high = int(some[some > 0].min(initial=len(words) + 1)), int(some.max(initial=0))
            rows = np.append(0, self.rows_of(words[low - 1 : high])).astype(np.int32)
            np.maximum.at(worst, owner[i : i + WINDOWS], self.net.run(self.known, rows[np.where(some > 0, some - low + 1, 0)]).astype(np.float64))
        return 1 / (1 + np.exp(-worst))


def with_scores(docs: DataFrame, labels: DataFrame, columns: list[str], name: str, sample: int = SAMPLE, words: int = SAMPLE_WORDS, seed: int = 0) -> DataFrame:
    """One row per document: these columns of docs, and the score under a name. The scores are computed where the documents are read."""
    samples = training_sample(docs, labels, sample, words)
    share = sum(y for y, _ in samples) / max(1, len(samples))
    model = pickle.dumps(fit(samples, seed=seed).p) if 0 < share < 1 else None
    packed = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    read = docs.select(*(F.col(f"`{c}`") for c in columns), F.col("text").alias(fresh("text")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if packed.value is not None:
            net = Network.__new__(Network)
            net.p = pickle.loads(packed.value)
            scorer = Scorer(net)
        for batch in batches:
            texts, at, some, held = batch.column(len(columns)), 0, [], 0
            for i, text in enumerate(texts, 1):
                some.append(text.as_py())
                held += len(some[-1] or "")
                if len(some) == TEXTS or held >= AT_ONCE or i == len(texts):
                    got = scorer.many(some) if scorer else np.full(len(some), share)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k)[at:i] for k in range(len(columns))), pa.array(got, pa.float64())], [*columns, name])
                    at, some, held = i, [], 0
        del scorer
        give_back()

    return read.mapInArrow(score, StructType([*(read.schema[c] for c in columns), StructField(name, DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = with_scores(docs, labels, ["doc_id"], "score", **params)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """docs without the rows whose text is predicted toxic, with all their columns; what else has a row's doc_id does not matter."""
    name = fresh("score")
    return with_scores(docs, labels, docs.columns, name, **params).filter(F.col(name) < LIMIT).drop(name)
