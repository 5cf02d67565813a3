"""Operator 13 against a plain version over spans of bytes."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_llm import SOME, documents

TEXTS = [
    SOME, SOME, None, "", " ", "  \n\t x", "a▁b", "<|endoftext|> <s></s><unk><0x0A>", "日本語テキスト héllo 😀👍🏽", "‍﻿\x85\xa0 ²³½ it's We'LL", "naïve—“q”",
    "a\r\n\r\nb \n c   ", "x" * 3000, " " * 6000 + "end", "x", "déjà vu " * 200, "ΑΣΣ İ  ǅ", "áb", "tab\tand  two  blanks",
]


def paths():
    from public_tokenizers import path

    return path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def plain_tokens(texts):
    """(A spans, B spans) of each text: (start, end, id), by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths()[0]), sentencepiece.SentencePieceProcessor(model_file=paths()[1])
    a.encode_special_tokens = True
    letters = {}
    n = 0
    for x in range(256):
        if 0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or x >= 0xAE:
            letters[chr(x)] = x
        else:
            letters[chr(256 + n)] = x
            n += 1
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    out = []
    for t in texts:
        sides = []
        if t:
            for pairs in ([(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids], [(i, piece(b.id_to_piece(i))) for i in b.encode(t)]):
                at, spans = 0, []
                for i, x in pairs:
                    spans.append((at, at + len(x), i))
                    at += len(x)
                sides.append(spans if b"".join(x for _, x in pairs) == (" " + t).encode() else None)
        out.append(sides if sides and None not in sides else [[], []])
    return out


def plain(texts):
    tokens = plain_tokens(texts)
    links = [[(x, y) for s, e, x in a for u, v, y in b if max(s, u) < min(e, v)] for a, b in tokens]
    counts = Counter(x for own in links for x in own)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    rows = []
    for (a, b), own in zip(tokens, links, strict=True):
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        parts = ["|".join(",".join(str(i) for s, e, i in side if s >= lo and e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        sha = hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(cuts), len(own), sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), sha))
    return rows


def found(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_alignment_against_plain_spans(spark):
    from meshlark.llm.alignment import align_tokens

    docs = documents(spark, [(i, t, None) for i, t in enumerate(TEXTS)]).withColumns({c: F.lit(7) for c in ("key", "n", "n_a", "packed", "path")})
    got = found(align_tokens(docs.repartition(3), *paths()))
    want = dict(enumerate(plain(TEXTS)))
    assert got == want and got[6] == (0, 0, 0, 0, 0, 0, "") == got[2]


def test_alignment_of_slices_and_repeated_rows(spark, monkeypatch):
    from meshlark.llm import alignment

    for name, n in (("CHARACTERS", 50), ("HELD", 20), ("LOOKED_UP", 30), ("REMEMBERED", 900)):
        monkeypatch.setattr(alignment, name, n)
    few = [t for t in TEXTS if len(t or "") < 700]
    out = alignment.Aligner(*paths())
    whole, alone = out(few), [out([t]) for t in few]
    assert np.array_equal(whole.keys, np.concatenate([x.keys for x in alone])) and whole.groups() == [x.groups()[0] for x in alone]
    assert alignment.align_tokens(documents(spark, []), *paths()).count() == 0
    twice = found(alignment.align_tokens(documents(spark, [(i // 2, "so it goes", "a") for i in range(4)]), *paths()))
    assert twice[0] == twice[1] == plain(["so it goes"] * 4)[0]


def test_pair_counts(spark):
    from meshlark.llm.alignment import pair_counts

    want = Counter((x, y) for a, b in plain_tokens(TEXTS[:6]) for s, e, x in a for u, v, y in b if max(s, u) < min(e, v))
    assert {(r.a_id, r.b_id): r.n for r in pair_counts(documents(spark, [(i, t, None) for i, t in enumerate(TEXTS[:6])]), *paths()).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_packed_keys(seed):
    from meshlark.llm.alignment import packed_keys, unpacked_keys

    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(0, 1 << 47, seed * 50))
    times = rng.integers(1, 1 << 30, len(keys))
    k, t = unpacked_keys(packed_keys(keys, times), len(keys))
    assert np.array_equal(k, keys) and np.array_equal(t, times)
