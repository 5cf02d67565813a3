"""Operator 11 against a plain version over sets of windows, and its construction against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ..conftest import DATA
from .test_llm import SOME, documents


def plain(rows, length=50):
    """rows (doc_id, text) -> one result per row."""
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for a in range(len(b) - length + 1 if i is not None else 0):
            w = b[a : a + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1 if i is not None else 0):
            if first[b[a : a + length]] < i:
                gone[a : a + length] = True
        spans = int(np.sum(gone & ~np.append(False, gone[:-1]))) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "räth", "entwick", "passage", "noun", "a", "zz"]) + str(rng.randrange(30)) for _ in range(n))


def mixed_rows():
    rng = random.Random(5)
    shared = [words(rng, 25) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randrange(1, 40)) for _ in range(3)]
        parts.insert(rng.randrange(4), shared[rng.randrange(4)])
        rows.append((rng.randrange(1000), (" " if i % 2 else "\n").join(parts)))
    copies = [(2000 + i, rows[3][1]) for i in range(20)] + [(3000 + i, rows[4][1].replace("noun", "verb", 1)) for i in range(20)]
    odd = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 3000), (6, "y" + "x" * 200 + "z"), (None, rows[5][1]), (None, "x" * 100), (7, SOME), (7, SOME), (8, SOME + SOME), (9, "é" * 40), (10, "aé" + "é" * 60), (-3, shared[0])]
    return rows + copies + odd


@pytest.mark.parametrize("small", [False, True])
def test_repeats_against_sets_of_windows(spark, monkeypatch, small):
    from meshlark.llm import repeats

    if small:  # many packs, places, buckets and collections, and values that count as frequent
        for name, n in (("PACK", 3000), ("AT_ONCE", 400), ("VALUES", 100), ("BUCKET", 4000), ("COLLECTION", 500), ("FREQUENT", 3)):
            monkeypatch.setattr(repeats, name, n)
    rows = mixed_rows()
    docs = documents(spark, [(i, t, None) for i, t in rows]).withColumns({c: F.lit(1) for c in ("pack", "ids", "sizes", "bytes", "place", "codes")})
    assert found(repeats.without_repeats(docs.repartition(3))) == plain(rows)


def test_repeats_on_the_table(spark):
    from meshlark.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op11_repeated_passages(spark, DATA)) == plain(rows)


def test_repeats_keep_the_other_bytes(spark):
    from meshlark.llm.repeats import without_repeats

    out = {r.doc_id: bytes(r.kept) for r in without_repeats(documents(spark, [(1, SOME, "a"), (2, f"before {SOME} after", "a")]), with_text=True).collect()}
    assert out == {1: SOME.encode(), 2: b"before  after"}
    assert without_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("units", [(2,), (5, 2)])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_columns_against_sorted_suffixes(letters, units):
    from meshlark.llm.repeats import LENGTH, Collection

    rng = random.Random(len(letters))
    base = bytes(rng.choice(letters.encode()) for _ in range(300))
    pieces = list({base[(a := rng.randrange(220)) : a + LENGTH + rng.randrange(31)] for _ in range(40)} | {b"a" * 60, b"a" * 50})
    built, u = Collection(pieces, units), units[0]
    strings = [[p[i : i + u] for i in range((len(p) - f) % u, len(p) - f - u + 1, u)] for f in range(u) for p in pieces]
    # by the bytes' places as the symbols' numbers have them
    suffixes = sorted(tuple(int.from_bytes(x, "little") for x in s[i:]) for s in strings for i in range(len(s)))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    want = [min(LENGTH // u, common(a, b)) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    assert built.prefixes.read()[len(strings) :].tolist() == [0, *want]
    assert np.count_nonzero(built.transform.read() != 0xFFFF) == len(suffixes) == len(built.transform.read()) - len(strings)
    docs = [rng.randrange(100) for _ in pieces]
    least = {}
    for p, d in zip(pieces, docs, strict=True):
        for i in range(len(p) - LENGTH + 1):
            least[p[i : i + LENGTH]] = min(d, least.get(p[i : i + LENGTH], d))
    assert built.first_documents(np.array(docs)).tolist() == [least[p[i : i + LENGTH]] for p in pieces for i in range(len(p) - LENGTH + 1)]
    built.close()


def test_only_pieces_that_may_share_a_window_are_transformed(monkeypatch):
    """Pieces that share a run of 20 bytes and no more enter no collection; the others get each window's least document."""
    from meshlark.llm import repeats

    entered, build = [], repeats.Collection
    monkeypatch.setattr(repeats, "Collection", lambda pieces: entered.extend(pieces) or build(pieces))
    rng = random.Random(3)
    text = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    value = lambda p: len(set(repeats.window_values(p).tolist())) == 1
    gram = text(20)
    grams = [p for p in (text(15) + gram + text(15) for _ in range(400)) if value(p)]
    assert [x.tolist() for x in repeats.first_documents(grams, list(range(len(grams))), [0] * len(grams))] == [[d] for d in range(len(grams))]
    assert len(grams) > 2 and not entered and repeats.meeting([]) == []
    # cut from one text, each at windows of one value
    base = text(4000)
    values = repeats.window_values(base)
    cuts = {(int(a), int(b)) for a in range(len(values)) for b in [a + rng.randrange(1, 32)] if len(set(values[a:b].tolist())) == 1 and b <= len(values)}
    pieces = sorted({base[a : b + repeats.LENGTH - 1] for a, b in cuts})
    docs, least = [rng.randrange(100) for _ in pieces], {}
    for p, d in zip(pieces, docs, strict=True):
        for i in range(len(p) - repeats.LENGTH + 1):
            least[p[i : i + repeats.LENGTH]] = min(d, least.get(p[i : i + repeats.LENGTH], d))
    found = repeats.first_documents(pieces + grams, docs + [200] * len(grams), [0] * (len(pieces) + len(grams)))
    assert [x.tolist() for x in found[: len(pieces)]] == [[least[p[i : i + repeats.LENGTH]] for i in range(len(p) - repeats.LENGTH + 1)] for p in pieces]
    assert entered and not set(entered) & set(grams)


def test_a_value_is_frequent_by_its_runs():
    """A value that 5,000 packs hold once each has few pieces and stays whole; one of very many runs goes by its windows."""
    import pyarrow as pa

    from meshlark.llm import repeats

    runs = lambda *n: repeats.compress(np.array(n, np.uint16))
    marks = np.array([7, 9], np.uint32).tobytes()
    table = pa.table({"pack": list(range(5000)), "place": [0] * 5000, "n": [2] * 5000, "marks": pa.array([marks] * 5000, pa.binary()), "runs": pa.array([runs(1, 14)] * 5000, pa.binary())})
    codes = [repeats.decompress(x.as_py(), np.uint8, 2).tolist() for x in repeats.judged(table)["codes"]]
    assert codes == [[1, 2]] * 5000
    alone = pa.table({"pack": [1], "place": [0], "n": [2], "marks": pa.array([marks], pa.binary()), "runs": pa.array([runs(65535, 1)], pa.binary())})
    assert repeats.decompress(repeats.judged(alone)["codes"][0].as_py(), np.uint8, 2).tolist() == [0, 0]
