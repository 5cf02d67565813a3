"""The ten operators: odd rows of every kind, brute force where SQL cannot say it, and exact round trips."""

import hashlib
import io
import math
import os
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ..conftest import DATA, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, tokens string, hash string"
SOME = " ".join(f"word{i}" for i in range(60))


def documents(spark, rows):
    """rows (doc_id, text, source): with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, s, None, 7, "x", "y") for i, t, s in rows], DOCS)


ODD = [
    (1, SOME, "a"), (2, SOME, "a"), (2, SOME, "a"), (3, None, "a"), (4, "", None), (5, "  \n\t ", "b"), (6, "one two", "b"), (7, "ONE two!", "b"),
    (None, "no id at all", "c"), (8, SOME.replace("word30", "other"), "c"), (9, "déjà vu " * 30000, "c"), (10, "x" * 200000, "c"), (11, SOME.upper(), "c"),
]


def odd(spark):
    return documents(spark, ODD)


def test_registered():
    import __spark_entry__ as e

    names = {q.split("_")[0] for q in e.queries() if q.startswith("op")}
    assert names >= {f"op{i}" for i in range(1, 11)} and "pipeline" in e.queries()


@pytest.mark.parametrize("name", ["op1_temperature_mixing", "op2_exact_dedup", "op3_warc_packages", "op4_embedding_near_dedup", "op6_license_scan", "op8_ngram_jaccard", "op10_chat_snapshots"])
def test_query_equals_sql(spark, duck, name):
    from meshlark.llm import queries

    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


# 1
def test_mixing_odd_rows(spark):
    from meshlark.llm.mixing import mix, mixed_documents

    out = mix(odd(spark)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in ODD}
    assert {r.source for r in out} == {"a", "b", "c", None}
    for b in {r.block_id for r in out}:
        assert sorted(r.slot for r in out if r.block_id == b) == list(range(sum(r.block_id == b for r in out)))
    assert mix(odd(spark).limit(0)).count() == 0
    back = mixed_documents(odd(spark).withColumns({"__again": F.lit(1), "t": F.lit(2), "quota": F.lit(3), "s": F.lit(4), "key": F.lit(5)})).drop("__again", "t", "quota", "s", "key")
    assert back.columns == odd(spark).columns and back.filter("doc_id = 2").count() % 2 == 0
    assert {r.doc_id for r in back.select("doc_id").distinct().collect()} == {r[0] for r in ODD}


@pytest.mark.parametrize("limits", [{"max_repetition": 2.0}, {"max_repetition": None, "min_entropy": 0.9}, {"max_repetition": 3.0, "budget": 1500}])
def test_mixing_meets_its_limit(spark, limits):
    from meshlark.llm.mixing import mix

    rows = [(i, "w " * 9, "big") for i in range(100)] + [(1000 + i, "w " * 9, "mid") for i in range(30)] + [(2000 + i, "w " * 9, "small") for i in range(5)]
    out = mix(documents(spark, rows), block_tokens=100, **limits).collect()
    w = {r.source: r.weight for r in out}
    assert abs(sum(w.values()) - 1) < 1e-6
    tokens = {s: sum(r.tokens for r in out if r.source == s) for s in w}
    budget = limits.get("budget") or max(t * 10 / w[s] for s, t in (("big", 100), ("mid", 30), ("small", 5)))
    assert all(abs(tokens[s] - w[s] * budget) <= 10 + 1e-6 for s in w)
    assert all(sum(r.epoch == e and r.source == s for r in out) == len({r.doc_id for r in out if r.epoch == e and r.source == s}) for s in w for e in range(5))
    if limits.get("min_entropy"):
        assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(0.9, abs=1e-4)


@pytest.mark.parametrize("limits", [{}, {"max_repetition": None, "min_entropy": 0.95, "budget": 3000}, {"budget": 700}])
def test_mixed_documents_equal_the_deal(spark, limits):
    """Repeated rows are those that the mixture deals, and the exponent is that of a plain bisection."""
    from meshlark.llm.mixing import mix, mixed_documents

    rows = [(i % 90, "w " * (5 + i % 7), ["big", "big", "big", "mid", None][i % 5]) for i in range(150)] + [(500 + i, "w w", "tiny") for i in range(4)] + [(3, "w " * 8, "big")] * 3
    d = documents(spark, rows)
    dealt = mix(d, block_tokens=100, **limits).collect()
    want = {}
    for r in dealt:
        k = (r.doc_id, r.source, r.tokens // r.copies)
        want[k] = want.get(k, 0) + r.copies
    got = mixed_documents(d, block_tokens=100, **limits).select("doc_id", "source", "text").collect()
    have = {}
    for r in got:
        k = (r.doc_id, r.source, len(r.text.split()) + 1)
        have[k] = have.get(k, 0) + 1
    assert have == want
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split()) + 1
    p, lo, hi = np.array(list(tokens.values())) / sum(tokens.values()), 0.0, 1.0
    for _ in range(60):
        a = (lo + hi) / 2
        w = p**a / (p**a).sum()
        if limits.get("min_entropy"):
            down = -(w * np.log(w)).sum() < 0.95
        else:
            rate = w / p
            down = (rate.max() / rate.min() if not limits else rate.max() * 700 / sum(tokens.values())) <= 1.5
        lo, hi = (lo, a) if down else (a, hi)
    assert dealt[0].alpha == pytest.approx(lo if limits.get("min_entropy") else hi, abs=1e-9)


# 2
def test_exact_dedup_odd_rows(spark):
    from meshlark.llm.dedup_exact import drop_copies, exact_groups

    out = exact_groups(odd(spark)).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert (by[1].keep_id, by[1].group_size, by[1].kept) == (2, 3, False)
    assert by[3].keep_id == 4 and by[4].kept and by[None].keep_id is None and by[None].kept
    assert by[9].text_sha256 == hashlib.sha256(ODD[10][1].encode()).hexdigest()
    left = drop_copies(odd(spark))
    assert left.columns == odd(spark).columns and sorted((r.doc_id or 0) for r in left.select("doc_id").collect()) == [0, 2, 4, 5, 6, 7, 8, 9, 10, 11]
    assert exact_groups(odd(spark).limit(0)).count() == 0


def test_exact_dedup_checks_bytes(spark):
    """A digest that clashes does not join different texts; state goes on over several batches."""
    from meshlark.llm.dedup_exact import exact_groups

    d = documents(spark, [(i, "abc"[i % 3] * (1 + i % 2), "s") for i in range(60)]).repartition(6)
    weak = exact_groups(d, digest=lambda c: F.unhex(F.hex(F.length(c))), files_per_batch=2).drop("locator")
    assert sorted(weak.collect()) == sorted(exact_groups(d).drop("locator").collect())


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    """Documents of a later call meet those of an earlier one, checked on the earlier file's bytes."""
    from meshlark.llm.dedup_exact import drop_copies, exact_groups

    batches = [[(1, "a", "s"), (2, "b", "s"), (3, "a", "s"), (4, None, "s")], [(5, "b", "s"), (0, "a", "s"), (6, "c", "s"), (7, "", "s")], [(8, "c", "s")]]
    seen, state = [], f"file://{tmp_path}/state"
    for i, rows in enumerate(batches):
        documents(spark, rows).write.parquet(f"{tmp_path}/docs{i}")
        seen += [(d, t or "") for d, t, _ in rows]
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_groups(spark.read.parquet(f"{tmp_path}/docs{i}"), state_dir=state).collect()}
        of = lambda t: [d for d, x in seen if x == (t or "")]  # noqa: B023, E731
        assert got == {d: (max(of(t)), len(of(t)), d == max(of(t))) for d, t, _ in rows}
    # a call that is repeated counts its documents once
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(spark.read.parquet(f"{tmp_path}/docs2"), state_dir=state).collect()}
    assert got == {8: (8, 2)}
    clash = lambda c: F.unhex(F.hex(F.length(c)))
    for i in range(2):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(spark.read.parquet(f"{tmp_path}/docs{i}"), digest=clash, state_dir=f"{state}2").collect()}
    assert got == {5: (5, 2), 0: (3, 3), 6: (6, 1), 7: (7, 2)}
    d = documents(spark, batches[0]).withColumn("__sha", F.lit("mine")).withColumn("sha", F.lit("too"))
    left = drop_copies(d)
    assert left.columns == d.columns and {(r["doc_id"], r["__sha"], r["sha"]) for r in left.collect()} == {(i, "mine", "too") for i in (2, 3, 4)}


# 3
@pytest.mark.parametrize("always64", [False, True])
def test_packages(spark, tmp_path, always64):
    from meshlark.llm.warc_zip import find_packages, list_packages, read_packages, write_packages

    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nx", None), (4, "u", ""), (None, "u", "z" * 300000), (5, "u", "z" * 300000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    made = write_packages(pages, f"file://{tmp_path}/w", always64=always64)
    assert made.agg(F.sum("records")).first()[0] == len(rows)
    for orphan in ("part-000000-999-0000.wacz", "half.wacz"):  # what a lost attempt leaves
        (tmp_path / "w" / orphan).write_bytes(b"PK broken")
    got = read_packages(find_packages(spark, f"file://{tmp_path}/w"), with_payload=True).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted([(1, 9, "response", None), (2, 9, "revisit", 1), (2, 9, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (0, 300000, "revisit", 5), (5, 300000, "response", None)])
    assert {bytes(r.payload) for r in got if r.payload is not None} == {"<p>é</p>".encode(), b"", b"z" * 300000}
    for p in made.collect():  # another reader agrees with the archive
        with zipfile.ZipFile(p.path.removeprefix("file://").removeprefix("file:")) as z:
            assert z.testzip() is None and set(z.namelist()) == {"archive/data.warc.gz", "indexes/index.cdxj"}
    listed = list_packages(spark, f"file://{tmp_path}/w").filter("path NOT LIKE '%half%' AND path NOT LIKE '%-999-%'")
    assert read_packages(listed).count() == len(rows)
    none = write_packages(pages.limit(0), f"file://{tmp_path}/none", always64=always64)
    assert none.isEmpty() and read_packages(none).isEmpty()


def test_packages_are_read_side_by_side(spark, tmp_path, monkeypatch):
    from meshlark.llm import warc_zip

    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html")).repartition(6)
    made = warc_zip.write_packages(pages, f"file://{tmp_path}/w")
    read = warc_zip.read_packages(made)
    tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert made.count() >= 2 and tasks >= min(made.count(), 4) - 1 and read.count() == 400


def test_members_of_foreign_archives():
    from meshlark.llm.warc_zip import stored_members

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a", b"12345")
        z.writestr(zipfile.ZipInfo("b"), b"packed" * 9, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 is no end record here"
    raw = b.getvalue()
    found = stored_members(lambda at, n: raw[at : at + n], len(raw))
    assert set(found) == {"a"} and raw[found["a"][0] :][: found["a"][1]] == b"12345"
    with pytest.raises(ValueError):
        stored_members(lambda at, n: raw[at : at + n], len(raw) // 2)


# 4
def test_vectors_against_brute_force(spark):
    from meshlark.llm.near_vectors import near_vectors

    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16)).astype(np.float32)
    x = [base[i % 40] + rng.standard_normal(16).astype(np.float32) * [0.01, 0.2, 0.35][i % 3] for i in range(300)]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] * 16), (305, [float("inf")] + [0.0] * 15), (306, [1.0]), (307, [float(v) for v in x[0]]), (307, [float(v) for v in x[0]])]
    d = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, block int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(d, tile=64).collect()}
    assert got == {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(d.withColumn("embedding", F.col("embedding").cast("array<double>")), tile=50).collect()}
    v = np.array([*x, x[0]], np.float64)
    ids = [*range(300), 307]
    c = (v @ v.T) / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(v, axis=1)[None, :] >= 0.95
    np.fill_diagonal(c, False)
    root = np.array(ids)
    for _ in range(400):
        root = np.minimum(root, np.where(c, root[None, :], 10**6).min(1))
    want = {i: (int(n), int(r), i == r) for i, n, r in zip(ids, c.sum(1), root, strict=True)} | {i: (0, i, True) for i in range(300, 307)}
    assert got == want
    assert near_vectors(d.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    """Links count other ids once, whatever the number and length of their vectors; null ids link with nothing."""
    from meshlark.llm.near_vectors import near_vectors

    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.001, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0]), (4, [0.0, 0.0, 1.0]), (None, [1.0, 0.0]), (None, None), (5, [-1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for tile in (2, 64):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(d, tile=tile).collect()}
        assert got == {1: (1, 1, True), 2: (2, 1, False), 3: (1, 1, False), 4: (0, 4, True), 5: (0, 5, True), None: (0, None, True)}


@pytest.mark.parametrize("dim", [3, 64, 1500, 8192])
def test_tile_products_lose_no_link(dim):
    """Pairs at the threshold, against double precision, at any dimension."""
    from meshlark.llm.near_vectors import operands, quantise, tile_links

    rng = np.random.default_rng(dim)
    x = rng.standard_normal((60, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((60, dim))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.95 * x + np.sqrt(1 - 0.95**2) * y + rng.uniform(-1e-12, 1e-12, (60, 1)) * y
    exact = np.einsum("ij,ij->i", x, z) / np.linalg.norm(x, axis=1) / np.linalg.norm(z, axis=1) >= 0.95
    block = lambda v: (np.arange(60), v, *operands(*quantise(v / np.linalg.norm(v, axis=1, keepdims=True))), np.linalg.norm(v, axis=1))
    assert (np.diag(tile_links(block(x), block(z), 0.95)) == exact).all()


def test_quantisation_bound_holds():
    from meshlark.llm.near_vectors import quantise

    x = np.random.default_rng(0).standard_normal((200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = quantise(x)
    about = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(x @ x.T - about) <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()


# 5
def tokenizer_path():
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def test_packing_against_the_library(spark):
    from tokenizers import Tokenizer

    from meshlark.llm.packing import pack

    out = pack(odd(spark), tokenizer_path()).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    for doc, text, _ in ODD:
        if doc == 2:
            continue
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in out if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert pack(odd(spark).limit(0), tokenizer_path()).count() == 0


def test_packing_spreads_long_documents(spark):
    """Full pieces are sequences of their own, so that a few long documents are no single task."""
    from meshlark.llm.packing import FULL, pack

    out = pack(documents(spark, [(i, "word " * 50_000, None) for i in range(8)]), tokenizer_path()).collect()
    full = [r for r in out if r.length == 2048]
    assert len(full) == 8 * 24 == len({r.sequence_id for r in full}) and all(r.sequence_id >= FULL and r.offset == 0 for r in full)
    assert all(r.sequence_id < FULL for r in out if r.length < 2048) and sum(r.length for r in out) == 8 * 50_001


def test_first_fit_against_a_scan():
    from meshlark.llm.packing import first_fit_decreasing

    sizes = np.random.default_rng(1).integers(1, 2049, 500)
    seq, off = first_fit_decreasing(sizes)
    room, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if at == len(room):
            room.append(2048)
        want[i] = (at, 2048 - room[at])
        room[at] -= sizes[i]
    assert all((seq[i], off[i]) == want[i] for i in want)


@pytest.mark.parametrize("text", ["", " \x1c\x85\xa0", "<|endoftext|> a<|endoftext|>b", "it's We'LL 'S", "ΑΣΣ İ", "a ́b é", "²³½ 12,5..,x", "naïve—“quote”"])
def test_ids_equal_the_library(text):
    from tokenizers import Tokenizer

    from meshlark.llm.packing import WordIds

    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert WordIds(tokenizer_path()).many([text])[0] == np.array(want, "<u4").tobytes()


# 6
def test_licenses(spark):
    from meshlark.llm.licenses import NOTICES, scan_licenses

    apache = next(k for k, v in NOTICES.items() if v == "apache-2")
    bsd = next(k for k, v in NOTICES.items() if v == "bsd").split()
    rows = [(20, "Under the MIT License, under-the-mit license!", "a"), (21, f"x {apache.title()} y", "a"), (22, "mit license", "a"), (23, " ".join([*bsd[:9], "lost", *bsd[10:]]), "a"), (24, "CC BY-NC", "a")]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, [*ODD, *rows])).collect()}
    assert len(got) == len({r[0] for r in [*ODD, *rows]})
    assert (got[20].n_base, got[20].first_word, got[20].last_word, got[20].base_labels, got[20].score) == (2, 0, 4, "mit", 1.0)
    assert (got[21].n_base, got[21].labels, got[21].first_word) == (1, "apache-2", 4)
    assert (got[22].labels, got[22].n_base, got[22].first_word) == ("", 0, None)
    assert (got[23].base_labels, got[23].labels) == ("", "bsd") and 0.6 <= got[23].score < 1
    assert got[24].base_labels == "cc-by-nc" and got[3].n_words == 0 and got[9].n_words == 60000
    assert scan_licenses(odd(spark).limit(0)).count() == 0


def test_each_notice_has_its_own_label(spark):
    from meshlark.llm.licenses import NOTICES, scan_licenses

    notices = list(NOTICES.items())
    rows = [(i, f"some words before {w.title()}, and some after", "a") for i, (w, _) in enumerate(notices)]
    by = {v: k for k, v in notices}
    rows += [(50, f"{by['gpl']} . {by['lgpl']}", "a"), (51, f"{by['cc-by']} " + "x " * 30 + by["cc-by-nc"], "a"), (52, "CC BY-NC: " + by["cc-by"], "a"), (53, by["cc-by-nc"].replace("noncommercial", "NonCommercial-ShareAlike"), "a")]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, rows)).collect()}
    assert {i: got[i].labels for i in range(len(notices))} == {i: v for i, (_, v) in enumerate(notices)}
    assert (got[50].labels, got[51].labels, got[52].labels) == ("gpl,lgpl", "cc-by,cc-by-nc", "cc-by,cc-by-nc")
    assert got.pop(53).labels == "cc-by-nc,cc-by-sa"
    assert all(r.score == 1 and {s.label for s in r.spans} == set(r.labels.split(",")) for r in got.values())


# 7
def test_sharding(spark):
    from meshlark.llm.sharding import lpt, shard

    rows = [*ODD, *[(100 + i, f"text {i % 150} " * (1 + i % 7), "z") for i in range(1200)]]
    out = shard(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    place = {r.doc_id: r.shard for r in out}
    same = {}
    for i, t, _ in rows:
        assert same.setdefault(t or "", place[i]) == place[i]
    for s in range(40):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert lpt([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], [], 2) == ({"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}, [])
    assert shard(odd(spark).limit(0)).count() == 0


def test_turns_against_a_plain_heap():
    """Equal items dealt at once, against one by one; classes against their single items."""
    import heapq

    from meshlark.llm.sharding import lpt, take_turns

    rng = np.random.default_rng(4)
    for _ in range(60):
        loads, size, count = [float(x) for x in rng.integers(0, 90, rng.integers(1, 9))], float(rng.integers(1, 30)), int(rng.integers(1, 70))
        heap, got = [(x, s) for s, x in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            load, s = heap[0]
            got[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        assert take_turns(loads, size, count) == got
    large, classes = [(900, "a"), (700, "b")], [(5, 33, 33 * 50), (3, 500, 500 * 7)]
    place, dealt = lpt(large, classes, 4)
    loads = [sum(s for s, n in large if place[n] == k) + sum((e - f) * {5: 50, 3: 7}[c] for c, f, e, x in dealt if x == k) for k in range(4)]
    assert sum(loads) == 900 + 700 + 33 * 50 + 3500 and max(loads) - min(loads) <= 7
    for c, n, _ in classes:
        runs = sorted((f, e) for x, f, e, _ in dealt if x == c)
        assert runs[0][0] == 0 and runs[-1][1] == n and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))


def test_shards_are_nearly_equal(spark):
    """Law `bytes` over the documents: shards differ by less than a hundredth where no group is larger than that."""
    from meshlark.llm.sharding import shard

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = shard(d, 8)
    loads = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.01 * sum(loads) / 8
    assert out.join(d, "doc_id").groupBy(F.coalesce("text", F.lit(""))).agg(F.count_distinct("shard").alias("n")).filter("n > 1").isEmpty()


# 8
def test_near_text_odd_rows(spark):
    from meshlark.llm.near_text import drop_near_copies, near_groups

    out = near_groups(odd(spark)).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert (by[1].class_id, by[1].set_id, by[1].n_links) == (1, 1, 4) and by[11].set_id == 1 and by[8].class_id == 1 and by[8].n_links == 4
    assert by[7].set_id == 6 and by[3].n_links == 0 and by[3].kept and by[4].kept and by[5].kept
    left = drop_near_copies(odd(spark))
    assert left.columns == odd(spark).columns and sorted((r.doc_id or 0) for r in left.select("doc_id").collect()) == [0, 1, 3, 4, 5, 6, 9, 10]
    assert near_groups(odd(spark).limit(0)).count() == 0


def test_near_text_large_group(spark, monkeypatch):
    """A group over several blocks and size bands keeps every link, against all pairs."""
    from meshlark.llm import near_text

    monkeypatch.setattr(near_text, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, 80)] = f"n{rng.integers(0, 30)}"
        rows.append((i, " ".join(words[: 80 - int(rng.integers(0, 20))]), "s"))
    got = {r.doc_id: (r.n_links, r.class_id) for r in near_text.near_groups(documents(spark, rows), target=0.999999).collect()}
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t, _ in rows]
    link = [[i != j and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(120))
    for _ in range(120):
        root = [min([root[i], *(root[j] for j in range(120) if link[i][j])]) for i in range(120)]
    assert got == {i: (sum(link[i]), root[i]) for i in range(120)}


def test_near_copies_go_by_id_and_text(spark):
    """Rows that share a doc_id, or have none, go only for their own text, and one row of each group stays."""
    from meshlark.llm.near_text import drop_near_copies

    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    near = lambda p: text(p).replace(f"{p}59", "other")
    rows = [
        (1, text("a"), "s"), (None, near("a"), "s"), (None, text("b"), "s"),  # a null id's near copy; a unique text without id
        (5, near("a"), "s"), (5, text("c"), "s"), (7, near("c"), "s"),  # under 5: a near copy, and the first of its own group
        (None, text("d"), "s"), (None, near("d"), "s"), (None, text("d").upper(), "s"),  # a group without any id
        (9, text("e"), "s"), (9, near("e"), "s"), (9, text("e"), "s"),  # one id, two near texts and a repeated row
        (10, "", "s"), (10, "", "s"), (None, None, "s"),
    ]
    left = [(r.doc_id, (r.text or "-").lower().split()[0][0]) for r in drop_near_copies(documents(spark, rows)).select("doc_id", F.when(F.col("text") != "", F.col("text")).alias("text")).collect()]
    assert sorted(left, key=str) == sorted([(1, "a"), (None, "b"), (5, "c"), (None, "d"), (9, "e"), (10, "-"), (10, "-"), (None, "-")], key=str)


def test_forest_depth_meets_its_recall():
    from meshlark.llm.near_text import MAX_DEPTH, forest_depth, prefix_recall

    d = forest_depth(0.8, 0.9999, [])
    assert prefix_recall(0.8**d) >= 0.9999 > prefix_recall(0.8 ** (d + 1))
    # shortened further where fewer trees meet than the formula has it, never less
    assert forest_depth(0.8, 0.9999, [0.75**d for d in range(1, MAX_DEPTH + 1)]) < d
    assert forest_depth(0.8, 0.9999, [1.0] * MAX_DEPTH) == d
    assert forest_depth(1.0, 0.9999, [1.0] * MAX_DEPTH) == MAX_DEPTH
    assert [forest_depth(t, 0.9999, []) for t in (0.55, 0.4)] == [2, 1]
    with pytest.raises(ValueError, match="recall"):
        forest_depth(0.2, 0.9999, [])


def test_planted_partners_lie_at_the_threshold():
    from meshlark.llm.near_text import planted_partner

    rng = np.random.default_rng(0)
    for n in (9, 10, 37, 100, 999):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        p = planted_partner(s, 0.8)
        j = len(np.intersect1d(s, p)) / len(np.union1d(s, p))
        assert 0.8 <= j <= 0.8 + 2 / n


@pytest.mark.parametrize("partitions", [1, 7])
def test_forest_ties_whole_nodes(spark, partitions):
    """Nodes of the sorted labels, within and across ranges, against grouping by prefix."""
    from meshlark.llm import near_text as N

    rng = np.random.default_rng(8)
    labels = rng.integers(0, 2, (60, N.TREES, N.MAX_DEPTH)) * 5
    packed = np.zeros((60, N.TREES), np.int64)
    for d in range(N.MAX_DEPTH):
        packed = packed << N.BITS | labels[:, :, d]
    nums = [int(x) for x in rng.permutation(60) * 1000 - 30000]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        classes = spark.createDataFrame([(nums[i], [int(x) for x in packed[i, :2]]) for i in range(60)], "num long, labels array<long>")
        got = N.components(N.candidate_edges(classes, 5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    root = {n: n for n in nums}
    for _ in range(60):
        for t in range(2):
            nodes = {}
            for i in range(60):
                nodes.setdefault(tuple(labels[i, t, :5]), []).append(nums[i])
            for node in nodes.values():
                least = min(root[x] for x in node)
                root |= dict.fromkeys(node, least)
    assert {r.u: r.root for r in got} == {n: r for n, r in root.items() if n != r}


def test_word_hashes():
    from meshlark.llm.words import grams, hash_of, shingle_sets, split_words

    texts = [b"", b"  ", b"one", b"a b c d e f a b c d e f", "d\u00e9j\u00e0 vu-x".encode(), b"x" * 9000 + b" y", b"x" * 9001 + b" y", b"12345678 123456789 1234567"]
    for t, s in zip(texts, shingle_sets(texts, 5), strict=True):
        w = split_words(t)
        want = set(grams(hash_of(w), min(5, len(w))).tolist()) if w else set()
        assert sorted(want) == s.tolist() and len(want) == len(set(zip(*[w[j:] for j in range(min(5, len(w)))], strict=False))) if w else not len(s)
    words = [bytes([c]) * n for c in b"abcxyz" for n in (*range(1, 40), 511, 512, 513, 600)]
    assert len(set(hash_of(words).tolist())) == len(words)


# 9
def test_toxicity_gradients():
    """The network's gradients equal finite differences."""
    from meshlark.llm import toxicity as X

    words = sorted({b"abc", b"de", b"fghij", b"k"})
    net, inputs = X.Network(3), X.word_inputs(words)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at = np.zeros((2, X.LENGTH), np.int64)
    at[0, :5], at[1, :3] = [1, 2, 3, 4, 1], [4, 4, 2]
    y, seen = np.array([1.0, 0.0]), np.ones((4, 1))

    def loss():
        z = net.run(net.gates(*inputs, seen)[1].astype(np.float64), at)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net.gradients(inputs, at, y, seen)
    for k, v in net.p.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old = v[i]
        v[i] = old + 1e-3
        up = loss()
        v[i] = old - 1e-3
        down = loss()
        v[i] = old
        assert (up - down) / 2e-3 == pytest.approx(float(np.asarray(g[k])[i]), rel=0.05, abs=1e-5), k


def test_toxicity_learns_and_odd_rows(spark):
    from meshlark.llm.toxicity import score_toxicity

    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu") for b in ("ran", "tel", "mos", "fip", "gu")]
    rows = []
    for i in range(360):
        t = [words[k] for k in rng.integers(0, len(words), rng.integers(20, 160))]
        if i % 4 == 0:
            t[int(rng.integers(0, len(t)))] = "grunz"
            t[int(rng.integers(0, len(t)))] = "grunzel"
        rows.append((1000 + i, " ".join(t), "s"))
    labels = spark.createDataFrame([(1000 + i, int(i % 4 == 0), 1) for i in range(360)] + [(None, 1, 1), (1, None, 0), (1000, 1, 0)], "doc_id long, toxic int, quality int")
    got = score_toxicity(documents(spark, [*ODD, *rows]), labels).collect()
    assert len(got) == len(ODD) + 360 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id >= 1000]
    assert {r.doc_id for r in held} == {1000 + i for i in range(360) if zlib.crc32(str(1000 + i).encode()) % 3 == 1}
    right = sum(r.predicted == int((r.doc_id - 1000) % 4 == 0) for r in held)
    assert right >= 0.9 * len(held)
    none = score_toxicity(odd(spark), labels.limit(0))
    assert none.count() == len(ODD) and none.filter("score <> 0 OR predicted <> 0").isEmpty()
    assert score_toxicity(odd(spark).limit(0), labels).count() == 0


def test_toxic_rows_go_by_their_own_text(spark):
    from meshlark.llm.toxicity import drop_toxic

    rng = np.random.default_rng(2)
    plain = lambda: [f"w{k}" for k in rng.integers(0, 40, 60)]
    rows = [(1000 + i, " ".join(plain() + ["grunzel"] * (i % 2)), "s") for i in range(300)]
    rows += [(i, " ".join(plain() + end), "s") for i in (None, 7) for end in ([], ["grunzel"], [])]
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(300)], "doc_id long, toxic int")
    d = documents(spark, rows)
    left = drop_toxic(d, labels)
    assert left.columns == d.columns
    got = [(r.doc_id, r.text) for r in left.collect() if r.doc_id is None or r.doc_id < 1000]
    assert sorted(got, key=str) == sorted([(i, t) for i, t, _ in rows[300:] if "grunzel" not in t], key=str)


def test_toxicity_reads_every_byte():
    """Runs of whole words enter, and blanks and punctuation outside ASCII separate words."""
    from meshlark.llm import toxicity as X

    for text in ("x" * 23 + "insult" * 40, "猫が好き" * 50 + "é" + "x" * 30, "ж" * 99, "a" * 25, "a" * 24, "😀" * 20):
        words, raw = X.words_of(text), text.encode()
        runs = {raw[i : i + n] for n in X.RUNS for i in range(len(raw) - n + 1)}
        assert runs <= {w[i : i + n] for w in words for n in X.RUNS for i in range(len(w) - n + 1)}
        assert all(len(w) <= X.LONGEST and w.decode() for w in words)
    assert X.words_of("Word—insult\u00a0“so” it’s…\u3000猫。犬\u200bx") == [w.encode() for w in ("word", "insult", "so", "it", "s", "猫", "犬", "x")]


def test_toxicity_finds_passages_behind_other_blanks():
    from meshlark.llm import toxicity as X

    rng = np.random.default_rng(4)
    letters, texts = [chr(0x4E00 + i) for i in range(60)], []
    for i in range(400):
        cjk = "".join(letters[k] for k in rng.integers(0, 60, 120))
        plain = [f"w{k}" for k in rng.integers(0, 40, 60)]
        if i % 2:
            cjk, plain[40] = cjk[:70] + "龘靐齉爩" + cjk[70:], "grunzel"
        texts += [(i % 2, cjk), (i % 2, " ".join(plain))]
    scorer = X.Scorer(X.fit([(y, X.words_of(t)) for y, t in texts[:600]]))
    for glue in (" ", "\u00a0", "\u2003", "—", "…"):
        got = scorer.many([t.replace(" ", glue) for _, t in texts[600:]]) >= X.LIMIT
        assert sum(got != np.array([y for y, _ in texts[600:]])) <= 10, glue


def test_toxicity_scores_do_not_depend_on_slices(monkeypatch):
    """Any number of windows at once, any table of words, against one window at a time; empty and very long texts."""
    from meshlark.llm import toxicity as X

    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 900, n)) for n in (1, 47, 48, 49, 72, 73, 5000)] + ["", None, "é" * 90, "x" * 500]
    net = X.Network(1)
    want = []
    for t in texts:
        ws = X.words_of(t)
        gates = np.zeros((len(ws) + 1, 6 * X.STATE), np.float32)
        net.fill_gates(ws, gates[1:])
        spans = [list(range(len(ws)))[s : s + X.LENGTH] for s in X.windows(len(ws))]
        want.append(max(float(net.run(gates, np.array([[i + 1 for i in s] + [0] * (X.LENGTH - len(s))]))[0]) for s in spans))
    monkeypatch.setattr(X, "WINDOWS", 7)
    monkeypatch.setattr(X, "REMEMBERED", 260)
    got = X.Scorer(net).many(texts)
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(want))), atol=1e-5)


def test_toxicity_sample_is_bounded_and_steady(spark):
    from meshlark.llm.toxicity import training_sample

    d = documents(spark, [(i % 50, f"text {i} " * (1 + 40 * (i == 60)), "s") for i in range(100)] + [(None, "none", "s")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    one = training_sample(d.repartition(5), labels, 20, 1000)
    assert one == training_sample(d.orderBy(F.desc("text")).coalesce(1), labels, 20, 1000) and 10 <= len(one) <= 20
    few = training_sample(d, labels, 20, 11)
    assert 0 < sum(len(w) for _, w in few) <= 11 and all(w in [x for _, x in one] for _, w in few)


# 10
def test_chats(spark):
    from meshlark.llm.chat import render_chats

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "b"), (None, 0, None, None), (5, 0, "user", None), (6, 5, "user", "a"), (6, 9, "assistant", "b"), (6, 9, "assistant", "b")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n string")
    got = {r.conv_id: (r.n_turns, r.n_equal) for r in render_chats(turns).collect()}
    assert got == {6: (3, 1), 4: (1, 1), None: (1, 1), 5: (1, 1)}
    lone = [(None, 3, None, None), (None, 0, "user", "b"), (None, 1, "user", "b"), (None, 9, "user", "a"), (None, 0, "x", "b" * 200000), (8, 0, "y", "z " * 100000)]
    more = spark.createDataFrame([*(r[:4] for r in rows), *lone], "conv_id long, turn long, role string, text string")
    out = render_chats(more).collect()
    assert sorted(((r.conv_id or 0), r.n_turns, r.n_equal) for r in out) == sorted([(6, 3, 1), (4, 1, 3), (0, 1, 2), (5, 1, 1), (0, 1, 1), (8, 1, 1)])
    assert max(len(r.rendered) for r in out) > 200000
    assert render_chats(turns.filter("conv_id = 4")).first().rendered == "<|im_start|>user\nb<|im_end|>\n"
    assert render_chats(turns.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Planted rows go where they should; clean ones stay whole to the end."""
    import corpus_pipeline as P

    rng = np.random.default_rng(9)
    clean = [(i, " ".join(f"c{i}x{k}" for k in range(40 + int(rng.integers(0, 60)))), f"s{i % 3}") for i in range(1, 60)]
    toxic = [(200 + i, " ".join(f"t{i}x{k}" for k in range(30)) + " grunz grunz", "s0") for i in range(30)]
    copies = [(300, clean[0][1], "s1"), (301, clean[1][1].replace("c2x7 ", "other "), "s1")]
    d = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in [*clean, *toxic, *copies]], "doc_id long, text string, lang string, source string, n_chars long")
    os.makedirs(tmp_path / "sf")
    d.write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200 and i < 300)) for i, _, _ in [*clean, *toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/sf/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    left = {r.doc_id for r in P.run(spark, f"{tmp_path}/sf").select("doc_id").distinct().collect()}
    assert left & set(range(1, 60)) >= set(range(3, 60)) and not left & {1, 301} and 300 in left
    assert len(left & set(range(200, 230))) <= 3


def stage_rows(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()), key=str)


def brute_near(rows):
    """One row of each group of similar texts, by all pairs."""
    from meshlark.llm.words import split_words

    sets = []
    for _, t, _ in rows:
        w = split_words((t or "").lower().encode())
        sets.append(frozenset(zip(*[w[j:] for j in range(min(5, len(w)))], strict=False)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [[rows[i] for i in g] for g in groups.values()]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on its own input: what the network says of each text, equal texts, all pairs, the mixture's limits, and
    the tokenizer; odd rows among them, and extra columns with the names that the operators use."""
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from meshlark.llm.toxicity import score_toxicity

    rng = np.random.default_rng(12)
    base = [" ".join(f"b{i}x{k}" for k in range(30 + 7 * (i % 9))) for i in range(40)]
    rows = [(i, base[i], f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, base[i].replace(f"b{i}x{9}", "other"), "s0") for i in range(0, 40, 4)] + [(200 + i, base[i], "s1") for i in range(0, 40, 5)] + [(200, base[0], "s1")]
    rows += [(300 + i, base[i] + " grunz" * 3, "s2") for i in range(40)] + [(400 + i, f"{base[i]} more words {i}", "s0") for i in range(0, 12)]
    rows += [(i, t, s) for i, t, s in ODD if s != "a"] + [(None, base[3].replace("b3x4", "new"), None), (None, base[5] + " tail", "s1"), (None, "", "s1"), (12, "\u732b" * 3000, "s1"), (12, "w " * 60000, "tiny")]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    names = ["row", "tokens", "hash", "__again", "__sha", "s", "key", "kept", "rank", "times", "sha", "n"]
    d = spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(len(names))) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, int(300 <= i < 400)) for i, _, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    d.write.parquet(f"{sf}/documents.parquet")
    stages, docs = dict(P.STAGES), spark.read.parquet(f"{sf}/documents.parquet")

    def run(name, docs):
        out = stages[name](spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        return spark.read.parquet(f"{sf}/{name}")

    # toxicity: a row goes if its text is predicted toxic
    bad = {r.doc_id for r in score_toxicity(docs.withColumn("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int")).collect() if r.predicted}
    assert not bad  # nothing to learn from: nothing is toxic
    clean = run("toxicity", docs)
    left, was = stage_rows(clean), stage_rows(docs)
    gone = list(was)
    for r in left:
        gone.remove(r)
    assert len(gone) == 40 and all("grunz" in t for _, t, _ in gone)

    # exact copies
    once = run("exact_dedup", clean)
    best = {}
    for r in left:
        k = r[1] or ""
        best[k] = max(best.get(k, r), r, key=lambda x: -1 if x[0] is None else x[0])
    assert sorted(str(r[0]) + (r[1] or "") for r in stage_rows(once)) == sorted(str(r[0]) + (r[1] or "") for r in best.values())

    # near copies
    apart = run("ngram_jaccard", once)
    kept = stage_rows(apart)
    for group in brute_near(stage_rows(once)):
        stay = [r for r in group if r in kept]
        assert len(stay) == 1 and (stay[0][0] is not None or all(r[0] is None for r in group))
        assert stay[0][0] == min((r[0] for r in group if r[0] is not None), default=None)

    # mixing: whole documents, sources by the temperature of the exact bound
    mixed = run("mixing", apart)
    times = {}
    for r in stage_rows(mixed):
        times[str(r)] = times.get(str(r), 0) + 1
    assert set(times) == {str(r) for r in kept} and max(times.values()) <= 2
    tokens = {}
    for _, t, s in kept:
        tokens[s] = tokens.get(s, 0) + len((t or "").split()) + 1
    got = {}
    for r in stage_rows(mixed):
        got[r[2]] = got.get(r[2], 0) + len((r[1] or "").split()) + 1
    # a = 1 - ln 1.5 / ln(most / least): the largest source once, the smallest up to 1.5 times
    a = 1 - math.log(1.5) / math.log(max(tokens.values()) / min(tokens.values()))
    longest = {s: max(len((t or "").split()) + 1 for _, t, x in kept if x == s) for s in tokens}
    for s in tokens:
        quota = tokens[s] ** a * max(tokens.values()) ** (1 - a)
        assert quota - 1 <= got[s] <= quota + longest[s] + 1

    # packing
    tok, pieces = Tokenizer.from_file(tokenizer_path()), {}
    out = run("packing", mixed).collect()
    for r in out:
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 and sorted(o for o, _ in p) == [sum(n for q, n in p if q < o) for o in sorted(o for o, _ in p)] for p in pieces.values())
    want = sorted((str(i), len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in stage_rows(mixed))
    assert sorted((str(r.doc_id), r.doc_tokens) for r in out if r.start == 0) == want
    assert sum(r.length for r in out) == sum(n for _, n in want)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    odd(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).isEmpty()


NAMES = ["s", "t", "key", "rows", "range", "epoch", "start", "quota", "docs", "cls", "num", "n", "sha", "labels", "met", "digest", "locator", "keep_id", "kept", "at", "part", "shard", "slot", "bytes", "copies", "place", "hash", "words", "row", "template", "label", "score", "predicted", "held_out", "__score", "__text", "__again", "__sha", "__bucket", "__place", "__map", "group", "length", "offset", "luck", "size"]


@pytest.mark.parametrize("op", ["mix", "exact", "pack", "license", "shard", "near", "toxic"])
def test_clashing_names(spark, op):
    """Extra columns of any name change no result."""
    from meshlark.llm import dedup_exact, licenses, mixing, near_text, packing, sharding, toxicity

    d = documents(spark, ODD[:9]).drop("row", "tokens", "hash")
    labels = spark.createDataFrame([(1, 0), (8, 1)], "doc_id long, toxic int")
    f = {
        "mix": mixing.mix, "exact": lambda x: dedup_exact.exact_groups(x).drop("locator"), "pack": lambda x: packing.pack(x, tokenizer_path()).drop("sequence_id", "offset"), "license": licenses.scan_licenses,
        "shard": lambda x: sharding.shard(x).drop("slot"), "near": near_text.near_groups, "toxic": lambda x: toxicity.score_toxicity(x, labels),
    }[op]
    plain, more = f(d), f(d.withColumns({n: F.lit("x") for n in NAMES}))
    assert plain.columns == more.columns and sorted(map(str, plain.collect())) == sorted(map(str, more.collect()))
    if op in ("exact", "near", "mix", "toxic"):
        g = {"exact": dedup_exact.drop_copies, "near": near_text.drop_near_copies, "mix": mixing.mixed_documents, "toxic": lambda x: toxicity.drop_toxic(x, labels)}[op]
        wide = d.withColumns({n: F.lit("x") for n in NAMES})
        out = g(wide)
        assert out.columns == wide.columns and {v for r in out.select(*NAMES).collect() for v in r} == {"x"}
