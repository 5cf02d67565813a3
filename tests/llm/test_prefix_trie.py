"""Operator 12 against a plain version over lists of turns."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ..conftest import DATA, rows_of

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, ends, long = {}, {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        long[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(long[c]) + 1):
            members.setdefault(long[c][:d], []).append(c)
        ends.setdefault(long[c], []).append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below)]
        spared = sum((len(members[x]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", x[-1][1])) for x in below if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), len(leaves), spared, sha))
    return sorted(out, key=str)


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_sql(spark, duck):
    from meshlark.llm import queries

    got, want = queries.op12_prefix_trie(spark, DATA).toPandas(), duck.execute(queries.ORACLES["op12_prefix_trie"]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


ODD = (
    [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of  some words") for c in range(40, 61) for t in range(5)]
    + [(c, t, "user", f"own {c} {t}") for c in (1, 3, 47, 55, -5, -20, 1000) for t in range(3)]
    + [(7, None, None, None), (7, None, "", ""), (7, 1, "a", "b"), (7, 1, "a", "b"), (7, 1, "a", None), (None, 0, "user", "lost"), (None, 1, "user", "lost")]
    + [(c, 0, "user", "alone") for c in (121, 122, 123, 124, 125, 126, 127)]
    + [(200, t, "user", f"long {t // 3}") for t in range(70)] + [(215, t, "user", f"long {t // 3}") for t in range(70)]
)


@pytest.mark.parametrize("packed", [1 << 15, 3])
def test_trie_against_plain_lists(spark, monkeypatch, packed):
    from meshlark.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "PACKED", packed)
    names = ("depth", "key", "owner", "place", "h", "_range", "s0", "n", "above", "first", "own0")
    turns = spark.createDataFrame(ODD, TURNS).withColumns({c: F.lit("x") for c in names}).repartition(3)
    assert found(prefix_trie.prefix_trie(turns)) == plain(ODD)


def test_trie_of_copies_and_hot_conversations(spark, monkeypatch):
    """Two conversations hold most turns, many are equal, and the chains hang deep on each other."""
    from meshlark.llm import common, prefix_trie

    monkeypatch.setattr(common, "HOT_SHARE", 0.05)  # so that hot keys take their own way here
    rows = [(c, t, "r", f"w{min(t, c // 20)} w") for c in range(0, 600, 20) for t in range(c // 20 + 2)]
    rows += [(c, 0, "r", "same") for c in range(1000, 1100, 20)] + [(2000, t, "r", "x y") for t in range(300)] + [(2020, t, "r", "x y") for t in range(250)]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == plain(rows)


def test_trie_of_an_empty_table(spark):
    from meshlark.llm.prefix_trie import prefix_trie

    assert found(prefix_trie(spark.createDataFrame([], TURNS))) == []
    assert found(prefix_trie(spark.createDataFrame([(None, 0, "user", "lost")], TURNS))) == []
