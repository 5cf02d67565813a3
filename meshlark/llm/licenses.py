"""License scan by diagonal voting.

A text's words are all runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. Every rolling hash
of K words is joined with the places of the templates' K-word runs (a fixed table, broadcast); with the hash, the words
themselves must agree. A hit votes for its diagonal (place in the text less place in the template). Diagonals that
differ by at most GAP words merge into a span, so that a few lost or added words do not break it; a span is verified if
it holds at least COVER of the template's runs and is not much longer than the template.

Templates share words, so one notice may verify spans of several labels. Where the spans of two labels overlap by more
than half of the shorter one, the one with the larger share of its template's runs stays; of equal shares both do. A place of
a base phrase always stays.

The base phrases are templates too: a place where a phrase stands is a diagonal with all of its runs.

Defined results: a null text counts as empty; a text of fewer than K words has none of the labels; no labels give an
empty string and score 0; rows that repeat give rows that repeat; other columns are ignored. The score is the largest
share of a template's runs in one span, 1 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import grams, hash_of, word_hashes

K, GAP, COVER, STRETCH = 3, 2, 0.6, 2
# fixed values: the base phrases, and words of well-known public license notices
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: The place of a document's own row among its hits, and the text in it.
OWN, MARK = -1, "#"
#: Bytes of texts that are cut into runs at once.
SLICE = 1 << 19


def templates() -> list[tuple[int, str, bool, str]]:
    """(number, label, base, words)"""
    return [(i, label, words in BASE, words) for i, (words, label) in enumerate([*BASE.items(), *NOTICES.items()])]


def template_runs() -> list[tuple[int, str, bool, int, int, str, int]]:
    """(template, label, base, runs, place, words, hash) of each run of K words."""
    out = []
    for number, label, base, text in templates():
        words = text.split()
        h = grams(hash_of([w.encode() for w in words]), K).view(np.int64)
        out += [(number, label, base, len(h), i, " ".join(words[i : i + K]), int(x)) for i, x in enumerate(h)]
    return out


def runs_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, place, hash, words: all runs of K words (their text only where all of it is in some template), and
    one row per document (words MARK, its number of words as place)."""
    known = sorted({w for *_, text in templates() for w in text.split()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, vocabulary = TaskContext.get().partitionId() << 33, np.sort(hash_of([w.encode() for w in known]))

        def flush(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            hashes, at, data, starts, ends = word_hashes(texts)
            rolled, words = grams(hashes, K).view(np.int64), np.diff(at)
            runs = np.maximum(words - K + 1, 0)
            # the runs of each text, and then its own row
            doc = np.repeat(np.arange(len(texts)), runs + 1)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(runs + 1) - runs - 1, runs + 1)
            own = place == runs[doc]
            word = np.minimum(at[doc] + place, max(0, len(rolled) - 1))
            hits = np.append(vocabulary[np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)] == hashes, np.zeros(K, bool))
            written = own | np.logical_and.reduce([hits[word + i] for i in range(K)])
            text = [MARK.encode() if o else b" ".join(data[starts[j] : ends[j]] for j in range(w, w + K)) for o, w in zip(own[written].tolist(), word[written].tolist(), strict=True)]
            length = np.zeros(len(doc) + 1, np.int32)
            length[1:][written] = [len(x) for x in text]
            strings = pa.StringArray.from_buffers(len(doc), pa.py_buffer(np.cumsum(length, dtype=np.int32).tobytes()), pa.py_buffer(b"".join(text)))
            hashed = np.where(own, OWN, rolled[word] if len(rolled) else OWN)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(row + doc), pa.array(np.where(own, words[doc], place), pa.int32()), pa.array(hashed), strings], ["doc_id", "row", "place", "hash", "words"])

        for batch in batches:
            ids, texts, size, at = batch.column(0).to_pylist(), [], 0, 0
            for i, text in enumerate(batch.column(1), 1):
                texts.append((text.as_py() or "").encode().lower())
                size += len(texts[-1])
                if size >= SLICE or i == len(ids):
                    yield flush(ids[at:i], texts)
                    row += i - at
                    texts, size, at = [], 0, i

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, row long, place int, hash long, words string")


def settled(spans: list | None) -> list:
    """The found spans (begin, end, label, share, base) without those that a better rival of another label overlaps
    by more than half of the shorter one."""
    stay = []
    for x in sorted(spans or [], key=lambda x: -x["share"]):
        rival = lambda y: y["label"] != x["label"] and y["share"] > x["share"] and 2 * (min(x["end"], y["end"]) - max(x["begin"], y["begin"])) > min(x["end"] - x["begin"], y["end"] - y["begin"])  # noqa: B023, E731
        if x["base"] or not any(map(rival, stay)):
            stay.append(x)
    return sorted((x["begin"], x["end"], x["label"], x["share"]) for x in stay)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, end, share)."""
    spark = docs.sparkSession
    table = spark.createDataFrame([*template_runs(), (OWN, None, False, 1, 0, MARK, OWN)], "template int, label string, base boolean, runs int, at int, t_words string, t_hash long")
    hits = runs_of(docs).join(F.broadcast(table), (F.col("hash") == F.col("t_hash")) & (F.col("words") == F.col("t_words")))
    doc = ["doc_id", "row"]
    votes = hits.withColumn("diagonal", F.col("place") - F.col("at")).groupBy(*doc, "template", "label", "base", "runs", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("begin"), (F.max("place") + K).alias("end"))
    w = Window.partitionBy(*doc, "template").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= GAP, 0).otherwise(1)
    votes = votes.withColumn("new", new).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.col("base") & (F.col("votes") == F.col("runs"))
    spans = votes.groupBy(*doc, "template", "label", "base", "runs", "span").agg(
        F.sum("votes").alias("votes"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.count_if(whole).alias("places"), F.min(F.when(whole, F.col("diagonal"))).alias("first"), F.max(F.when(whole, F.col("diagonal"))).alias("last"), F.max("diagonal").alias("diagonal")
    )
    share = F.least(F.lit(1.0), F.col("votes") / F.col("runs"))
    found = F.col("label").isNotNull() & ((F.col("places") > 0) | ((share >= COVER) & (F.col("end") - F.col("begin") <= STRETCH * (F.col("runs") + K - 1))))
    spans = spans.withColumn("share", share).withColumn("found", found)
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy(*doc).agg(
        F.max(F.when(F.col("template") == OWN, F.col("diagonal"))).cast("long").alias("n_words"),
        F.sum("places").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        distinct(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
        F.max(F.when(F.col("template") == OWN, 0.0).otherwise(F.col("share"))).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("begin", "end", "label", "share", (F.col("places") > 0).alias("base"))))).alias("spans"),
    )
    settle = F.udf(settled, "array<struct<begin: int, end: int, label: string, share: double>>")
    # only documents with rivals go through Python
    plain = F.transform("spans", lambda x: F.struct(x["begin"].cast("int").alias("begin"), x["end"].cast("int").alias("end"), x["label"].alias("label"), x["share"].alias("share")))
    several = F.size(F.array_distinct("spans.label")) > 1
    out = out.withColumn("spans", F.when(several, settle(F.when(several, F.col("spans")))).otherwise(plain))
    labels = F.array_join(F.array_sort(F.array_distinct("spans.label")), ",")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), "score", "spans")


def oracle() -> str:
    rows = ", ".join(f"({t}, '{label}', {str(base).lower()}, {runs}, {at}, '{words}')" for t, label, base, runs, at, words, _ in template_runs())
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH t(template, label, base, runs, spot, words) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, row, i - 1 AS place, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS words FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
v AS (SELECT doc_id, row, template, label, base, runs, place - spot AS diagonal, count(*) AS votes, min(place) AS b, max(place) + {K} AS e FROM g JOIN t USING (words) GROUP BY ALL),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS new FROM v),
s AS (SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS span, base AND votes = runs AS whole FROM n),
m AS (SELECT row, template, label, runs, span, sum(votes) AS votes, min(b) AS b, max(e) AS e, count(*) FILTER (whole) AS places,
  min(diagonal) FILTER (whole) AS first, max(diagonal) FILTER (whole) AS last FROM s GROUP BY row, template, label, runs, span),
f AS (SELECT *, least(1.0::DOUBLE, votes / runs::DOUBLE) AS share FROM m),
x AS (SELECT *, places > 0 OR (share >= {COVER} AND e - b <= {STRETCH} * (runs + {K - 1})) AS found FROM f)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(sum(places), 0)::BIGINT AS n_base, min(first)::BIGINT AS first_word, max(last)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found), '') AS labels, coalesce(max(share), 0.0)::DOUBLE AS score
FROM d LEFT JOIN x USING (row) GROUP BY d.row, d.doc_id, w"""
