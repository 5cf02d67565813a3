"""The corpus pipeline: toxicity, exact copies, near copies, mixing, packing; each stage's table feeds the next.

Stages are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

* toxicity: rows whose text the network predicts to be toxic go, each by its own text, whatever else has its doc_id (or
  none). The labels are read from the same folder as documents.
* exact copies: of equal texts the largest doc_id stays, and one row of those that repeat it.
* near copies: of each group of five-word Jaccard similarity 0.8 or more, one row stays: of the smallest doc_id (null is
  largest); of several such, by the digests of their shingles and texts.
* mixing: every document stays at least once; documents of small sources repeat, up to 1.5 times as often.
* packing: pieces of at most 2048 tokens in sequences.

Null and empty texts, null ids, very long texts, repeated rows, empty tables and extra columns of any name pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshlark.llm.common import new_path
from meshlark.llm.dedup_exact import drop_copies
from meshlark.llm.mixing import mixed_documents
from meshlark.llm.near_text import drop_near_copies
from meshlark.llm.packing import pack
from meshlark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(docs, path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("mixing", mixing), ("packing", packing)]

#: Training a network, MinHash and a tokenizer have no SQL form; tests/llm compares the run with a brute-force version,
#: stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
