"""Documents to packed training sequences: quality classifier, quality rules, exact dedup, near-dedup, packing.

Each stage takes all rows its predecessor kept. Near-duplicates are found on shingles of five words at a similarity of 0.8.

Defined results, of every stage: null texts are empty texts; the classifier scores them like any other and the rules drop them, as
they have too few words. Of equal texts the row of the smallest identifier stays, of repeated rows one. Null identifiers are the
largest; near-dedup links nothing to rows without words and drops no row without identifier. Very long texts are taken whole. Extra columns are carried along up to the
packing, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from helixspark.llm import classifier, exact_dedup, minhash, packing, quality_rules
from helixspark.llm.common import scratch, table
from helixspark.llm.queries import tokenizer


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels, scores 0.3 or more. Without usable labels all rows stay."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule of the policy rejects."""
    return quality_rules.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest identifier."""
    return minhash.keep_one(docs, shingle=5, least=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place; of the columns only the identifier goes along."""
    cut = packing.pieces(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("exact_dedup", without_copies),
    ("minhash", without_near_copies),
    ("packing", packed),
]

#: No SQL: the classifier and the packing can't be expressed in it. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = scratch(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = f"{root}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
