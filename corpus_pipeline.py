"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; ``run`` writes each stage's result, reads it again as the next one's input,
and removes the tables that led to it.

In every stage texts of any length are taken whole, columns other than doc_id,
text and n_chars are carried along unread whatever their names, and an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import quality
from spanloom.llm.common import remove, scratch, stage, table
from spanloom.llm.decontaminate import without_leaks
from spanloom.llm.near_dedup import keep_one
from spanloom.llm.packing import pack_documents
from spanloom.llm.secrets import redact

THRESHOLD = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for label 1 is under THRESHOLD go.  The classifier learns from the labelled rows that aren't held out.

    Null and empty texts have the score of a text without features, which is
    that of the labels' bias; repeated rows have one fate; a null doc_id is not
    labelled but scored; without labels every text scores 0.5 and stays.
    """
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~quality.held_out())
    return quality.keep(docs, quality.train(docs, marks), THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays, the one with the least doc_id, null ids last.

    Rows repeated with one doc_id are copies like any others; rows with one
    doc_id and unrelated texts are told apart; null and empty texts are copies
    of nothing and all stay.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever else they hold.

    Null and empty texts hold none and stay; repeated rows have one fate;
    without items all rows stay.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets and n_chars is brought up to date; every row stays.

    Null and empty texts stay as they are; repeated rows are changed alike; a
    null doc_id makes no difference.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 1024 tokens.

    Null and empty texts have one piece, the end token; repeated rows are
    packed each; ties are broken by doc_id and place in the document.
    """
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", packing),
]

#: Tokenising, learning and approximate search are not expressible in SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, step in STAGES:
        with scratch() as made:
            docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        remove(spark, before + made[:-1])
        before = made[-1:]
    return docs
