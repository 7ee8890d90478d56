"""Corpus pipeline: rules, classifier, exact and near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of docs; the last returns where the tokens of the documents left are packed. Between stages the
rows are written as Parquet under the shared folder and read again.

In every stage rows with a null or repeated doc_id are documents of their own, null text counts as empty, texts of any length are
read whole, columns beyond those that a stage needs pass through unread (whatever their names), and an empty table
gives no rows. What a stage does with ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, near_dedup, packing, quality_classifier, quality_rules
from lectern.llm.bpe import vocabulary_path
from lectern.llm.common import prepare, stored, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules go (null and empty texts among them), those that fail a rule by which their host is
    suspect, and all of a rejected host. Repeated rows share their fate; a null host gets no verdict; a rate at a limit is not above it."""
    prepare(spark)
    return quality_rules.drop_failures(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; its labels are those of sf_dir. Repeated rows share their fate, a score at the
    limit stays, and without labels of both kinds all stay."""
    prepare(spark)
    return quality_classifier.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal when A-Z are lower-cased one row stays: that of the largest doc_id (null is the smallest), of rows that
    repeat it any one, as they are equal."""
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that of the least doc_id (null is the largest), of rows that repeat it one.
    Texts without words are copies of one another."""
    prepare(spark)
    return near_dedup.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the token ids of all that is left are packed, and the checksum of each packed sequence; empty texts are an end alone. Pieces of
    equal length go by a hash of doc_id and text, repeated rows in turn."""
    prepare(spark)
    return packing.pack_tokens(docs, vocabulary_path())


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("exact dedup", exact),
    ("near dedup", near),
    ("best-fit packing", pack),
]

#: SQL cannot express the classifier, the sampled signatures or the packing. tests/llm compares rules, exact copies and near copies with
#: plain versions, the classifier with held-out labels and its sums with plain ones, and the packing's cost with that of all divisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
