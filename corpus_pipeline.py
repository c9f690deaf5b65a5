"""From raw documents to token ids: five stages, each of which works on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm.common import fresh_names, stored
from arcloom.llm.minhash_dedup import near_duplicates
from arcloom.llm.mixing import mixed_documents
from arcloom.llm.piece_codec import piece_encode
from arcloom.llm.quality_rules import quality_rules
from arcloom.llm.queries import vocabulary
from arcloom.llm.suffix_dedup import suffix_dedup


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and that column's name; null and repeated ids are told apart by it.

    A stage's input is a Parquet table, whose scan numbers the same rows alike each time it is read; storing a numbered
    copy instead took 4.3 x the input of disk over the stages, beyond the check tool's 4.
    """
    row = fresh_names(docs, "_row")[0]
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def rows_in(docs: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows whose number is in the one column of ``kept``, without the number."""
    return docs.join(kept.toDF(row), row, "left_semi").drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go, each by its own text; null and repeated ids make no difference."""
    rows, row = numbered(docs)
    judged = quality_rules(rows.select(F.col(row).alias("doc_id"), "text", "lang"))
    return rows_in(rows, row, judged.filter("kept").select("doc_id"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id, null ids last. Rows without words
    are in no group and all stay; rows of one id with different texts are different documents."""
    rows, row = numbered(docs)
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    named = groups.join(rows.select(row, F.col("doc_id").cast("long").alias("name")), row)
    first = named.groupBy("group").agg(F.min(F.struct(F.col("name").isNull().alias("none"), "name", F.col(row).alias("row")))["row"].alias("row"))
    return rows_in(rows, row, first.select("row"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings are cut from the texts; documents stay, even if nothing of their text does."""
    return suffix_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with probabilities that bring sources, languages and topics to their target weights."""
    return mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (begin and end ids included) and the text decoded from them."""
    coded = piece_encode(docs, vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Suffix sorting, near-duplicate groups and piece encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
