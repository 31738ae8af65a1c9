"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor has kept, and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.decontamination import contaminated
from tessella.llm.near_dedup import near_duplicates
from tessella.llm.packing import pack_documents
from tessella.llm.passages import without_repeats
from tessella.llm.quality import accept_quality
from tessella.llm.queries import tokenizer_path
from tessella.llm.scratch import Scratch, table
from tessella.numbering import numbered


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject.

    Null and empty texts are scored like any text; rows that repeat get equal scores; without labels of both kinds, or
    without documents, all rows stay.
    """
    return accept_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Rows are decided one by one, by a number in the order of doc_id (nulls first), so null and repeated doc_ids count as
    any other, and of rows that repeat one stays. Null and empty texts stay.
    """
    scratch = Scratch(spark, "near-dedup-rows")
    rows = scratch.cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    ranks, _ = numbered(rows.select("doc_id", "__row"), ["doc_id", "__row"], scratch, "__key")
    keyed = scratch.cut(rows.join(ranks.select("__row", "__key"), "__row"))
    scratch.keep(keyed)
    gone = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), size=5, percent=80).where("not kept").select(F.col("doc_id").alias("__key"))
    return keyed.join(gone, "__key", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that an earlier document has.

    Every row stays, maybe with an empty text; texts that lose nothing stay as they are, n_chars follows the text. Null
    texts and rows with a null doc_id are left alone; rows that share a doc_id are one document for the comparison.
    """
    return without_repeats(docs, window=50)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Rows are decided one by one, so null and repeated doc_ids count as any other; null and empty texts stay; without
    benchmark items all rows stay.
    """
    rows = Scratch(spark, "decontamination-rows").cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = contaminated(rows.select(F.col("__row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__row")).distinct()
    return rows.join(found, "__row", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 1024 tokens; a null or empty text is one end sign."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("near-duplicates", near_dedup), ("substring dedup", substring_dedup), ("decontamination", decontaminate), ("packing", pack)]
#: Classifier, automata and tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
