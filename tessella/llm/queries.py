"""One query for each operator, over whole tables, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import oracle as chat_sql
from .chat import rotate_perspectives
from .decontamination import contaminated
from .language import identify_language
from .licenses import oracle as license_sql
from .licenses import scan_licenses
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import pack_documents
from .passages import repeated_passages
from .quality import score_quality
from .scratch import table
from .sharding import shard_documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op2_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op3_repeated_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), window=50).drop("kept_text", "text_id")


def op4_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).drop("row_number")


def op10_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_byte_cnn_language,
        op3_repeated_phrase_dedup,
        op4_pruned_graph_neighbours,
        op5_best_fit_packing,
        op6_license_sentences,
        op7_perspective_rotation,
        op8_latent_decontamination,
        op9_feistel_sharding,
        op10_random_indexing_quality,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_license_sentences": license_sql(), "op7_perspective_rotation": chat_sql()}
