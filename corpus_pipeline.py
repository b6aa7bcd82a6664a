"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.classifier import resampled_documents
from undula.llm.common import durable, join_counted
from undula.llm.line_dedup import line_dedup
from undula.llm.mixing import mix
from undula.llm.ngram_join import ngram_components
from undula.llm.packing import pack
from undula.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts score as texts without words; repeated rows are judged
    each; an empty table gives an empty result."""
    return resampled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later ones of similar lines. A document of which no words are left is dropped; n_chars follows. Documents
    that lose no line stay as they are, null and empty texts included; rows repeated with id and text come out alike."""
    found = line_dedup(docs).filter("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id. Rows that share an id are one document here and go or stay
    together; rows without an id stay, and so do null and empty texts, which link with nothing."""
    copies = durable(ngram_components(docs).filter("doc_id != component_id").select("doc_id").distinct(), "copies")
    return join_counted(docs, copies, ["doc_id"], "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which the sources' blocks are due: file after file, row after row.

    Places are found without the texts, which are moved once. Rows repeated with id and text stand together. No row is dropped:
    null ids, null sources and null or empty texts have places as well; an empty table gives an empty result.
    """
    keyed = docs.withColumn("__same", F.xxhash64("doc_id", "text"))  # rows of one key share a place, which only orders
    placed = mix(durable(keyed.select("doc_id", "source", "__same"), "keys"))
    places = durable(placed.groupBy("__same").agg(F.min("position").alias("__position")), "places")
    rows = join_counted(keyed, places, ["__same"], "left")
    return rows.repartitionByRange("__position").sortWithinPartitions("__position").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences, which follow the order of the files and their rows. Null and
    empty texts are one token; repeated rows are packed as often as they occur; an empty table gives an empty result."""
    ordered = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return pack(ordered, tokenizer_path(), order=("__file", "__row"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mixture), ("packing", packing)]
#: The classifier can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
