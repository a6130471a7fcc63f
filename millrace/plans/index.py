"""A built index: analyzed chunks with their vectors, and postings, written once and read by every search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import keyword as K
from ..sources.storage import exists
from .errors import NotBuilt


@dataclass(frozen=True)
class Index:
    chunks: DataFrame
    postings: K.Postings
    blocks: DataFrame | None = None  # of vectors, see vectors.stored_blocks(); None: the vectors are the chunks'


def build(chunks: DataFrame, folder: str, dim: int | None = None) -> Index:
    """Write the index of `chunks` (chunk_id, text, perhaps heading_path and vector, others) below `folder`, and open it.

    Texts are analyzed once; postings, frequencies and vectors are made of the stored tokens. With `dim`, chunks get the
    hashed bag of their tokens as vector.
    """
    spark = chunks.sparkSession
    own = K.analyzed(chunks)
    if dim is not None:
        own = own.withColumn("vector", V.embed_tokens(F.col("tokens"), dim))
    own.write.parquet(f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks")
    if "vector" in stored.columns:
        V.stored_blocks(stored.select(F.col("chunk_id").alias("row_id"), "vector"), stored.count()).write.parquet(f"{folder}/vectors")
    K.store(K.on_the_way(stored), f"{folder}/keyword")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> Index:
    if not exists(spark, f"{folder}/keyword/totals/_SUCCESS"):
        raise NotBuilt(f"no index at {folder}")
    blocks = spark.read.schema(V.STORED).parquet(f"{folder}/vectors") if exists(spark, f"{folder}/vectors/_SUCCESS") else None
    return Index(spark.read.parquet(f"{folder}/chunks"), K.stored(spark, f"{folder}/keyword"), blocks)
