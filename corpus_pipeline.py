"""From raw documents to a training mix, in five stages; each is written as Parquet and read again as the next one's input. After the
last one the blocks of the mix are written as well.

In every stage a null text counts as an empty one, texts are taken whole, repeated rows are treated alike, columns that the stage
does not use pass through under their names whatever these are, and an empty table gives an empty one. Ties between documents go
to the smallest doc_id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, leaks, lines, mixing, neardup, shared

#: Documents that hold a line from which the stage drops it. The copies of a text, mostly fewer, are left whole for the
#: near-duplicate stage: with two instead of five, most copies would reach it as remnants that are like nothing any more.
LINE_DOCS = 5
#: Folder of the mixed blocks, beside those of the stages.
BLOCKS = "blocks"


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents that no language fits, having no letters or a null text, go. Rows with a null doc_id are
    judged like others."""
    return language.keep_identified(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose the lines that at least LINE_DOCS documents have, but for the smallest doc_id's; a document that loses
    all of its lines goes. n_chars is counted anew. Rows with a null doc_id are left whole; rows that share a doc_id are one
    document for the counts."""
    kept = lines.drop_repeated_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), min_docs=LINE_DOCS)
    told = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.where("n_dropped < n_lines").select(*(told[c].alias(c) if c in told else F.col(f"_row.`{c}`") for c in docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates on shingles of five words: the document with the smallest doc_id of each group stays. Documents without words
    or without a doc_id stay; rows that share a doc_id stay or go by their id."""
    return neardup.drop_near_duplicates(docs).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go. Null items match nothing; rows with a null doc_id stay."""
    return leaks.drop_leaks(docs, shared.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: size, source_size, target and taken are added (columns of these names are replaced); documents that the mix takes no
    word of go. A null source is a source of its own; rows that share a doc_id, or have none, are documents of their own."""
    return mixing.mix_with_texts(docs).where("taken > 0")


STAGES = [
    ("language_id", identified),
    ("line_dedup", unrepeated),
    ("near_dedup", distinct),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
]

#: Language identification, Jaccard components and the mix are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents table, and the mix itself. Both are written below `folder`, or else one of its own below
    spark.checkpoint.dir; what an earlier run wrote there is replaced."""
    docs = shared.table(spark, sf_dir, "documents")
    folder = folder or f"{shared.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        last = docs
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    mixing.mixed_blocks(last).write.mode("overwrite").parquet(f"{folder}/{BLOCKS}")
    return docs


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """slot, source, text: the mix that run() wrote into the folder, a row per block of equal length; training reads them by slot."""
    return spark.read.parquet(f"{folder}/{BLOCKS}")


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
