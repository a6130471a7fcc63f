"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, html, language, leaks, lines, merkle, mixing, neardup, passages, pii, repair, tiff, warc
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_html": lambda spark, d: html.extract(table(spark, d, "pages")),
    "op2_language": lambda spark, d: language.language_digest(table(spark, d, "documents")),
    "op3_tiff": lambda spark, d: tiff.media_digest(table(spark, d, "documents")),
    "op4_line_dedup": lambda spark, d: lines.line_digest(table(spark, d, "documents")),
    "op5_passages": lambda spark, d: passages.passage_digest(table(spark, d, "documents")),
    "op6_chat": lambda spark, d: chat.chat_digest(chat.with_probe(table(spark, d, "conversations"))),
    "op7_near_duplicates": lambda spark, d: neardup.near_duplicates(table(spark, d, "documents")),
    "op8_mixing": lambda spark, d: mixing.mix_digest(table(spark, d, "documents")),
    "op9_warc": lambda spark, d: warc.warc_digest(table(spark, d, "pages")),
    "op10_decontamination": lambda spark, d: leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op11_repair": lambda spark, d: repair.repair_digest(table(spark, d, "conversations")),
    "op12_personal": lambda spark, d: pii.personal_digest(table(spark, d, "documents")),
    "op13_merkle": lambda spark, d: merkle.merkle_digest(table(spark, d, "documents")),
}

ORACLE: dict[str, str] = {
    "op4_line_dedup": lines.DIGEST_SQL,
    "op6_chat": chat.DIGEST_SQL,
    "op9_warc": warc.DIGEST_SQL,
    "op11_repair": repair.DIGEST_SQL,
    "op13_merkle": merkle.DIGEST_SQL,
}
