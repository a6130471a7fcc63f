"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Characters that a key loses at both ends: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """`docs` with the columns kept_text, n_lines and n_dropped added.

    A line whose key has at least `min_chars` code points and is found in at least `min_docs` documents stays only in
    the smallest doc_id that holds it. Keys are compared by 128 bits of hash.

    A null or empty text is one empty line. Rows with a null doc_id are left whole and count for no key. Rows that share
    a doc_id are one document for the counts, but each loses only lines of its own text, by a hash of which they are told
    apart; rows alike in both get the same result. Other columns pass through; columns of `docs` named like the three added
    ones are replaced. An empty table gives an empty one.

    Only hashes, ids and positions are shuffled for the counts; a hash has one row per task before its shuffle, however
    many lines carry it. The repeated hashes are checkpointed, so that the join that leads back to the lines has a shuffle on
    either side, which adaptive execution can split at hot hashes. The texts are shuffled once, by doc_id and text, to meet the positions of their dropped lines.
    """
    line = F.col("_line")
    keyed = (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("_text"), F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("_pos", "_line"))
        .where(F.char_length(line) >= min_chars)
        .select("doc_id", "_text", "_pos", F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit("line"), line).alias("_h2"))
    )
    if min_docs == 2:
        spread = keyed.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    else:
        spread = keyed.select("_h1", "_h2", "doc_id").distinct().groupBy("_h1", "_h2").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_docs")).where(F.col("_docs") >= min_docs)
    gone = (
        keyed.join(settle(spread.select("_h1", "_h2", "_first")), ["_h1", "_h2"])
        .where(F.col("doc_id") > F.col("_first"))
        .groupBy("doc_id", "_text")
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    whole = docs.drop("kept_text", "n_lines", "n_dropped")
    parts = _lines(F.col("text"))
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(places, lambda i: F.get(F.col("_all"), i)), "\n"))
    told = gone.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_own"), "_gone")
    joined = whole.join(told, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_own")), "left").withColumn("_all", parts)
    return joined.select(*whole.columns, kept.alias("kept_text"), F.size("_all").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))


def line_digest(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = drop_repeated_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same in DuckDB; {docs} is a relation with doc_id and text.
KEPT_SQL = r"""
WITH src AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {docs}),
flat AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM src),
keyed AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM flat),
spread AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND k.doc_id > s.first AS gone
  FROM keyed k LEFT JOIN spread s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
FROM judged GROUP BY doc_id
"""
DIGEST_SQL = f"SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM ({KEPT_SQL.format(docs='documents')})"
