"""Substring join: pairs of a short text and a long one that holds it, proposed by a gram index and then verified.

Each short text is looked for by one of its grams only, that of least hash; so a common beginning of many short texts isn't the key of all of them. A
long text offers each of its distinct grams once. Grams are of GRAM characters, or of all a shorter text has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram, the longest first; a short text takes the longest that it has room for.
GRAMS = (8, 4, 2, 1)
#: Grams that are looked for, at most, that every task knows, so that others are dropped where they arise.
SOUGHT = 1 << 20


def grams(text: Column, size: int) -> Column:
    """The distinct grams of a text; none if it is shorter."""
    places = F.sequence(F.lit(1), F.char_length(text) - (size - 1))
    return F.when(F.char_length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """short_id, long_id: the rows of `long` (long_id, text) whose text holds that of a row of `short` (short_id, text), as it stands.

    Null and empty short texts are in none; null long texts hold none. Rows that repeat give repeated pairs. A pair is verified on whole texts, which
    meet the proposals by id; each long text's grams of a length are made once, however many short texts ask for that length. Ids must tell the
    rows of a table apart where pairs are to be told apart.
    """
    sizes = F.char_length("text")
    asked = short.where("text <> ''").select("short_id", "text", reduce(lambda rest, n: F.when(sizes >= n, F.lit(n)).otherwise(rest), reversed(GRAMS), F.lit(1)).alias("_size"))
    ordered = reduce(lambda rest, n: F.when(F.col("_size") == n, F.array_min(F.transform(grams(F.col("text"), n), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]).otherwise(rest), GRAMS, F.lit(None).cast("string"))
    keyed = asked.withColumn("_gram", F.xxhash64(ordered, "_size"))  # of what has the same hash too, whole texts decide
    wanted = [r["_size"] for r in asked.select("_size").distinct().collect()]  # of GRAMS
    if not wanted:
        return short.select("short_id").crossJoin(long.select("long_id")).where("false")
    known = long.where("text is not null")
    offered = [known.select("long_id", F.explode(grams(F.col("text"), n)).alias("_g")).select("long_id", F.xxhash64("_g", F.lit(n)).alias("_gram")) for n in wanted]
    proposals = reduce(DataFrame.unionByName, offered)
    sought = keyed.select("_gram").distinct()
    if sought.limit(SOUGHT + 1).count() <= SOUGHT:  # else all grams of all long texts are dealt by gram
        proposals = proposals.join(F.broadcast(sought), "_gram", "left_semi")
    proposed = proposals.join(keyed.select("short_id", "_gram"), "_gram").select("short_id", "long_id")
    met = proposed.join(asked.select("short_id", F.col("text").alias("_short")), "short_id").join(known.select("long_id", F.col("text").alias("_long")), "long_id")
    return met.where("contains(_long, _short)").select("short_id", "long_id")
