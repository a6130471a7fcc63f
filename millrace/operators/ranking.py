"""Fusion, grouping, confidence and evaluation of ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# How far below the best an automatic cut keeps hits, how many weak hits are shown, and the ranks of labels.
MARGIN, WEAK_SHOWN = 0.10, 3
LEVELS = {3: "high", 2: "medium", 1: "low", 0: ""}
NOTHING_SURE, ONLY_WEAK = "nothing matches as surely as asked", "only weak matches, likely of something else"


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, sim, kw, rank: the sum of 1 / (60 + rank) over both lists, ties by chunk_id."""
    v = vector_hits.select("query_id", "chunk_id", F.col("sim"), F.col("rank").alias("_v"))
    w = keyword_hits.select("query_id", "chunk_id", "kw", F.col("rank").alias("_w"))
    part = lambda c: F.coalesce(1.0 / (T.RRF + F.col(c)), F.lit(0.0))
    met = v.join(w, ["query_id", "chunk_id"], "full").select("query_id", "chunk_id", F.round(part("_v") + part("_w"), 8).alias("score"), F.coalesce("sim", F.lit(0.0)).alias("sim"), F.coalesce("kw", F.lit(False)).alias("kw"))
    return ranked(met)


def ranked(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def group_by(hits: DataFrame, key: str) -> DataFrame:
    """The best hit per query and key, with the number of hits, the largest similarity and any keyword match of its group."""
    group = Window.partitionBy("query_id", key)
    first = hits.withColumns({"_i": F.row_number().over(group.orderBy("rank")), "chunks": F.count("*").over(group), "sim": F.max("sim").over(group), "kw": F.max("kw").over(group)})
    return first.where("_i = 1").drop("_i")


def level(sim: Column, kw: Column, strong: float | None, fair: float | None) -> Column:
    """0 to 3: unknown without thresholds or evidence; a keyword match lifts a label by one."""
    if strong is None or fair is None:
        return F.lit(0)
    base = F.when(sim >= strong, 3).when(sim >= fair, 2).otherwise(1)
    return F.when((sim == 0) & ~kw, 0).otherwise(F.least(F.lit(3), base + kw.cast("int")))


def by_confidence(hits: DataFrame, setting: str, strong: float, fair: float) -> DataFrame:
    """Hits that a confidence setting keeps, with `level`.

    high and medium keep their labels and better. auto keeps medium and better where there is one, and of a query whose
    best similarity is strong drops hits without a keyword match that lie MARGIN below it. Any other setting keeps all;
    but where the best hit is low, WEAK_SHOWN hits are shown at most unless a floor drops them all.
    """
    query = Window.partitionBy("query_id")
    rated = hits.withColumn("level", level(F.col("sim"), F.col("kw"), strong, fair)).withColumns({"_best": F.max("level").over(query), "_top": F.max("sim").over(query)})
    floor = {"high": F.lit(3), "medium": F.lit(2)}.get(setting, F.when(F.col("_best") >= 2, 2).otherwise(0) if setting == "auto" else F.lit(0))
    keep = F.col("level") >= floor
    if setting == "auto":
        far = (F.col("_best") >= 2) & (F.col("_top") >= strong) & ~F.col("kw") & (F.round(F.col("_top") - F.col("sim"), 6) > MARGIN)
        keep = keep & ~far
    kept = rated.where((F.col("_best") == 0) | keep).withColumn("_i", F.row_number().over(query.orderBy("rank")))
    return kept.where(~((F.col("_best") == 1) & (floor <= 1)) | (F.col("_i") <= WEAK_SHOWN)).drop("_best", "_top", "_i")


def confidence_notices(hits: DataFrame, kept: DataFrame, strong: float | None, fair: float | None) -> DataFrame:
    """query_id, notice: where a confidence setting has kept nothing of a query's hits, or only its weak ones are left to show."""
    rated = hits.withColumn("level", level(F.col("sim"), F.col("kw"), strong, fair)).groupBy("query_id").agg(F.max("level").alias("_best"))
    counts = kept.groupBy("query_id").agg(F.count("*").alias("_n"))
    told = F.when(F.col("_best") == 0, None).when(F.col("_n").isNull(), NOTHING_SURE).when(F.col("_best") == 1, ONLY_WEAK)
    return rated.join(counts, "query_id", "left").select("query_id", told.alias("notice")).where("notice is not null")


def page_ranks(hits: DataFrame, page: str) -> DataFrame:
    """query_id, `page`, rank: the pages of ranked hits, each once, in the order of their first hits."""
    first = hits.groupBy("query_id", page).agg(F.min("rank").alias("_first"))
    return first.select("query_id", page, F.row_number().over(Window.partitionBy("query_id").orderBy("_first", page)).alias("rank"))


def first_k(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_i") <= k).drop("_i")


def retrieval_metrics(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """queries, hit_at_1, hit_at_5, recall_at_10, mrr over the queries of `relevant` (query_id, chunk_id)."""
    told = hits.join(relevant.withColumn("_r", F.lit(1)), ["query_id", "chunk_id"], "left_outer")
    first = told.where("_r = 1").groupBy("query_id").agg(F.min("rank").alias("_first"))
    all_ = relevant.select("query_id").distinct().join(first, "query_id", "left")
    share = lambda k: F.round(F.avg(F.coalesce((F.col("_first") <= k).cast("double"), F.lit(0.0))), 6)
    return all_.agg(F.count("*").alias("queries"), share(1).alias("hit_at_1"), share(5).alias("hit_at_5"), share(10).alias("recall_at_10"), F.round(F.avg(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))), 6).alias("mrr"))
