"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

The golden-ratio sequence is mapped through the cumulative shares of the sources: slot i of the mix belongs to the source
whose interval holds frac((i + 0.5) * phi). The n-th slot of a source takes the n-th block of words of that source, whose
documents stand in a hashed order and, from the second pass on, once more. A source gets as many blocks as its target has, the
last one cut to fit: slots beyond them stay empty, and the few that the sequence leaves a source short of come at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Weights that the sources get in turn, share of all words that the mix has, and passes over a source at most.
WEIGHTS, SHARE, PASSES = (5.0, 2.0, 1.0), 1.5, 2
#: Words in a block.
BLOCK_WORDS = 1024
#: Rows that one window partition of a running total gets, about; so no task gets a whole source.
RUN_ROWS = 1 << 10
GOLDEN = 0.6180339887498949
#: Pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: Iterable[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> dict[str | None, tuple[int, float]]:
    """Per source its size and target. Targets stop at `passes` times the size; the excess is shared again by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    cap = {name: float(passes * size) for name, size in order}
    target: dict[str | None, float] = {}
    free, left = [name for name, _ in order], share * sum(size for _, size in order)
    while free:
        total = sum(weight[name] for name in free)
        full = [name for name in free if left * weight[name] / total > cap[name]]
        if not full:
            target |= {name: left * weight[name] / total for name in free}
            break
        for name in full:
            target[name] = cap[name]
            left -= cap[name]
        left = max(left, 0.0)
        free = [name for name in free if name not in target]
    return {name: (size, target[name]) for name, size in order}


def _numbered(rows: DataFrame, group: str, run: Column, order: list[Column], value: Column, name: str, level: int = 0) -> DataFrame:
    """`rows` with the total of `value` over the rows before each in its group, as `name`.

    Rows of a group are ordered by run, then `order`. Totals of the runs are added up first, and those in runs of runs; so no
    window holds a whole group.
    """
    own, total, base = f"_run{level}", f"_total{level}", f"_base{level}"
    held = rows.withColumn(own, run)
    within = Window.partitionBy(group, own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(group, own).agg(F.sum(value).alias(total))
    if level < 2:
        bases = _numbered(totals, group, F.expr(f"{own} div {RUN_ROWS}"), [F.col(own)], F.col(total), base, level + 1)
    else:
        before = Window.partitionBy(group).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.withColumn(base, F.coalesce(F.sum(total).over(before), F.lit(0)))
    inner = held.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(bases.select(group, own, base), [group, own]).withColumn(name, (F.col(base) + F.col("_in")).cast("long")).drop(own, "_in", base)


def _told_apart(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """`columns` of `docs` with _h and _copy, which with doc_id tell its rows apart; rows alike are numbered in any order."""
    own = docs.select("doc_id", "source", *columns, F.xxhash64("source", "text").alias("_h"))
    return own.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy("_h")))


def _sized(docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """doc_id, source, _h, _copy, size, _s, source_size, target of every row; _s, target words of every source; the inner edges
    of the cumulative shares; slots.

    The sizes per source are read by the driver: one row per source.
    """
    spark = docs.sparkSession
    base = settle(_told_apart(docs, word_count(F.col("text")).alias("size")))
    targets = fill_targets([(r["source"], r["size"]) for r in base.groupBy("source").agg(F.sum("size").alias("size")).collect()])
    names = list(targets)
    words = [int(targets[n][1] + 1e-6) for n in names]
    edges = np.cumsum([float(targets[n][1]) for n in names])[:-1] / max(1.0, sum(t for _, t in targets.values()))
    shares = spark.createDataFrame([(i, n, int(targets[n][0]), float(targets[n][1]), words[i]) for i, n in enumerate(names)], "_s int, _name string, source_size long, target double, _goal long")
    known = base.join(shares, base["source"].eqNullSafe(shares["_name"])).drop("_name")
    return known, shares, edges, sum(-(-w // BLOCK_WORDS) for w in words)


def _drawn(shares: DataFrame, edges: np.ndarray, slots: int) -> DataFrame:
    """slot, _s, _block: which block of which source stands in each slot that is filled."""
    spark = shares.sparkSession

    @F.pandas_udf("int")
    def source_at(slot: pd.Series) -> pd.Series:
        point = (slot.to_numpy() + 0.5) * GOLDEN
        return pd.Series(np.searchsorted(edges, point - np.floor(point), side="right").astype(np.int32))

    points = spark.range(slots).select(F.col("id").alias("slot"), source_at("id").alias("_s"))
    ranked = settle(_numbered(points, "_s", F.expr(f"slot div {RUN_ROWS * 16}"), [F.col("slot")], F.lit(1), "_block").select("slot", "_s", "_block"))
    goals = shares.select("_s", F.ceil(F.col("_goal") / BLOCK_WORDS).alias("_blocks"))
    kept = ranked.join(goals, "_s").where("_block < _blocks").select("slot", "_s", "_block")
    counts = ranked.groupBy("_s").agg(F.count("*").alias("_n"))
    short = goals.join(counts, "_s", "left").select("_s", F.explode(F.expr("filter(sequence(coalesce(_n, 0), greatest(coalesce(_n, 0), _blocks)), b -> b < _blocks)")).alias("_block"))
    late = short.select((F.lit(slots) + F.row_number().over(Window.orderBy("_block", "_s")) - 1).cast("long").alias("slot"), "_s", "_block")  # a few for each source
    return kept.unionByName(late)


def _pieces(known: DataFrame, drawn: DataFrame) -> DataFrame:
    place = F.xxhash64(F.lit("order"), "doc_id", "_h", "_copy")
    runs = F.greatest(F.lit(1), F.expr(f"cast({known.count()} as bigint) div {RUN_ROWS}"))
    rows = known.where("size > 0").select("_s", "doc_id", "_h", "_copy", "size", "source_size", "_goal")
    spans = _numbered(rows, "_s", F.pmod(F.shiftrightunsigned(place, 24), runs), [place, F.col("doc_id"), F.col("_h"), F.col("_copy")], F.col("size"), "_first")
    passes = spans.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1)))).withColumn("_at", F.col("_first") + F.col("_pass") * F.col("source_size"))
    used = passes.withColumn("_end", F.least(F.col("_at") + F.col("size"), F.col("_goal"))).where("_at < _end")
    cut = used.withColumn("_block", F.explode(F.expr(f"sequence(_at div {BLOCK_WORDS}, (_end - 1) div {BLOCK_WORDS})")))
    from_ = F.greatest(F.col("_at"), F.col("_block") * BLOCK_WORDS)
    to = F.least(F.col("_end"), (F.col("_block") + 1) * BLOCK_WORDS)
    held = cut.select("_s", "_block", "doc_id", "_h", "_copy", (from_ - F.col("_block") * BLOCK_WORDS).alias("place"), (from_ - F.col("_at")).alias("from_word"), (to - from_).alias("n_words"))
    return drawn.join(held, ["_s", "_block"])


def schedule(docs: DataFrame) -> DataFrame:
    """slot, place, source, doc_id, from_word, n_words, _h, _copy: the mix as pieces of documents, in the order of slot and place.

    `docs` has doc_id, source and text; _h and _copy tell rows that share a doc_id apart. See mix() for what a source gets.
    """
    known, shares, edges, slots = _sized(docs)
    names = shares.select("_s", F.col("_name").alias("source"))
    out = _pieces(known, _drawn(shares, edges, slots)).join(names, "_s")
    return out.select("slot", "place", "source", "doc_id", "from_word", "n_words", "_h", "_copy")


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """slot, source, text: the words of the mix, one row per block, by words parted by single spaces. Rows that the mix takes no word of are in no block; an
    empty table gives none.

    The pieces of a document, no more than its words and two passes make, meet its text once, so that a long text is cut in one go.
    """
    plain = _told_apart(docs, "text").select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g"), F.col("_copy").alias("_c"), "text")
    piece = F.struct("slot", F.col("place").cast("long").alias("place"), F.col("from_word").cast("long").alias("from_word"), F.col("n_words").cast("long").alias("n_words"))
    told = schedule(docs).groupBy("source", "doc_id", "_h", "_copy").agg(F.collect_list(piece).alias("_pieces"))
    met = told.join(plain, told["doc_id"].eqNullSafe(plain["_d"]) & (told["_h"] == plain["_g"]) & (told["_copy"] == plain["_c"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            for source, text, pieces in zip(*batch.columns, strict=True):
                words = word.findall(text.as_py())
                own = pieces.as_py()
                parts = [" ".join(words[p["from_word"] : p["from_word"] + p["n_words"]]) for p in own]
                yield pa.RecordBatch.from_arrays([pa.array([p["slot"] for p in own], pa.int64()), pa.array([source.as_py()] * len(own), pa.string()), pa.array([p["place"] for p in own], pa.int64()), pa.array(parts, pa.string())], names=["slot", "source", "place", "part"])

    parts = met.select("source", "text", "_pieces").mapInArrow(run, "slot long, source string, place long, part string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), " ")
    return parts.groupBy("slot", "source").agg(joined.alias("text"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, _h, _copy, size, source_size, target, taken of every row of `docs` (doc_id, source, text).

    size: words of the text (null or empty: 0). source_size, target: of the row's source; a null source is a source of its
    own, last in order. taken: words that the schedule takes, repeats counted; never above twice the size, and in sum the whole
    words of the target. Rows that share a doc_id, or have none, are documents of their own. An empty table gives an empty
    one. Equal input gives equal results, in whatever partitions it comes.
    """
    known, shares, edges, slots = _sized(docs)
    taken = _pieces(known, _drawn(shares, edges, slots)).groupBy("doc_id", "_h", "_copy").agg(F.sum("n_words").alias("taken"))
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g"), F.col("_copy").alias("_c"), "taken")
    out = known.join(taken, known["doc_id"].eqNullSafe(taken["_d"]) & (known["_h"] == taken["_g"]) & (known["_copy"] == taken["_c"]), "left")
    return out.select("doc_id", "source", "_h", "_copy", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_with_texts(docs: DataFrame) -> DataFrame:
    """`docs` with size, source_size, target and taken added to their columns; columns of these names are replaced."""
    plain = docs.drop("size", "source_size", "target", "taken")
    told = mix(plain).select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g"), F.col("_copy").alias("_c"), "size", "source_size", "target", "taken")
    rows = _told_apart(plain, *(c for c in plain.columns if c not in ("doc_id", "source")))
    met = rows.join(told, rows["doc_id"].eqNullSafe(told["_d"]) & (rows["_h"] == told["_g"]) & (rows["_copy"] == told["_c"]))
    return met.select(*plain.columns, "size", "source_size", "target", "taken")


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, source, size, source_size, target, taken."""
    return mix(docs).drop("_h", "_copy")
