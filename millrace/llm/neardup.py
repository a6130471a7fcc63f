"""Near-duplicates by bottom-k sketches.

One hash function over the word shingles of a text; the `k` smallest values are its sketch. Inverted lists of the retained
values generate overlaps, an estimate from the union of two sketches filters them, and exact Jaccard similarity of the full
shingle sets verifies what is left. Equal texts are one class from the start, so lists hold each text once.

Two sets with similarity s >= 0.8 share, among the k smallest values of their union, k * s values in the mean. A pair is
missed by the lists or by the filter only if they share under NEEDED of these instead: for k = 64 and s = 0.8 a chance of
under 1e-8, and none for sets of up to k shingles, whose sketch is the set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import OUT_ROWS, Scan, blank_table, grams, scan, settle, slices, texts_of

#: Words in a shingle, values in a sketch, and the share of a sketch that a partner must hold.
SHINGLE, SKETCH, NEEDED = 4, 64, 0.4375
#: Words in a shingle where documents are dropped.
STAGE_SHINGLE = 5
#: Tasks that the texts of one component are dealt to when they get its smallest document.
SALTS = 16
#: Similarity of a link, in percent, so that the test is one of integers.
PERCENT = 80
#: Parity bits of a full shingle set, a multiple of 64.
PARITY = 1024
#: Sketches of linked texts agree on at least this share of their union, but for a chance of under 1e-8.
LEAST_ESTIMATE = 0.5


def text_key(raw: bytes) -> bytes:
    """128 bits of the words of a text in UTF-8, of the words themselves, so that texts of one key have one set."""
    return hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=16).digest()


def shingle_hashes(found: Scan, i: int, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of text i, which has words."""
    own = found.hashes[found.first[i] : found.first[i + 1]]
    return np.unique(grams(own, min(words, len(own))))


def sketches(docs: DataFrame, words: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, text_key, sketch: distinct shingles of the whole text, 128 bits of its words, its k smallest hashes.

    Words are runs of other than space and \\t to \\r, with A-Z lower-cased. A text of fewer words is one shingle; one without
    words, or a null one, has none, and a null key.
    """
    table = blank_table(lower=True)
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts_of(batch.column(1))
            for from_, to, data, bounds in slices(column):
                found = scan(data, bounds, table)
                sizes, keys, kept = [], [], []
                for i in range(to - from_):
                    if found.first[i] == found.first[i + 1]:
                        sizes.append(0), keys.append(None), kept.append([])
                        continue
                    own = shingle_hashes(found, i, words)
                    sizes.append(len(own))
                    keys.append(text_key(data[bounds[i] : bounds[i + 1]].tobytes()))
                    kept.append(own[:k].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(from_, to - from_), *(pa.array(c, t) for c, t in zip((sizes, keys, kept), types[1:], strict=True))], names=["doc_id", "n_shingles", "text_key", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, text_key binary, sketch array<long>")


def shingle_set(text: str | None, words: int = SHINGLE) -> frozenset:
    """The full set, of the words themselves."""
    own = (text or "").encode().lower().split()
    return frozenset(zip(*(own[i:] for i in range(words)), strict=False)) if len(own) >= words else frozenset([tuple(own)] if own else [])


def candidate_lists(classes: DataFrame) -> DataFrame:
    """node, n, value, size: the inverted lists worth walking, from one row per text (node, n_shingles, sketch).

    A partner holds at least NEEDED of a sketch of s values, say t. So it holds one of any s - t + 1 of them; those in the
    fewest sketches are taken, of which the ones in a single sketch lead nowhere. A text that shares fewer than t values with
    anyone has no partner, and a value that very many texts hold is walked only by texts made of such values.
    """
    held = classes.select("node", F.col("n_shingles").alias("n"), F.size("sketch").alias("_s"), F.explode("sketch").alias("value"))
    shared = held.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    both = held.join(shared, "value")
    rare = Window.partitionBy("node").orderBy("size", "value")
    ranked = both.withColumn("_i", F.row_number().over(rare)).withColumn("_m", F.count("*").over(Window.partitionBy("node")))
    need = F.greatest(F.lit(1), F.ceil(F.col("_s") * NEEDED)).cast("int")
    alone = F.col("_s") - F.col("_m")
    return ranked.where((F.col("_m") >= need) & (F.col("_i") <= F.col("_s") - need + 1 - alone)).select("node", "n", "value", "size")


def _near(a: str, b: str):  # type: ignore[no-untyped-def]
    """Sizes that allow the similarity."""
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def star_pairs(lists: DataFrame) -> DataFrame:
    """a < b: each member of a list with the list's first, last and one other member. Pairs grow with the lists, not their squares.

    Members are ordered by number of shingles within a list, in bands that neighbouring sizes share, so that a centre is of
    about the size of its members.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / PERCENT)))).cast("int")
    banded = lists.select("node", "n", "value", F.explode(F.array(band, band + 1)).alias("_band"))
    centres = banded.groupBy("value", "_band").agg(F.min("node").alias("_x"), F.max("node").alias("_y"), F.min_by("node", F.xxhash64("node")).alias("_z"), F.count("*").alias("_n")).where("_n > 1")
    met = banded.join(centres, ["value", "_band"]).select("node", F.explode(F.array_distinct(F.array("_x", "_y", "_z"))).alias("_c")).where("node <> _c")
    return met.select(F.least("node", "_c").alias("a"), F.greatest("node", "_c").alias("b")).distinct()


def unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """node, n, value, component of the lists that still hold several components."""
    named = lists.join(labels, lists["node"] == labels["_node"], "left").select("node", "n", "value", F.coalesce("component", "node").alias("component"))
    several = named.groupBy("value").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("value")
    return named.join(several, "value", "left_semi")


def crossing_pairs(open_lists: DataFrame, known: DataFrame) -> DataFrame:
    """a < b: the pairs of a list that are not in one component yet and that may be linked.

    Two sets of n and m shingles are linked only if at most (n + m) / 9 shingles are in just one of them (for 80 percent), and
    the parity bits of the two sets differ in no more places than that. The bound is exact, so it loses no link, and it is
    checked before a pair is made. A pair comes from the smallest value that both have open lists for, so only once.
    """
    values = open_lists.groupBy("node").agg(F.collect_set("value").alias("_values"))
    held = open_lists.join(values, "node").join(known.select("node", "parity"), "node")
    x, y = held.alias("x"), held.alias("y")
    apart = reduce(add, (F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i])) for i in range(PARITY // 64)))
    may = apart * (100 + PERCENT) <= (F.col("x.n") + F.col("y.n")) * (100 - PERCENT)
    on = (F.col("x.value") == F.col("y.value")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _near("x.n", "y.n") & may
    once = F.array_min(F.array_intersect("x._values", "y._values")) == F.col("x.value")
    return x.join(y, on & once).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def promising(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose sketches agree enough: of the k smallest values of both, the share that both hold."""
    own = known.select("node", "n_shingles", "sketch")
    met = pairs.join(own.toDF("a", "_na", "_sa"), "a").join(own.toDF("b", "_nb", "_sb"), "b").where(_near("_na", "_nb"))

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            merged = np.union1d(x.view(np.uint64), y.view(np.uint64))[:SKETCH]
            both = np.intersect1d(x.view(np.uint64), y.view(np.uint64), assume_unique=True)
            out[i] = np.isin(merged, both, assume_unique=True).mean()
        return pd.Series(out)

    return met.where(estimate("_sa", "_sb") >= LEAST_ESTIMATE).select("a", "b")


def verified(pairs: DataFrame, known: DataFrame, words: int = SHINGLE) -> DataFrame:
    """The pairs with 100 * intersection >= PERCENT * union, on the full sets of their texts."""
    text = known.select("node", "text")
    met = pairs.join(text.toDF("b", "_tb"), "b").join(text.toDF("a", "_ta"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, frozenset] = (None, frozenset())
        for whole in batches:
            for from_ in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(from_, OUT_ROWS)
                keep = []
                for i in range(batch.num_rows):
                    a = batch.column(0)[i].as_py()
                    if last[0] != a:  # pairs of a centre come together after the join
                        last = (a, shingle_set(batch.column(2)[i].as_py(), words))
                    other = shingle_set(batch.column(3)[i].as_py(), words)
                    both = len(last[1] & other)
                    if 100 * both >= PERCENT * (len(last[1]) + len(other) - both):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(j).take(pa.array(keep, pa.int64())) for j in (0, 1)], names=["a", "b"])

    return met.select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long")


def with_texts(classes: DataFrame, docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """`classes` with the text of each, that of its smallest doc_id with the key of the class, and the parity bits of its set:
    bit i is set if an odd number of its shingles has a hash of i modulo PARITY."""
    own = docs.where("doc_id is not null").select("doc_id", F.col("text"))
    met = classes.join(own, "doc_id").select("node", "text_key", "text")
    table = blank_table(lower=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, bits = [], []
            for from_, to, data, bounds in slices(texts_of(batch.column(2))):
                found = scan(data, bounds, table)
                for i in range(to - from_):
                    if text_key(data[bounds[i] : bounds[i + 1]].tobytes()) == batch.column(1)[from_ + i].as_py():
                        keep.append(from_ + i)
                        own = shingle_hashes(found, i, words)
                        bits.append(np.packbits(np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).view(np.int64))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(bits, pa.list_(pa.int64()))], names=["node", "text", "parity"])

    texts = met.mapInArrow(run, "node long, text string, parity array<long>").groupBy("node").agg(F.min(F.struct("text", "parity")).alias("_t"))
    return classes.join(texts.select("node", "_t.text", "_t.parity"), "node")


def near_duplicates(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= 80 * union of their sets of shingles of `words` words; component_id is
    the smallest doc_id reachable and kept says that it is the row's own. A text without words is linked with nothing. A row
    with a null doc_id has no component and is kept. Repeated rows get the same result; where a doc_id has several texts,
    each of its rows is judged by its own text. Columns other than doc_id and text are ignored; an empty table gives an empty one.

    Links are found between different texts only, and in two rounds: stars around centres of the inverted lists first, then
    all pairs of a list that stars have left in different components and whose parity bits allow a link. So a group of n near
    copies costs about n pairs, and pairs that only a chain connects are still found.
    """
    drawn = settle(sketches(docs, words))
    full = drawn.where("doc_id is not null and text_key is not null")
    grouped = full.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = settle(grouped.withColumn("node", F.monotonically_increasing_id()))  # written at once, so the numbers stay
    lists = settle(candidate_lists(classes))
    known = settle(with_texts(classes.join(lists.select("node").distinct(), "node", "left_semi"), docs, words))
    links = settle(verified(settle(promising(star_pairs(lists), known)), known, words))
    labels = components(links).select(F.col("node").alias("_node"), "component")
    left = settle(unsettled(lists, labels))
    more = settle(verified(settle(promising(crossing_pairs(left, known), known)), known, words))
    if not more.isEmpty():
        labels = components(links.union(more)).select(F.col("node").alias("_node"), "component")
    named = classes.select("node", "text_key", "doc_id").join(labels, F.col("node") == F.col("_node"), "left").select("node", "text_key", "doc_id", "component")
    alone = named.where("component is null").select(F.col("text_key").alias("_key"), F.col("doc_id").alias("component_id"))
    linked = named.where("component is not null").withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = alone.union(linked.join(smallest, ["component", "_salt"]).select(F.col("text_key").alias("_key"), "component_id"))
    out = drawn.select("doc_id", "n_shingles", "text_key").join(found, F.col("text_key") == F.col("_key"), "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.coalesce(group == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = STAGE_SHINGLE) -> DataFrame:
    """`docs` with one document of each group: the one with the smallest doc_id. Rows that share that id all stay."""
    gone = near_duplicates(docs.select("doc_id", "text"), words).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
