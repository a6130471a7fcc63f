"""Substring dedup with repeated-phrase automata.

A window is WINDOW consecutive words of a document. Its anchor is the smallest hash among its ANCHOR-word phrases, so equal
windows have equal anchors, and some five windows in a row share one: such a run, with its words, is a segment.

1. Anchors that several documents hold are found; all others rule their windows out.
2. The segments of those anchors are dealt out by anchor. Each task confirms, word by word, which windows recur, and
   compiles the recurring passages of a shard of anchors to an Aho-Corasick automaton over word numbers.
3. The segments are streamed through the automaton of their shard, which locates every occurrence. Every document takes
   part with all windows that can recur; a window's copies all have its anchor, so no other shard can hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import OUT_ROWS, Scan, blank_table, grams, mix, scan, slices, texts_of

WINDOW, ANCHOR = 13, 4
#: Documents that hold an anchor above which its windows are dealt out one by one instead of as segments, so that no task
#: has to hold what surrounds a passage that very many documents share.
HOT = 1000
#: Segments whose passages are compiled to one automaton.
SHARD = 4096


def anchored(found: Scan, window: int = WINDOW, phrase: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows that share an anchor: first window, last window, text, anchor. Windows are named by their first word."""
    n = len(found.hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    g = grams(found.hashes, phrase)
    least, place = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - phrase + 1):
        lower = g[j : n + j] < least
        least[lower], place[lower] = g[j : n + j][lower], j
    whole = np.flatnonzero(found.text[:n] == found.text[window - 1 :])
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    spot = whole + place[whole]
    head = np.concatenate([[True], (spot[1:] != spot[:-1]) | (whole[1:] != whole[:-1] + 1)])
    first = whole[head]
    last = np.append(whole[np.flatnonzero(head)[1:] - 1], whole[-1])
    return first, last, found.text[first], least[first]


def shared_anchors(docs: DataFrame) -> DataFrame:
    """doc_id, anchors, hot: the anchors of each document that other documents hold too; those of over HOT documents apart.

    A task sends one row per anchor and batch of documents, however many of these hold it.
    """
    table = blank_table(lower=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            hashes, ids = [], []
            for from_, _, data, bounds in slices(texts_of(batch.column(1))):
                _, _, text, anchor = anchored(scan(data, bounds, table))
                hashes.append(anchor)
                ids.append(keys[from_ + text])
            h, d = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(ids or [np.zeros(0, np.int64)])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            if not len(h):
                continue
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            h, d = h[new], d[new].astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(head, len(h)))
            for at in range(0, len(head), OUT_ROWS):
                here, n = head[at : at + OUT_ROWS], size[at : at + OUT_ROWS]
                rest = np.ones(n.sum(), bool)
                rest[np.concatenate([[0], np.cumsum(n)[:-1]])] = False
                more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n - 1)]), pa.int32()), pa.array(d[here[0] : here[0] + n.sum()][rest]), mask=pa.array(n == 1))
                yield pa.RecordBatch.from_arrays([pa.array(h[here].view(np.int64)), pa.array(d[here]), more], names=["anchor", "doc_id", "more"])

    rows = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long, more array<long>")
    same = Window.partitionBy("anchor")
    last = F.coalesce(F.element_at("more", -1), "doc_id")  # ids of a row ascend
    counted = rows.withColumns({"_lo": F.min("doc_id").over(same), "_hi": F.max(last).over(same), "_n": F.sum(F.coalesce(F.size("more"), F.lit(0)) + 1).over(same)}).where("_lo < _hi")
    each = counted.select("anchor", "_n", F.explode(F.when(F.col("more").isNull(), F.array("doc_id")).otherwise(F.concat(F.array("doc_id"), "more"))).alias("doc_id"))
    return each.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("_n") > HOT, F.col("anchor"))).alias("hot"))


def versions(docs: DataFrame) -> DataFrame:
    """_id: the doc_ids that have several texts. Their rows are told apart by a hash of the text, `own`, which is 0 for all others."""
    text = F.xxhash64("text")
    return docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(text).alias("_lo"), F.max(text).alias("_hi")).where("_lo <> _hi").select("_id")


def segments(joined: DataFrame) -> DataFrame:
    """key, single, passage, own, doc_id, start, more_ids, more_starts: the distinct segments of a batch of (doc_id, text, anchors,
    hot, own), by anchor, each with its smallest document and, if it is found more than once, the others; the windows of hot
    anchors one by one, by their own hash."""
    table = blank_table(lower=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, versions_of = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            wanted, hot_ones = _marked(batch.column(2)), _marked(batch.column(3))
            rows: dict[tuple[int, bool, bytes, int], tuple[list[int], list[int]]] = {}
            for from_, to, data, bounds in slices(texts_of(batch.column(1))):
                found = scan(data, bounds, table)
                first, last, text, anchor = anchored(found)
                marks = _mark(anchor, from_ + text)
                at = np.flatnonzero(np.isin(marks, wanted))
                hot = np.isin(marks[at], hot_ones).tolist()
                whole = grams(found.hashes, WINDOW)
                row, words, base = -1, [], 0
                for j, a, b, i, h, is_hot in zip(at.tolist(), first[at].tolist(), last[at].tolist(), text[at].tolist(), anchor[at].view(np.int64).tolist(), hot, strict=True):
                    if i != row:
                        row, words, base = i, data[bounds[i] : bounds[i + 1]].tobytes().split(), int(found.first[i])
                        doc, own = keys[from_ + i], versions_of[from_ + i]
                    if is_hot:
                        parts = [(k, True, x, x) for k, x in zip(whole[a : b + 1].view(np.int64).tolist(), range(a, b + 1), strict=True)]
                    else:
                        parts = [(h, False, a, b)]
                    for key, single, x, y in parts:
                        ids, starts = rows.setdefault((key, single, b" ".join(words[x - base : y - base + WINDOW]), own), ([], []))
                        ids.append(doc)
                        starts.append(x - base)
                if len(rows) >= OUT_ROWS:
                    yield _segment_batch(rows)
                    rows = {}
            if rows:
                yield _segment_batch(rows)

    return joined.select("doc_id", "text", "anchors", "hot", "own").mapInArrow(run, "key long, single boolean, passage binary, own long, doc_id long, start int, more_ids array<long>, more_starts array<int>")


def _mark(anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number for an anchor in a row of a batch. Two that are one by chance only add a segment."""
    return mix(anchor ^ mix(row.astype(np.uint64)))


def _marked(lists: pa.ListArray) -> np.ndarray:
    """The marks of all anchors in the rows of a column."""
    sizes = np.array([len(x.values) if x.is_valid else 0 for x in lists], np.int64)
    return _mark(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes))


def _segment_batch(rows: dict) -> pa.RecordBatch:
    key, single, passage, own = zip(*rows, strict=True)
    places = [sorted(zip(*lists, strict=True)) if len(lists[0]) > 1 else [(lists[0][0], lists[1][0])] for lists in rows.values()]
    more = [[[x[j] for x in p[1:]] if len(p) > 1 else None for p in places] for j in (0, 1)]
    columns = [pa.array(key, pa.int64()), pa.array(single), pa.array(passage, pa.binary()), pa.array(own, pa.int64())]
    columns += [pa.array([p[0][j] for p in places], t) for j, t in enumerate((pa.int64(), pa.int32()))]
    columns += [pa.array(more[j], pa.list_(t)) for j, t in enumerate((pa.int64(), pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "single", "passage", "own", "doc_id", "start", "more_ids", "more_starts"])


class Shard:
    """Segments of some anchors, to confirm the passages that recur in them and locate these."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.words: list[tuple[int, ...]] = []
        self.places: list[list[tuple[list[int], int, list[int]]]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)

    def add(self, group: dict[bytes, list[tuple[list[int], int, list[int]]]]) -> None:
        """All segments of an anchor, with the documents, ascending, their version, and first words of each."""
        if len(group) == 1:  # one text around this anchor: all of it recurs, or nothing
            ((passage, places),) = group.items()
            lo, hi = min(p[0][0] for p in places), max(p[0][-1] for p in places)
            if lo < hi:
                numbers = self.numbers
                words = tuple([numbers.setdefault(w, len(numbers)) for w in passage.split()])
                self.automaton.add_word(words, (len(words), lo))
                self.words.append(words)
                self.places.append(places)
            return
        numbers = self.numbers
        read = [(tuple(numbers.setdefault(w, len(numbers)) for w in passage.split()), places) for passage, places in group.items()]
        seen: dict[tuple[int, ...], list[int]] = {}
        for words, places in read:
            lo, hi = min(p[0][0] for p in places), max(p[0][-1] for p in places)
            for i in range(len(words) - WINDOW + 1):
                span = seen.setdefault(words[i : i + WINDOW], [lo, hi])
                span[0], span[1] = min(span[0], lo), max(span[1], hi)
        for words, places in read:
            used, run = False, None  # a passage: windows in a row that recur and start in the same document
            for i in range(len(words) - WINDOW + 2):
                span = seen[words[i : i + WINDOW]] if i + WINDOW <= len(words) else None
                origin = span[0] if span and span[0] < span[1] else None
                if run is not None and run[1] != origin:
                    self.automaton.add_word(words[run[0] : i - 1 + WINDOW], (i - 1 + WINDOW - run[0], run[1]))
                    used, run = True, None
                if run is None and origin is not None:
                    run = (i, origin)
            if used:
                self.words.append(words)
                self.places.append(places)

    def locate(self) -> Iterator[tuple[int, int, int, int]]:
        """doc_id, own, first word, word after the last, of every occurrence in a document other than the passage's first."""
        if not self.words:
            return
        self.automaton.make_automaton()
        for words, places in zip(self.words, self.places, strict=True):
            for end, (size, origin) in self.automaton.iter(words):
                for ids, own, starts in places:
                    for doc, start in zip(ids, starts, strict=True):
                        if doc > origin:
                            yield doc, own, start + end - size + 1, start + end + 1


def occurrences(parts: DataFrame) -> DataFrame:
    """doc_id, own, from_word, to_word of the windows that start in an earlier document too. Takes what segments() gives."""

    def batch_of(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "own", "from_word", "to_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, key, group, firsts, out = Shard(), 0, None, {}, {}, []
        for batch in batches:
            for anchor, single, passage, own, doc_id, start, more_ids, more_starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, starts = ([doc_id, *more_ids], [start, *more_starts]) if more_ids else ([doc_id], [start])
                if (anchor, single) != key:
                    if group:
                        shard.add(group)
                        held += len(group)
                    key, group, firsts = (anchor, single), {}, {}
                    if held >= SHARD:
                        out += shard.locate()
                        shard, held = Shard(), 0
                if single:  # rows of a window come by their smallest document: the first has the first
                    origin = firsts.setdefault(passage, doc_id)
                    out += [(doc, own, at, at + WINDOW) for doc, at in zip(ids, starts, strict=True) if doc > origin]
                else:
                    group.setdefault(passage, []).append((ids, own, starts))
                if len(out) >= OUT_ROWS:
                    yield batch_of(out)
                    out = []
        if group:
            shard.add(group)
        out += shard.locate()
        if out:
            yield batch_of(out)

    dealt = parts.repartition("key").sortWithinPartitions("key", "single", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, own long, from_word int, to_word int")


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed per row of `docs`.

    Every word that lies in a window whose words also start in a document with a smaller doc_id is removed; windows are
    those of the input. Words are runs of other than space and \\t to \\r, taken as they stand. Kept words are joined by one
    space. A null or empty text has no words; a row with a null doc_id keeps all and takes nothing from others. Rows that
    share a doc_id are of one document, so that they take nothing from each other, and each loses words at places of its own
    text only. Rows alike get the same result; columns other than doc_id and text are ignored; an empty table gives an
    empty one.
    """
    plain = docs.select("doc_id", "text")
    several = versions(plain)
    own = F.when(F.col("_id").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text")).alias("own")
    anchors = shared_anchors(plain)
    met = plain.join(anchors, "doc_id", "left").join(several, F.col("doc_id") == F.col("_id"), "left")
    found = occurrences(segments(met.select("doc_id", "text", "anchors", "hot", own)))
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("from_word", "to_word", "own")).alias("_spans"))
    spans = spans.select("doc_id", F.col("_spans.from_word").alias("_from"), F.col("_spans.to_word").alias("_to"), F.col("_spans.own").alias("_owns"))
    told = plain.join(spans, "doc_id", "left").join(several, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "_from", "_to", "_owns", own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, weight, from_ = [], [], [], 0, 0
            for i in range(batch.num_rows):
                words = (batch.column(1)[i].as_py() or "").encode().split()
                gone = 0
                if batch.column(2)[i].is_valid:
                    steps = np.zeros(len(words) + 1, np.int64)
                    mine = batch.column(4)[i].values.to_numpy() == batch.column(5)[i].as_py()
                    np.add.at(steps, batch.column(2)[i].values.to_numpy()[mine], 1)
                    np.add.at(steps, batch.column(3)[i].values.to_numpy()[mine], -1)
                    stays = np.cumsum(steps)[:-1] == 0
                    gone = int(len(words) - stays.sum())
                    kept.append(b" ".join(words[j] for j in np.flatnonzero(stays)))
                else:
                    kept.append(b" ".join(words))
                sizes.append(len(words))
                removed.append(gone)
                weight += len(kept[-1])
                if weight >= 8 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(from_, i + 1 - from_), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "kept_text", "n_words", "n_removed"])
                    kept, sizes, removed, weight, from_ = [], [], [], 0, i + 1

    return told.mapInArrow(run, "doc_id long, kept_text string, n_words long, n_removed long")


def passage_digest(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_sha256."""
    return drop_repeated_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    """doc_id, n_words, n_removed, kept_sha256 of each row by looking every window up, sorted, for tests."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, own in sorted(words, key=lambda x: x[0]):
        for i in range(len(own) - WINDOW + 1):
            first.setdefault(tuple(own[i : i + WINDOW]), d)
    out = []
    for d, own in words:
        stays = [True] * len(own)
        for i in range(len(own) - WINDOW + 1):
            if first[tuple(own[i : i + WINDOW])] < d:
                stays[i : i + WINDOW] = [False] * WINDOW
        kept = [w for w, s in zip(own, stays, strict=True) if s]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)
