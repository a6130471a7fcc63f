"""Merges of ranked hits: a PDF with its transcription, and moments of one media file.

Which hit takes which in depends on the order of ranks. A pass over the hits of one document, or pair of documents, names the
host of each hit, the earlier one that it goes into; all else is grouping by host. Groups of different documents don't
touch each other, so the pass runs over partitions sorted by query, document and rank, and holds one group's state.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock

#: Longest span of merged moments, in milliseconds.
SPAN_MS = 60_000


def moment_hosts(ranges: Iterable[tuple[int, int]]) -> list[int]:
    """Hosts of hits (start, end) of one file in order of rank, by number: the first result that overlaps and stays within SPAN_MS together with the hit.

    Results lie in minutes by their start. One that takes a hit in begins in that of the hit's end or the one before; one longer than SPAN_MS takes none in.
    """
    minutes: dict[int, dict[int, tuple[int, int]]] = {}
    hosts = []
    for number, (start, end) in enumerate(ranges):
        host, low, high = number, start, end
        if start < end <= start + SPAN_MS:
            last = (end - 1) // SPAN_MS
            for minute in (last - 1, last):
                for r, (s, e) in minutes.get(minute, {}).items():
                    if r < host and s < end and start < e and max(e, end) - min(s, start) <= SPAN_MS:
                        host, low, high = r, min(s, start), max(e, end)
                        before = minute
            if host < number:
                del minutes[before][host]
            minutes.setdefault(low // SPAN_MS, {})[host] = (low, high)
        hosts.append(host)
    return hosts


def _merged_moments(hits: DataFrame) -> DataFrame:
    """Results of merge_moments() with host, and whether they have several hits and several modalities, as `_many` and `_mixed`.

    The window lays the hits of a file that a query has together in order of rank, and needs no exchange where those of a query lie together already. They pass
    as arrays; the last file of a batch waits for the next one.
    """
    columns = [c for c in hits.columns if c not in ("query_id", "rank")]

    def results(own: pa.Table, begins: list[int]) -> pa.RecordBatch:
        start, end = own.column("start").to_pylist(), own.column("end").to_pylist()
        host = np.fromiter((a + h for a, b in itertools.pairwise(begins) for h in moment_hosts(zip(start[a:b], end[a:b], strict=True))), np.int64, own.num_rows)
        order = np.argsort(host, kind="stable")  # a host is the first of its hits
        sorted_host = host[order]
        first = np.flatnonzero(np.append(True, sorted_host[1:] != sorted_host[:-1]))
        over = lambda f, values: f.reduceat(np.asarray(values)[order], first)
        best = own.take(pa.array(sorted_host[first]))
        kind = own.column("modality").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        told = {
            "start": pa.array(over(np.minimum, start), pa.int64()), "end": pa.array(over(np.maximum, end), pa.int64()),
            "sim": pa.array(over(np.fmax, own.column("sim").to_numpy())), "kw": pa.array(over(np.logical_or, own.column("kw").fill_null(False).to_numpy())),
        }
        named = {c: (told[c] if c in told else best.column(c)).cast(best.schema.field(c).type) for c in ("query_id", *columns)}
        named |= {"host": best.column("rank"), "_many": pa.array(np.diff(np.append(first, len(host))) > 1), "_mixed": pa.array(over(np.minimum, kind) != over(np.maximum, kind))}
        return pa.Table.from_pydict(named).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits: list[pa.RecordBatch] = []
        for batch in batches:
            last = np.flatnonzero(batch.column("_place").to_numpy() == 1)
            waits.append(batch)
            if len(last) and (last[-1] or len(waits) > 1):
                yield out([*waits[:-1], batch.slice(0, last[-1])])
                waits = [batch.slice(last[-1])]
        if sum(w.num_rows for w in waits):
            yield out(waits)

    def out(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(batches).combine_chunks()
        return results(own, [*np.flatnonzero(own.column("_place").to_numpy() == 1).tolist(), own.num_rows])

    fields = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema}
    schema = ", ".join([fields["query_id"], *(fields[c] for c in columns), "host int", "_many boolean", "_mixed boolean"])
    placed = hits.withColumn("rank", F.col("rank").cast("int")).withColumn("_place", F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("rank")))
    return placed.mapInArrow(run, schema)


class PairHosts:
    """Hosts for the hits of a PDF and its transcription."""

    def __init__(self) -> None:
        self.document: dict[int, int] = {}  # of each result, that of its first hit
        self.page: dict[int, int] = {}  # of each result, 0 if not known
        self.on_page: dict[int, int] = {}  # the latest result of a page
        self.first: dict[bool, int] = {}  # the first result of the PDF, and of the transcription's text without pages
        self.whole: set[int] = set()  # results that have both sides

    def _find(self, document: int, is_pdf: bool, page: int) -> int | None:
        beside = self.on_page.get(page) if page else None
        if beside is not None and self.document[beside] != document:
            return beside
        if is_pdf != bool(page):  # a text's page without the other side's, or a PDF's hit without a page, stands alone
            return None
        loose = self.first.get(not is_pdf)
        return None if loose in self.whole else loose

    def host(self, rank: int, document: int, is_pdf: bool, page: int) -> int:
        host = self._find(document, is_pdf, page)
        if host is None:
            host = rank
            self.document[rank], self.page[rank] = document, page
            if is_pdf or not page:
                self.first.setdefault(is_pdf, rank)
        else:
            self.whole.add(host)
            self.page[host] = self.page[host] or page
        if self.page[host]:
            self.on_page[self.page[host]] = host
        return host


def pair_hosts(hits: Iterable[tuple[int, int, bool, int]]) -> Iterator[int]:
    """Hosts of (rank, document, whether it is the PDF, page) of one pair."""
    pair = PairHosts()
    return (pair.host(*hit) for hit in hits)


def _with_hosts(hits: DataFrame, key: str, columns: list[str], hosts: Callable[[Iterable[tuple]], Iterator[int]]) -> DataFrame:
    """`hits` with host, by `hosts` over the given columns of the rows of a query and key in order of rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, feed, told = None, [], None
        for batch in batches:
            own = zip(*(batch.column(n).to_pylist() for n in ("query_id", key)), strict=True)
            values = zip(*(batch.column(n).to_pylist() for n in columns), strict=True)
            out = []
            for named, value in zip(own, values, strict=True):
                if named != group:
                    group, feed = named, []
                    told = hosts(feed.pop() for _ in iter(int, 1))  # one hit goes in, its host comes out
                feed.append(value)
                out.append(next(told))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "host"])

    dealt = hits.repartition("query_id", key).sortWithinPartitions("query_id", key, "rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    return dealt.mapInArrow(run, f"{fields}, host int")


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("host"))).drop("host")


def _members(hits: DataFrame) -> DataFrame:
    """query_id, host, m: the hits of each result in order of rank."""
    rest = [c for c in hits.columns if c not in ("query_id", "host", "rank")]
    return hits.groupBy("query_id", "host").agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("m"))


def _first(column: str) -> Column:
    return F.get(F.col("m"), F.lit(0))[column]


def _all(column: str) -> Column:
    return F.transform("m", lambda x: x[column])


def merge_moments(hits: DataFrame) -> DataFrame:
    """Hits of one media file whose ranges overlap become the best of them, widened to cover all, up to SPAN_MS.

    `hits` has query_id, rank, doc, start, end (milliseconds, both 0 for none), sim, kw, modality, heading; other columns are those
    of the best hit. The similarity is the largest, a keyword match that of any; a result of several modalities is
    audio+video; the heading of a merged one is its span.
    """
    told = {
        "modality": F.when(F.col("_mixed"), "audio+video").otherwise(F.col("modality")),
        "heading": F.when(F.col("_many"), F.concat(clock(F.col("start")), F.lit("-"), clock(F.col("end")))).otherwise(F.col("heading")),
    }
    return _ranked(_merged_moments(hits).withColumns(told)).select(*hits.columns)


def merge_pairs(hits: DataFrame) -> DataFrame:
    """Hits of a PDF and its transcription that tell of one page become one: the better one's place, the PDF's page, the text's words.

    `hits` has query_id, rank, doc, pair (the other document, 0 or null for none), linked (an image that a text shows), kind,
    page (0 for none), path, sim, kw, modality, heading, text; other columns are those of the better hit. paired_path is added:
    the path of the transcription in a merged result. An empty transcription leaves the PDF's text.
    """
    pair = F.coalesce("pair", F.lit(0))
    alone = (pair == 0) | F.col("linked")
    key = F.when(alone, -F.col("rank").cast("long")).otherwise(F.least("doc", "pair")).alias("_key")
    keyed = hits.select("*", key, (F.col("kind") == "pdf").alias("_pdf"))
    single = keyed.where("_key < 0").withColumn("host", F.col("rank").cast("int"))
    held = _members(_with_hosts(keyed.where("_key >= 0"), "_key", ["rank", "doc", "_pdf", "page"], pair_hosts).unionByName(single))
    # From the member on that comes after both sides are there, each one's words replace those before.
    later = F.when(_first("_pdf"), F.slice("m", 2, F.size("m"))).otherwise(F.slice("m", 3, F.size("m")))
    pdf = F.when(_first("_pdf") | (F.size("m") == 1), F.get("m", F.lit(0))).otherwise(F.get("m", F.lit(1)))
    worded = F.filter(later, lambda x: F.coalesce(x["text"], F.lit("")) != "")
    shown = F.when(F.size(worded) > 0, F.get(worded, F.size(worded) - 1)).otherwise(F.get("m", F.lit(0)))
    several = F.size("m") > 1
    told = {
        "path": pdf["path"],
        "kind": pdf["kind"],
        "page": F.when(F.coalesce(pdf["page"], F.lit(0)) != 0, pdf["page"]).otherwise(_first("page")),
        "sim": F.array_max(_all("sim")),
        "kw": F.exists("m", lambda x: x["kw"]),
        **{c: shown[c] for c in ("text", "heading", "modality")},
    }
    paired = F.when(several & (F.size(later) > 0), F.get(later, F.size(later) - 1)["path"]).when(several, _first("path"))
    rows = held.select("query_id", "host", *(told.get(c, _first(c)).alias(c) for c in hits.columns if c not in ("query_id", "rank")), paired.alias("paired_path"))
    return _ranked(rows).select(*hits.columns, "paired_path")
