"""Batch search: many queries in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import keyword as K
from ..operators import merge
from ..operators import ranking as R
from ..sources.files import base_name
from .errors import EmptyQuery
from .spaces import vectors_usable

MODES = ("hybrid", "vector", "keyword")
#: Hits and characters of a hit's text where nothing is asked for, and characters of a snippet.
DEFAULT_K, DEFAULT_CHARS, SNIPPET = 10, 2000, 220
#: Hits of a batch, at most, that every task knows, so that the texts of all chunks stay where they lie; those of a larger one are dealt.
TOLD_HITS = 1 << 18


@dataclass(frozen=True)
class SearchOptions:
    k: int = DEFAULT_K  # 0 or less: the default
    mode: str = "hybrid"
    group: str | None = None
    confidence: str = "all"
    strong: float | None = None
    fair: float | None = None
    modalities: tuple[str, ...] = ()  # none: all
    path_glob: str = ""
    max_chars: int = 0  # 0: the default; below: whole texts

    def settled(self) -> SearchOptions:
        """With defaults filled in; ValueError tells all that is wrong, at once."""
        wrong = [] if self.mode in MODES else [f"unknown mode {self.mode!r}"]
        wrong += [] if (self.strong is None) == (self.fair is None) else ["strong and fair go together"]
        if wrong:
            raise ValueError("; ".join(wrong))
        return replace(self, k=self.k if self.k > 0 else DEFAULT_K, max_chars=self.max_chars or DEFAULT_CHARS)

    @property
    def pool(self) -> int:
        """Candidates per list: five times k, or twenty times when hits are grouped."""
        return (20 if self.group else 5) * (self.k if self.k > 0 else DEFAULT_K)


def candidates(queries: DataFrame, chunks: DataFrame, options: SearchOptions, allowed: DataFrame | None = None, postings: K.Postings | None = None, vectors: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, sim, kw, rank: the fused lists, or the one list of the mode. See search() for the tables; `vectors` (chunk_id, vector)
    may lie beside the chunks, and so may `blocks` of all of these, which serve searches without a filter."""
    found = []
    if options.mode != "keyword":
        rows = chunks if vectors is None else vectors
        rows = rows if allowed is None else rows.join(allowed, "chunk_id", "left_semi")
    if options.mode != "keyword" and blocks is not None and allowed is None:
        found.append(V.search_blocks(queries, blocks, options.pool).withColumnRenamed("row_id", "chunk_id"))
    elif options.mode != "keyword":
        found.append(V.search(queries, rows.select(F.col("chunk_id").alias("row_id"), "vector"), options.pool).withColumnRenamed("row_id", "chunk_id"))
    if options.mode != "vector":
        found.append(K.keyword_hits(queries, postings or K.on_the_way(chunks), options.pool, allowed))
    if options.mode == "hybrid":
        return R.fuse(*found)
    if options.mode == "vector":
        return found[0].select("query_id", "chunk_id", F.col("sim").alias("score"), "sim", F.lit(False).alias("kw"), "rank")
    return found[0].select("query_id", "chunk_id", "score", F.lit(0.0).alias("sim"), "kw", "rank")


def _sure(hits: DataFrame, options: SearchOptions) -> DataFrame:
    if options.strong is None or options.mode == "keyword":
        return hits.withColumn("level", F.lit(0))
    return R.by_confidence(hits, options.confidence, options.strong, options.fair)


def search(queries: DataFrame, chunks: DataFrame, options: SearchOptions, allowed: DataFrame | None = None, postings: K.Postings | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, sim, kw, rank, level and the grouping column: the k best hits of each query.

    `queries` has query_id, text and, unless the mode is keyword, vector; `chunks` comes from keyword.analyzed(), or is the
    chunk table beside stored `postings`, and has a vector then too. `allowed` (chunk_id) filters candidates but not the statistics.
    """
    options = options.settled()
    hits = candidates(queries, chunks, options, allowed, postings, blocks=blocks)
    if options.group:
        hits = R.group_by(hits.join(chunks.select("chunk_id", options.group), "chunk_id"), options.group)
    return R.first_k(_sure(hits, options), options.k)


def details(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """`hits` with what a result shows of its chunk and document; hits whose chunk is gone are left out.

    An image that a text shows (its source_path is not the document's path) has the image's path and kind, and the text as parent.
    `chunks` has chunk_id, document_id, modality, text, heading_path, page, source_path, start_ms, end_ms; `docs` document_id,
    path, kind, pair_id.
    """
    own = chunks.select("chunk_id", F.col("document_id").alias("doc"), "modality", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("heading_path", F.lit("")).alias("heading"), F.coalesce("page", F.lit(0)).alias("page"), "source_path", F.coalesce("start_ms", F.lit(0)).cast("long").alias("start"), F.coalesce("end_ms", F.lit(0)).cast("long").alias("end"))
    named = docs.select(F.col("document_id").alias("doc"), "path", "kind", F.coalesce("pair_id", F.lit(0)).cast("long").alias("pair"))
    met = hits.join(own, "chunk_id").join(named, "doc")
    linked = (F.coalesce("source_path", F.lit("")) != "") & (F.col("source_path") != F.col("path"))
    shown = met.withColumn("linked", linked)
    told = {"parent_path": F.when(F.col("linked"), F.col("path")), "kind": F.when(F.col("linked"), "image").otherwise(F.col("kind")), "path": F.when(F.col("linked"), F.col("source_path")).otherwise(F.col("path"))}
    return shown.withColumns(told).drop("source_path")


def in_reach(chunks: DataFrame, docs: DataFrame, options: SearchOptions) -> DataFrame | None:
    """chunk_id of the chunks that the modalities and the path glob let through; None where neither is given."""
    if not options.modalities and not options.path_glob:
        return None
    rows = chunks.where(F.col("modality").isin(*options.modalities)) if options.modalities else chunks
    if options.path_glob:
        place = F.coalesce(F.nullif(F.col("source_path"), F.lit("")), "path")
        rows = rows.join(docs.select("document_id", "path"), "document_id").where(place.rlike(T.search_glob(options.path_glob)))
    return rows.select("chunk_id")


def search_documents(queries: DataFrame, chunks: DataFrame, docs: DataFrame, options: SearchOptions, postings: K.Postings | None = None, spaces: tuple[str, str] = ("", ""), vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and notices of a batch of queries (query_id, text and, unless the mode is keyword, vector).

    Results have query_id, rank, score, sim, level, path, kind, modality, page, start, end, heading, text, paired_path, parent_path,
    chunks (with a group: hits of the document) and chunk_id, doc. Notices have query_id and notice, all of a query's joined. In
    order: candidates, details, merged pairs, merged moments, grouping by document, confidence, the k best, trimmed and rounded.
    A blank query has no results, and a notice. `spaces` are the live vector space and that of the queries: if they differ,
    hybrid goes on with keywords and says so, vector mode is an error. See details() for the tables.
    """
    options = options.settled()
    asked = queries.where(F.trim("text") != "")
    notices = queries.where(F.coalesce(F.trim("text"), F.lit("")) == "").select("query_id", F.lit("empty query").alias("notice"))
    if options.mode != "keyword" and not vectors_usable(*spaces, options.mode):
        options = replace(options, mode="keyword")
        notices = notices.unionByName(asked.select("query_id", F.lit(f"keywords only: the index holds vectors of {spaces[0]}, not of {spaces[1]}").alias("notice")))
    hits = candidates(asked, chunks, options, in_reach(chunks, docs, options), postings, vectors)
    most = TOLD_HITS // (2 * options.pool)  # queries; two lists are fused
    if asked.limit(most + 1).count() <= most:
        hits = F.broadcast(hits)
    hits = details(hits, chunks, docs)
    merged = merge.merge_moments(merge.merge_pairs(hits))
    if options.group:
        merged = R.group_by(merged.withColumn("_document", F.coalesce("parent_path", "path")), "_document").drop("_document")
    else:
        merged = merged.withColumn("chunks", F.lit(0).cast("long"))
    sure = _sure(merged, options)
    if options.strong is not None and options.mode != "keyword":
        notices = notices.unionByName(R.confidence_notices(merged, sure, options.strong, options.fair))
    best = R.first_k(sure, options.k)
    place = F.row_number().over(R.Window.partitionBy("query_id").orderBy("rank")).alias("rank")
    rows = best.select("query_id", place, F.round("score", 4).alias("score"), F.round("sim", 3).alias("sim"), "level", "path", "kind", "modality", "page", "start", "end", "heading", T.trimmed(F.col("text"), options.max_chars).alias("text"), "paired_path", "parent_path", "chunks", "chunk_id", "doc")
    return rows, notices.groupBy("query_id").agg(F.concat_ws("; ", F.array_sort(F.collect_set("notice"))).alias("notice"))


def _told(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def result_json(rows: DataFrame) -> DataFrame:
    """query_id, rank, json: results as JSON objects without empty fields. start_ms stands wherever end_ms does, even if it is 0."""
    level = F.element_at(F.create_map(*(x for n, name in R.LEVELS.items() if name for x in (F.lit(n), F.lit(name)))), F.col("level"))
    number = lambda c: F.nullif(F.col(c), F.lit(0))
    fields = [
        F.col("score"), number("sim").alias("similarity"), level.alias("confidence"), F.col("path"), F.col("kind"), F.col("modality"), number("page").alias("page"),
        F.when(F.col("end") > 0, F.col("start")).alias("start_ms"), number("end").alias("end_ms"), _told("heading").alias("heading_path"), _told("text").alias("text"), _told("paired_path").alias("paired_path"), _told("parent_path").alias("parent_path"), number("chunks").alias("chunks"),
    ]
    return rows.select("query_id", "rank", F.to_json(F.struct(*fields)).alias("json"))


def shown(rows: DataFrame) -> DataFrame:
    """query_id, rank, lines: results for people, each one text of a few lines."""
    span = F.concat(T.clock(F.col("start")), F.lit("-"), T.clock(F.col("end")))
    moment = F.col("end") > F.col("start")
    where = F.concat("path", F.when(F.col("page") > 0, F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise(""), F.when(moment, F.concat(F.lit(", "), span)).otherwise(""))
    level = F.element_at(F.create_map(*(x for n, name in R.LEVELS.items() for x in (F.lit(n), F.lit(name)))), F.col("level"))
    sure = F.when(F.col("level") > 0, F.format_string("%s, similarity %.2f", level, "sim")).otherwise(F.format_string("score %.3f", "score"))
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    snippet = F.when(F.char_length(plain) > SNIPPET, F.concat(F.substring(plain, 1, SNIPPET), F.lit("…"))).otherwise(F.nullif(plain, F.lit("")))
    lines = F.concat_ws(
        "\n",
        F.format_string("%2d. %s (%s)", "rank", where, sure),
        F.concat(F.lit("    shown in "), "parent_path"),
        F.concat(F.lit("    transcribed in "), "paired_path"),
        F.concat(F.lit("    "), F.when(~moment, _told("heading"))),
        F.concat(F.lit("    "), snippet),
    )
    return rows.select("query_id", "rank", lines.alias("lines"))


def embedding_input(units: DataFrame) -> DataFrame:
    """`units` with title and input, what a model reads of them: `units` has path, modality, heading_path, text, page.

    A text is its heading, a blank line and its words; an image's caption its heading, a colon and its words; a page is told by
    its number from 0. The title is the file's name and, after it, the heading.
    """
    heading, body = F.coalesce(_told("heading_path"), F.lit("")), F.coalesce("text", F.lit(""))
    head = F.when(heading != "", F.concat(heading, F.when(F.col("modality") == "image", ": ").otherwise("\n\n"))).otherwise("")
    title = F.concat(base_name(F.col("path")), F.when(heading != "", F.concat(F.lit(" > "), heading)).otherwise(""))
    return units.withColumns({"title": title, "input": F.when(F.col("modality") == "pdf_page", (F.col("page") - 1).cast("string")).otherwise(F.concat(head, body))})


def embedded(queries: DataFrame, embed: Callable[[Column], Column], dim: int) -> DataFrame:
    """`queries` with the vectors that a plug-in makes of their normal texts; it gets a column of texts and gives one of vectors, of
    which one of another length is an error."""
    return queries.withColumn("vector", V.of_length(embed(T.normal_query(F.col("text"))).cast("array<float>"), dim))


def one_query(text: str) -> str:
    """The text of a single query, which must say something."""
    if not text.strip():
        raise EmptyQuery("empty query")
    return text.strip()
