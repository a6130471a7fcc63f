"""Tables of a corpus as immutable segments with tombstones, merged at read and compacted by tiers.

A commit writes one segment: the rows that came, and the ids of documents whose older rows are void. Nothing is rewritten, so what a commit writes
grows with what changed. A row of a segment lives unless a later segment voids its document: `row` voids the document's own row, `content`
its chunks, links, postings and vectors. Document frequencies are kept as differences, negative for what went, whose sum over all segments is exact.

Segments of a tier, FANOUT times larger than the one below, are merged once there are FANOUT of them at the young end, so that a row is rewritten
once a tier and a search reads some FANOUT segments a tier.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyword as K
from ..sources.storage import exists
from . import versions as VS
from .errors import Locked
from .versions import Segment, Version

DOCUMENTS = "document_id long, path string, kind string, sha256 string, size long, mtime long, status string, error string, chunk_count long, pair_id long, embed_id string, source string, attempts int, owner string, until long"
CHUNKS = "chunk_id long, document_id long, ord int, modality string, text string, heading_path string, page int, source_path string, start_ms long, end_ms long, tokens array<string>, bm25_len int"
LINKS = "document_id long, child_path string, alt string, heading_path string, page int"
VECTORS = "chunk_id long, document_id long, vector array<float>"
DEAD = "what string, document_id long"
TERMS = "term string, df long, part int"
#: Segments of a tier that are merged, and rows of the lowest tier's largest segment.
FANOUT, LOWEST = 8, 4096
#: Chunks that a document may have: a chunk's id is the document's times this, plus its place. More are an error.
PLACES = 1 << 20
#: Chunk ids that a cell of the posting table spans: some documents' worth.
CELL = 4 * PLACES
#: Parts in which a segment's vectors are made, each a unit that a rebuild that was cut off doesn't make again.
SLICES = 8


@dataclass(frozen=True)
class Segmented(K.Postings):
    """Postings of several segments; those of void chunks are left out as blocks are opened."""

    each: tuple[tuple[int, K.Postings], ...] = ()
    dead: DataFrame | None = None

    def of(self, terms: DataFrame) -> K.Postings:
        found = K.hashed_terms(terms)
        chosen = [(number, own.chosen(found)) for number, own in self.each]
        blocks = [own.blocks.withColumn("_number", F.lit(number)) for number, own in chosen]
        summed = united([own.terms for _, own in chosen]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return replace(self, blocks=united(blocks), terms=summed, each=())

    def live(self, rows: DataFrame) -> DataFrame:
        if self.dead is None:
            return rows.drop("_number")
        met = rows.withColumn("_doc", F.floor(F.col("chunk_id") / PLACES)).join(self.dead.select(F.col("document_id").alias("_doc"), "_dead"), "_doc", "left")
        return met.where("_dead is null or _dead <= _number").drop("_doc", "_dead", "_number")


def united(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def latest(self) -> Version:
        return VS.latest(self.spark, self.root)

    def folder(self, segment: Segment, table: str = "") -> str:
        return f"{self.root}/segments/{segment.name}/{table}"

    def _read(self, segments: list[Segment], table: str, schema: str) -> DataFrame:
        """Rows of all segments, with _number."""
        read = lambda s: self.spark.read.schema(schema).parquet(self.folder(s, table)).withColumn("_number", F.lit(s.number))
        return united([read(s) for s in segments]) if segments else self.spark.createDataFrame([], f"{schema}, _number int")

    def dead(self, segments: tuple[Segment, ...], what: str) -> DataFrame | None:
        """document_id, _dead: the last segment that voids the document's older rows; None where none does."""
        some = [s for s in segments if s.dead]
        if not some:
            return None
        return self._read(some, "dead", DEAD).where(F.col("what") == what).groupBy("document_id").agg(F.max("_number").alias("_dead"))

    def _live(self, segments: tuple[Segment, ...], having: list[Segment], table: str, schema: str, what: str) -> DataFrame:
        rows, dead = self._read(having, table, schema), self.dead(segments, what)
        if dead is not None:
            rows = rows.join(dead, "document_id", "left").where("_dead is null or _dead <= _number").drop("_dead")
        return rows.drop("_number")

    def documents(self, version: Version) -> DataFrame:
        return self._live(version.segments, [s for s in version.segments if s.documents], "documents", DOCUMENTS, "row")

    def chunks(self, version: Version) -> DataFrame:
        return self._live(version.segments, [s for s in version.segments if s.chunks], "chunks", CHUNKS, "content")

    def links(self, version: Version) -> DataFrame:
        return self._live(version.segments, [s for s in version.segments if s.links], "links", LINKS, "content")

    def vectors(self, version: Version, space: str) -> DataFrame:
        """chunk_id, document_id, vector of the chunks that have one in this space."""
        return self._live(version.segments, [s for s in version.segments if space in s.spaces], f"vectors/{space_folder(space)}/slice=*", VECTORS, "content")

    def postings(self, version: Version) -> K.Postings:
        return self._postings(version.segments, True)

    def _postings(self, segments: tuple[Segment, ...], known: bool) -> K.Postings:
        having = [s for s in segments if s.terms]
        n, tokens = sum(s.total for s in segments), sum(s.tokens for s in segments)
        sums = self.spark.createDataFrame([(n, tokens)], "n long, total long")
        if not having:
            none = self.spark.createDataFrame([], K.BLOCKS).drop("part")
            return K.Postings(none, self.spark.createDataFrame([], "term string, df long"), sums, CELL, 0, (n, tokens))
        each = tuple((s.number, K.stored(self.spark, self.folder(s, "keyword"))) for s in having)
        blocks = united([own.blocks.drop("part").withColumn("_number", F.lit(number)) for number, own in each])
        terms = united([own.terms.select("term", "df") for _, own in each]).groupBy("term").agg(F.sum("df").alias("df"))
        return Segmented(blocks, terms.where("df > 0") if known else terms.where("df <> 0"), sums, CELL, 1, (n, tokens), ("_number",), each, self.dead(segments, "content"))

    # ---- writing

    def segment(self, base: Version, docs: DataFrame | None = None, gone: DataFrame | None = None, chunks: DataFrame | None = None, links: DataFrame | None = None, replaced: DataFrame | None = None, vectors: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Segment:
        """Write a segment to be published after `base`.

        `docs` are the documents' new rows, `gone` (document_id) those deleted, `replaced` (document_id) those whose content before is void; all of `gone` is.
        `chunks` come from analyzed(), `vectors` makes them of chunks for each space.
        """
        own = Segment(f"{base.number + 1:012d}-{uuid.uuid4().hex}", base.number + 1)
        put = lambda rows, table: self._written(rows, own, table)
        void = [rows.select(F.lit("content").alias("what"), "document_id") for rows in (gone, replaced) if rows is not None]
        void += [rows.select(F.lit("row").alias("what"), "document_id") for rows in (gone, docs) if rows is not None]
        if docs is not None:
            own = replace(own, documents=put(docs.select(*(c.split()[0] for c in DOCUMENTS.split(", "))), "documents"))
        if void:
            own = replace(own, dead=put(united(void).distinct(), "dead") if base.segments else 0)
        if links is not None:
            own = replace(own, links=put(links, "links"))
        if chunks is not None:
            own = replace(own, chunks=put(chunks.select(*(c.split()[0] for c in CHUNKS.split(", "))), "chunks"))
        lost = None
        if own.dead and any(s.chunks for s in base.segments):
            ids = self.spark.read.schema(DEAD).parquet(self.folder(own, "dead")).where("what = 'content'").select("document_id")
            edge = ids.agg(F.min("document_id"), F.max("document_id")).first()
            if edge[0] is not None:
                lost = self.chunks(base).where(F.col("document_id").between(*edge)).join(ids, "document_id", "left_semi")
        came = self.spark.read.schema(CHUNKS).parquet(self.folder(own, "chunks")) if own.chunks else None
        if came is not None or lost is not None:
            own = self._keyword(own, came, lost)
        if came is not None and vectors:
            for space, make in vectors.items():
                self._vectors(make(came), own, space)
            own = replace(own, spaces=tuple(vectors))
        return own

    def _written(self, rows: DataFrame, segment: Segment, table: str) -> int:
        folder = self.folder(segment, table)
        rows.write.parquet(folder)
        return self.spark.read.parquet(folder).count()

    def _keyword(self, own: Segment, came: DataFrame | None, lost: DataFrame | None) -> Segment:
        none = self.spark.createDataFrame([], CHUNKS)
        sums = [K.totals(rows).select((F.col("n") * sign).alias("n"), (F.col("total") * sign).alias("total")) for rows, sign in ((came, 1), (lost, -1)) if rows is not None]
        row = united(sums).agg(F.sum("n").cast("long").alias("n"), F.sum("total").cast("long").alias("total")).first()
        found = K.on_the_way(came if came is not None else none, CELL)
        went = None if lost is None else K.terms_of(lost, "chunk_id").distinct().groupBy("term").agg((-F.count("*")).alias("df"))
        K.store(replace(found, totals=self.spark.createDataFrame([(row["n"], row["total"])], "n long, total long")), self.folder(own, "keyword"), went)
        return replace(own, total=row["n"], tokens=row["total"], terms=True)

    def _vectors(self, rows: DataFrame, segment: Segment, space: str) -> None:
        """All slices at once, for a segment that isn't published yet."""
        told = rows.select("chunk_id", "document_id", "vector", slice_of().alias("slice"))
        told.write.partitionBy("slice").parquet(self.folder(segment, f"vectors/{space_folder(space)}"))

    def slice(self, segment: Segment, space: str, k: int, make: Callable[[DataFrame], DataFrame]) -> bool:
        """Make part `k` of the segment's vectors, unless it is there. Whether there was work to do."""
        folder = self.folder(segment, f"vectors/{space_folder(space)}/slice={k}")
        if exists(self.spark, f"{folder}/_SUCCESS"):
            return False
        chunks = self.spark.read.schema(CHUNKS).parquet(self.folder(segment, "chunks"))
        mine = chunks.where(slice_of() == k)
        make(mine).select("chunk_id", "document_id", "vector").write.mode("overwrite").parquet(folder)
        return True

    def publish(self, base: Version, *own: Segment, **changes) -> Version:
        """The next version, with these segments too; Locked if another writer was first."""
        return VS.publish(self.spark, self.root, base, replace(base, segments=base.segments + own, **changes))

    # ---- merging

    def due(self, version: Version) -> int:
        """How many of the youngest segments to merge; 0 if none."""
        limit, sizes = LOWEST, [s.documents + s.chunks + s.dead for s in version.segments]
        while sizes:
            run = next((k for k, size in enumerate(reversed(sizes)) if size > limit), len(sizes))
            if run >= FANOUT:
                return run
            if limit > sum(sizes):
                return 0
            limit *= FANOUT
        return 0

    def compact(self, version: Version, run: int | None = None) -> Version:
        """Merge the `run` youngest segments, or as many as due. If another writer publishes meanwhile, the merge is dropped; the version is then `version`."""
        run = self.due(version) if run is None else run
        if run < 2:
            return version
        old, young = version.segments[:-run], version.segments[-run:]
        own = Segment(f"{version.number + 1:012d}-{uuid.uuid4().hex}", young[-1].number)
        part = Version(segments=young)
        put = lambda rows, table: self._written(rows, own, table)
        own = replace(own, documents=put(self.documents(part), "documents"), chunks=put(self.chunks(part), "chunks"), links=put(self.links(part), "links"))
        voids = [s for s in young if s.dead]
        if old and voids:
            own = replace(own, dead=put(self._read(voids, "dead", DEAD).drop("_number").distinct(), "dead"))
        if any(s.terms for s in young):
            # postings of live chunks anew, frequencies as the sum of differences
            came = self.spark.read.schema(CHUNKS).parquet(self.folder(own, "chunks"))
            found, sums = K.on_the_way(came, CELL), self._postings(young, False)
            minus = K.frequencies_of(found.blocks).select("term", (-F.col("df")).alias("df"))
            less = sums.terms.unionByName(minus).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            K.store(replace(found, totals=sums.totals), self.folder(own, "keyword"), less)
            own = replace(own, total=sum(s.total for s in young), tokens=sum(s.tokens for s in young), terms=True)
        having = [s for s in young if s.chunks]
        spaces = set.intersection(*(set(s.spaces) for s in having)) if having else set()
        for space in sorted(spaces) if own.chunks else ():
            self._vectors(self.vectors(part, space), own, space)
        own = replace(own, spaces=tuple(sorted(spaces)) if own.chunks else ())
        try:
            return VS.publish(self.spark, self.root, version, replace(version, segments=(*old, own)))
        except Locked:
            return version

    def vacuum(self, keep: int = 2) -> int:
        """Remove what only versions before the newest `keep` name; segments of the number after the newest may be another writer's and stay."""
        found = VS.numbers(self.spark, self.root)
        for number in found[:-keep]:
            VS.remove(self.spark, f"{self.root}/{VS.FOLDER}/{number:012d}")
        kept = found[-keep:]
        named = {s.name for n in kept for s in VS.read(self.spark, self.root, n).segments}
        void = [n for n in VS.folder_names(self.spark, f"{self.root}/segments") if n not in named and int(n.split("-")[0]) <= kept[-1]] if kept else []
        for name in void:
            VS.remove(self.spark, f"{self.root}/segments/{name}")
        return len(void)


def slice_of() -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(SLICES))


def space_folder(space: str) -> str:
    """A folder's name for a vector space."""
    return "".join(c if c.isalnum() or c in "-_." else f"={ord(c):x}=" for c in space)
