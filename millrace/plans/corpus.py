"""A folder of documents with its index: scan, search, look, rebuild, watch.

The tables are segments, see segments.py: a scan writes what has changed and publishes it as the next version, in one step. A command that finds
that another writer published meanwhile raises Locked and changes nothing.

What waits to be read is the documents' own state: pending ones, failed ones with attempts left, and running ones whose lease ran out. A scan
first publishes what it found, then claims such documents for a while, reads them, and publishes what came out; a scan that is cut off leaves
claims that end by themselves.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..functions import vectors as V
from ..functions.embedder import Runner, embed_units
from ..operators import chunking as C
from ..operators import keyword as K
from ..operators import links as L
from ..operators import maintain as M
from ..sources import files as S
from ..streaming.watch import Debounce, watch_folder
from . import index as I
from . import search as SE
from . import spaces
from . import versions as VS
from .cache import QueryCache
from .config import Config, from_dict, problems, seconds
from .errors import CorpusError, Locked, NoModel, NotBuilt
from .segments import DOCUMENTS, LINKS, PLACES, SLICES, Store

#: How long a claim holds, in milliseconds.
LEASE_MS = 3_600_000
KNOWN = [c.split()[0] for c in DOCUMENTS.split(", ")]
#: Note of a PDF whose text is read from its transcription.
PAIRED = "text indexed from its Markdown transcription"


def plain_texts(files: DataFrame) -> DataFrame:
    """path, text, error of files (path, content): the usual reader."""
    return files.select("path", F.col("content").cast("string").alias("text"), F.lit(None).cast("string").alias("error"))


@dataclass
class Corpus:
    """`root` is the folder, `store` one that all executors share. `embed` makes vectors of a column of texts; without one, of a
    hashed bag of tokens. `settings.embed` names the vector space.

    `pages` (path, page, text) and `media` (path, duration_ms, has_audio, has_video) tell what is in PDF, audio and video files, which are not
    decoded here; without the table, such files wait. `reader` gets files (path, content) and gives path, text and error. A `runner` embeds units by
    batches in place of `embed`, of what search.embedding_input() makes of them, and queries as modality query.
    """

    spark: SparkSession
    root: str
    store: str
    settings: Config = field(default_factory=Config)
    embed: Callable[[Column], Column] | None = None
    pages: DataFrame | None = None
    media: DataFrame | None = None
    reader: Callable[[DataFrame], DataFrame] = plain_texts
    runner: Runner | None = None
    now: Callable[[], int] = lambda: int(time.time() * 1000)

    def __post_init__(self) -> None:
        if wrong := problems(self.settings):
            raise CorpusError("; ".join(wrong))
        self.tables = Store(self.spark, self.store)
        self.cache = QueryCache(self.spark, f"{self.store}/cache")
        self.owner = uuid.uuid4().hex

    @property
    def space(self) -> str:
        """The vector space that the settings name."""
        return f"{self.settings.embed.profile}@1:{self.settings.embed.dim}"

    def version(self) -> VS.Version:
        """What is published now."""
        found = self.tables.latest()
        if not found.number:
            raise NotBuilt(f"nothing is indexed in {self.store} yet")
        return found

    def documents(self, status: str = "", kind: str = "") -> DataFrame:
        """Documents in order of path, with pair_path; an empty status or kind is any."""
        return M.list_documents(M.with_pair_path(self.tables.documents(self.version())), status, kind)

    def index(self) -> I.Index:
        version = self.version()
        return I.Index(self.tables.chunks(version), self.tables.postings(version))

    def _vector(self, text: Column, dim: int | None = None) -> Column:
        dim = dim or self.settings.embed.dim
        return V.of_length(self.embed(text).cast("array<float>"), dim) if self.embed else V.embed_tokens(T.tokens(text), dim)

    def _maker(self, space: str) -> Callable[[DataFrame], DataFrame]:
        dim = spaces.told_by(space)[2]
        if self.runner is None:
            return lambda chunks: chunks.withColumn("vector", self._vector(F.col("text"), dim))

        def run(chunks: DataFrame) -> DataFrame:
            paths = self.tables.documents(self.tables.latest()).select("document_id", "path")
            told = SE.embedding_input(chunks.select("chunk_id", "document_id", "modality", "text", "heading_path", "page").join(paths, "document_id"))
            return embed_units(told, replace(self.runner, dim=dim))

        return run

    def _asked(self, queries: DataFrame) -> DataFrame:
        """`queries` with vector."""
        dim = self.settings.embed.dim
        if self.runner is None:
            return SE.embedded(queries, self._vector, dim)
        told = queries.withColumns({"modality": F.lit("query"), "input": T.normal_query(F.col("text"))})
        return embed_units(told, replace(self.runner, dim=dim)).drop("modality", "input")

    def _folders(self) -> list[str]:
        return self.settings.scan.folders or ["."]

    def _listed(self) -> tuple[DataFrame, list[str]]:
        """path, size, mtime (microseconds), kind of all files in scope, and the folders that aren't there."""
        files, missing = S.listing_of(self.spark, self.root, self._folders())
        scan = self.settings.scan
        kinds = [S.CONFIGURED.get(k, k) for k in scan.kinds]
        return S.in_scope(files.withColumn("mtime", F.unix_micros("mtime")), self._folders(), scan.ignore, kinds), missing

    def _contents(self, wanted: DataFrame) -> DataFrame:
        """path, content of the files of `wanted` (path, mtime in microseconds); files that changed before the oldest of these are not opened."""
        since = wanted.agg(F.min("mtime")).first()[0]
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root)
        found = found.where(F.col("modificationTime") >= F.timestamp_micros(F.lit(since if since is not None else 1 << 52)))
        return found.select(S.below(self.spark, self.root).alias("path"), "content").join(wanted.select("path"), "path", "left_semi")

    def _readable(self) -> list[str]:
        """Kinds of documents that can be read with the tables that are there."""
        return ["markdown", "code", "image", *(["pdf"] if self.pages is not None else []), *(["audio", "video"] if self.media is not None else [])]

    def _mirror(self, path: Column) -> Column:
        """The PDF that a folder of transcriptions, as set up, mirrors; null for other texts."""
        out = F.lit(None).cast("string")
        for pair in self.settings.pairs:
            place = F.concat(F.lit(f"{pair.pdf}/"), F.regexp_replace(F.substring(path, len(pair.md) + 2, 1 << 20), r"\.[^./]*$", ".pdf"))
            out = F.when(path.startswith(f"{pair.md}/"), place).otherwise(out)
        return out

    def scan(self) -> dict:
        """Compare the folder with the index, and index what has changed. What was done, as numbers and lists of folders."""
        work = f"{self.store}/work/{uuid.uuid4().hex}"
        live = self.tables.latest()
        spaces.fitting(live.space, self.space, sum(s.chunks for s in live.segments))  # before anything is claimed

        def kept(rows: DataFrame) -> DataFrame:
            """`rows` written once, since several steps read them; gone after the scan."""
            folder = f"{work}/{uuid.uuid4().hex}"
            rows.write.parquet(folder)
            return self.spark.read.schema(rows.schema).parquet(folder)

        try:
            report, listed, version, mine = self._discover(kept)
            done = {"indexed": 0, "failed": 0, "linked": 0}
            tried = mine.select("document_id")
            while not mine.isEmpty():
                for name, n in self._work(version, mine, listed, kept).items():
                    done[name] += n
                version, mine = self._claim(kept, tried)  # images that lost their text come up after a round
                tried = tried.union(mine.select("document_id"))
            self.tables.compact(self.tables.latest())
            return report | done
        finally:
            VS.remove(self.spark, work)

    def _discover(self, kept: Callable[[DataFrame], DataFrame]) -> tuple[dict, DataFrame, VS.Version, DataFrame]:
        """Publish what the folder's listing changes: new, changed, moved, revived and deleted documents, pairs, and claims of all that waits.

        What was done, the listing, what is published then, and the claimed documents.
        """
        base = self.tables.latest()
        listed, missing = self._listed()
        listed = kept(listed)
        known = kept(self.tables.documents(base))
        moved = listed.join(known.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m")), "path", "left").where("_s is null or _s <> size or _m <> mtime")
        texts = kept(moved.join(self._contents(moved), "path").withColumn("sha256", F.sha2("content", 256)).select("path", "size", "mtime", "kind", "sha256", F.when(F.col("kind") == "markdown", S.front_matter_source(F.col("content").cast("string"))).alias("source")))
        same = listed.join(moved.select("path"), "path", "left_anti").join(known.select("path", "sha256", "source"), "path")
        found = texts.unionByName(same.select(*texts.columns))
        change = kept(M.snapshot_diff(known.select("path", "size", "mtime", "sha256", "status"), found.select("path", "size", "mtime", "sha256")))
        gone = M.really_gone(change.where("change = 'gone'").join(known.select("path", "status", "kind", "sha256", "document_id"), "path"), self.settings.scan.keep, listed.select("path"))
        fresh = change.where("change = 'new'").join(found, "path")
        renamed = kept(M.moves(gone.select("path", "kind", "sha256"), fresh.select("path", "kind", "sha256")))
        lost = kept(gone.join(renamed.select(F.col("old_path").alias("path")), "path", "left_anti").select("document_id"))
        first = known.agg(F.coalesce(F.max("document_id"), F.lit(0))).first()[0]
        added = fresh.join(renamed.select(F.col("new_path").alias("path")), "path", "left_anti")
        numbered = M.numbered(kept(added.select("path").repartitionByRange("path").withColumn("_part", F.spark_partition_id())), "path", first, "document_id")
        left, _ = M.delete_documents(known, self.tables.links(base).withColumnRenamed("document_id", "parent_id"), lost)
        named = left.join(renamed, F.col("path") == F.col("old_path"), "left").withColumn("path", F.coalesce("new_path", "path")).drop("old_path", "new_path")
        told = found.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("sha256").alias("_sha"), F.col("source").alias("_source"))
        met = named.join(told, "path", "left").join(change.where("change in ('changed', 'revived')"), "path", "left")
        status = F.when(F.col("change") == "changed", "pending").when(F.col("change") == "revived", M.revived_status(F.col("chunk_count"), F.col("embed_id"))).otherwise(F.col("status"))
        old = met.withColumns({"status": status, "attempts": F.when(F.col("change") == "changed", 0).otherwise(F.col("attempts")), "size": F.coalesce("_size", "size"), "mtime": F.coalesce("_mtime", "mtime"), "sha256": F.coalesce("_sha", "sha256"), "source": F.when(F.col("_sha").isNull(), F.col("source")).otherwise(F.col("_source"))}).select(*KNOWN)
        blank = {"status": F.lit("pending"), "chunk_count": F.lit(0).cast("long"), "attempts": F.lit(0), "until": F.lit(0).cast("long"), "pair_id": F.lit(None).cast("long")} | {c: F.lit(None).cast("string") for c in ("error", "embed_id", "owner")}
        new = added.join(numbered, "path").withColumns(blank).select(*KNOWN)
        docs = kept(old.unionByName(new))
        pairs = M.pairs(docs.where("kind = 'markdown' and status <> 'stale'").select("path", "source", self._mirror(F.col("path")).alias("mirror")), docs.where("kind = 'pdf' and status <> 'stale'").select("path"))
        docs = kept(self._claimed(M.apply_pairs(docs, pairs).select(*KNOWN)))
        counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}  # a row for each kind of change
        report = {name: counts.get(name, 0) for name in ("new", "changed", "revived", "unchanged", "touched")}
        report |= {"moved": renamed.count(), "found": found.count(), "missing_folders": missing, "pairs": M.pair_count(docs).first()["n"]}
        report["new"] -= report["moved"]
        report["deleted"] = lost.count()
        turned = kept(docs.exceptAll(known))
        if not base.number or report["deleted"] or not turned.isEmpty():
            own = self.tables.segment(base, docs=turned, gone=lost if report["deleted"] else None)
            base = self.tables.publish(base, own, space=base.space or self.space)
        return report, listed, base, turned.where((F.col("status") == "running") & (F.col("owner") == self.owner))

    def _claimed(self, docs: DataFrame) -> DataFrame:
        """`docs` with this writer's lease on all readable ones that wait."""
        now = self.now()
        waiting = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("attempts") < M.MAX_ATTEMPTS)) | ((F.col("status") == "running") & (F.col("until") < now))
        mine = waiting & F.col("kind").isin(self._readable())
        told = {"status": F.lit("running"), "owner": F.lit(self.owner), "until": F.lit(now + LEASE_MS).cast("long")}
        return docs.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in told.items()})

    def _claim(self, kept: Callable[[DataFrame], DataFrame], tried: DataFrame) -> tuple[VS.Version, DataFrame]:
        """Lease what has come to wait since, but for those `tried` (document_id): what is published then, and their rows, none if nothing waits."""
        base = self.tables.latest()
        docs = self.tables.documents(base).join(tried, "document_id", "left_anti")
        mine = kept(self._claimed(docs).exceptAll(docs))
        return (base if mine.isEmpty() else self.tables.publish(base, self.tables.segment(base, docs=mine))), mine

    def _units(self, mine: DataFrame, texts: DataFrame, listed: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Units of the claimed documents, in order, and document_id, error of those that can't be read."""
        todo = mine.select("document_id", "path", "kind", F.col("pair_id").isNotNull().alias("paired")).join(texts, "path", "left")
        code = todo.where("kind = 'code'").withColumn("error", F.coalesce("error", S.code_problem(F.col("text"))))
        none = lambda kind: F.lit(None).cast(kind)
        fields = {"part": F.lit(0), "at": F.col("ord").cast("long"), "modality": F.lit("text"), "heading_path": F.lit(""), "page": F.lit(0), "source_path": none("string"), "start_ms": none("long"), "end_ms": none("long")}
        unit = lambda rows, **more: rows.select("document_id", "text", *((fields | more)[c].alias(c) for c in fields))
        own = {"heading_path": F.col("heading_path"), "page": F.col("page").cast("int")}
        shown = links.select("document_id", F.coalesce(F.nullif("alt", F.lit("")), S.file_words(F.col("child_path"))).alias("text"), "child_path", "heading_path", "page")
        units = [
            unit(C.chunk_documents(todo.where("kind = 'markdown' and error is null"), self.settings.chunk.tokens, self.settings.chunk.overlap), **own),
            unit(shown, **own, part=F.lit(1), at=F.xxhash64("child_path"), modality=F.lit("image"), source_path=F.col("child_path")),
            unit(C.chunk_code(code.where("error is null")), heading_path=F.col("label")),
            unit(todo.where("kind = 'image'").select("document_id", "path", S.file_words(F.col("path")).alias("text")), at=F.lit(0).cast("long"), modality=F.lit("image"), source_path=F.col("path")),
        ]
        errors = [todo.where("error is not null").select("document_id", "error"), code.where("error is not null").select("document_id", "error")]
        if self.pages is not None:
            pdf = todo.where("kind = 'pdf'")
            pages = pdf.select("document_id", "path", "paired").join(self.pages.select("path", "page", T.clean_page(F.coalesce("text", F.lit(""))).alias("words")), "path")
            said = pages.where("words <> '' and not paired").select("document_id", F.col("words").alias("text"), "page")
            units.append(unit(said, page=F.col("page"), at=F.col("page").cast("long")))
            if self.settings.index.pdf_page_images:
                units.append(unit(pages.select("document_id", F.lit("").alias("text"), "page"), page=F.col("page"), part=F.lit(1), at=F.col("page").cast("long"), modality=F.lit("pdf_page")))
            filled = pages.select("document_id") if self.settings.index.pdf_page_images else said.select("document_id")
            errors.append(pdf.where("not paired").join(filled, "document_id", "left_anti").select("document_id", F.lit("no content").alias("error")))
        if self.media is not None:
            clips = todo.where(F.col("kind").isin("audio", "video")).select("document_id", "path", "kind").join(self.media, "path", "left")
            made = C.media_units(clips)
            units.append(unit(made.where("error is null"), at=F.col("start_ms"), part=F.when(F.col("modality") == "video", 0).otherwise(1), modality=F.col("modality"), heading_path=F.col("heading_path"), start_ms=F.col("start_ms"), end_ms=F.col("end_ms")))
            errors.append(made.where("error is not null").select("document_id", "error").distinct())
        every, wrong = units[0], errors[0]
        for u in units[1:]:
            every = every.unionByName(u)
        for e in errors[1:]:
            wrong = wrong.unionByName(e)
        place = F.row_number().over(Window.partitionBy("document_id").orderBy("part", "at", "page")) - 1
        held = F.when(place < PLACES, place).otherwise(F.raise_error(F.lit(f"a document of more than {PLACES} chunks")).cast("int"))
        rows = every.withColumn("ord", held).select((F.col("document_id") * PLACES + F.col("ord")).alias("chunk_id"), "document_id", "ord", "modality", "text", "heading_path", "page", "source_path", "start_ms", "end_ms")
        return rows, wrong.groupBy("document_id").agg(F.min("error").alias("error"))

    def _work(self, base: VS.Version, mine: DataFrame, listed: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> dict:
        """Read the claimed documents, and publish what came out."""
        wanted = mine.where(F.col("kind").isin("markdown", "code")).select("path", "mtime")
        texts = kept(self.reader(self._contents(wanted)).select("path", "text", "error"))
        shown = L.image_links(mine.where("kind = 'markdown'").join(texts.where("error is null"), "path").select("document_id", "path", "text"))
        links = kept(L.resolve_links(shown, listed.select("path")).where("child_path is not null").select(*(c.split()[0] for c in LINKS.split(", "))))
        before = self.tables.links(base)
        docs = kept(self.tables.documents(base))
        by_parent = lambda rows: rows.withColumnRenamed("document_id", "parent_id")
        every = kept(before.select("document_id", "child_path").join(mine.select("document_id"), "document_id", "left_anti").unionByName(links.select("document_id", "child_path")).distinct())
        # an image that any text shows has no chunks of its own
        alone = mine.join(every.select(F.col("child_path").alias("path")).distinct(), "path", "left_anti")
        alone = kept(alone.unionByName(mine.where("kind <> 'image'").join(alone.select("document_id"), "document_id", "left_anti")))
        units, errors = self._units(alone, texts, listed, links)
        errors = kept(errors)
        chunks = kept(K.analyzed(units))
        counts = chunks.groupBy("document_id").agg(F.count("*").alias("_n"))
        space = base.space if base.space == self.space or base.number and any(s.chunks for s in base.segments) else self.space
        met = mine.drop("chunk_count").join(counts, "document_id", "left").join(errors.withColumnRenamed("error", "_error"), "document_id", "left").withColumn("chunk_count", F.coalesce("_n", F.lit(0).cast("long")))
        bad = F.col("_error").isNotNull()
        note = F.when((F.col("kind") == "pdf") & F.col("pair_id").isNotNull(), PAIRED)
        told = {"error": F.coalesce("_error", note), "embed_id": F.when(~bad, F.lit(space)), "status": F.when(bad, "failed").otherwise("done"), "attempts": F.when(bad, F.col("attempts") + 1).otherwise(0), "owner": F.lit(None).cast("string"), "until": F.lit(0).cast("long")}
        read = kept(met.withColumns(told).select(*KNOWN))
        # what the links do to other documents
        parents = mine.where("kind = 'markdown'").select("document_id")
        noted = docs.join(read.select("document_id"), "document_id", "left_anti").unionByName(read).withColumn("note", F.col("error"))
        _, linked = M.replace_links(noted, by_parent(before), by_parent(links), parents)
        taken = every.select(F.col("child_path").alias("path")).distinct().withColumn("_in", F.lit(True))
        linked = linked.withColumn("error", F.col("note")).join(taken, "path", "left")
        child = F.col("_in") & (F.col("kind") == "image")
        linked = linked.withColumns({"status": F.when(child, "done").otherwise(F.col("status")), "error": F.when(child, M.LINKED).otherwise(F.col("error")), "chunk_count": F.when(child, 0).otherwise(F.col("chunk_count"))})
        turned = kept(linked.select(*KNOWN).exceptAll(docs))
        children = docs.where("kind = 'image' and chunk_count > 0").join(links.select(F.col("child_path").alias("path")).distinct(), "path", "left_semi").select("document_id")
        to = spaces.written(space, base.building)
        own = self.tables.segment(base, docs=turned, chunks=chunks, links=links, replaced=mine.select("document_id").union(children), vectors={s: self._maker(s) for s in to})
        self.tables.publish(base, own, space=space)
        return {"indexed": mine.count() - errors.count(), "failed": errors.count(), "linked": mine.join(alone.select("document_id"), "document_id", "left_anti").count()}

    def search(self, query: str | DataFrame, options: SE.SearchOptions | None = None) -> tuple[DataFrame, DataFrame]:
        """Results and notices of one query, or of many (query_id, text); see plans.search.search_documents().

        Vectors of queries that were asked before, in this space, come from the cache; a batch of such ones doesn't call the embedder.
        """
        options = options or SE.SearchOptions()
        version = self.version()
        asked = query if isinstance(query, DataFrame) else self.spark.createDataFrame([(0, SE.one_query(query))], "query_id long, text string")
        if options.mode != "keyword" and spaces.vectors_usable(version.space, self.space, options.mode):
            cache = self.settings.cache
            asked = self.cache.embedded(asked, self.space, self._asked, self.now(), cache.query_max)
        docs = self.tables.documents(version)
        return SE.search_documents(asked, self.tables.chunks(version), docs, options, self.tables.postings(version), (version.space, self.space), self.tables.vectors(version, version.space))

    def status(self) -> dict:
        """Numbers of the index, ready to be written as JSON."""
        version = self.version()
        docs = self.tables.documents(version)
        by = lambda column: {r[column]: r["count"] for r in docs.groupBy(column).count().collect()}
        told = by("status")
        return {
            "root": self.root, "space": version.space, "wanted_space": self.space, "building": version.building, "documents": sum(told.values()), "by_status": told, "by_kind": by("kind"), "pairs": M.pair_count(docs).first()["n"],
            "chunks": self.tables.chunks(version).count(), "queued": told.get("pending", 0) + told.get("running", 0), "segments": len(version.segments), "folders": {r["folder"]: r["n"] for r in self.folders().collect()},
        }

    def folders(self) -> DataFrame:
        """folder, n: documents below each configured folder."""
        asked = self.spark.createDataFrame([(f,) for f in self._folders()], "folder string")
        docs = self.tables.documents(self.version()).select("document_id", "path")
        return asked.join(docs, S.folder_covers(F.col("folder"), F.col("path")), "left").groupBy("folder").agg(F.count("document_id").alias("n"))

    def remove_folder(self, folder: str) -> int:
        """Take a folder out of the settings: its documents are stale, and found until the next scan deletes or revives them. How many."""
        base = self.version()
        docs = self.tables.documents(base)
        rest = [f for f in self._folders() if f != folder]
        held = F.lit(False)
        for f in rest:
            held = held | S.folder_covers(F.lit(f), F.col("path"))
        turned = M.mark_stale(docs, [folder]).where(~held).exceptAll(docs)
        n = turned.count()
        if n:
            self.tables.publish(base, self.tables.segment(base, docs=turned))
        self.settings.scan.folders = rest
        return n

    def rebuild(self, size: int = 0, free_mb: int = -1, force: bool = False) -> spaces.Rebuild:
        """Make the vectors of all chunks anew for the space that the settings name; searches read the old ones meanwhile.

        The space is published as under way, so that scans write its vectors too. Vectors are made by segment and slice, each of which is
        kept once whole: a rebuild that was cut off goes on where it stood, and segments that came meanwhile are taken in. Then the space is published
        as the live one. Going back to the live space's settings gives a rebuild up.
        """
        version = self.version()
        dims = tuple(spaces.told_by(s)[2] for s in (version.space, self.space))
        plan = spaces.rebuild(version.space, version.building, self.space, sum(s.chunks for s in version.segments), size, dims, free_mb, force)
        if plan.mode == "cancelled":
            self.tables.publish(version, building="")
        if plan.mode in ("none", "cancelled"):
            return plan
        if version.building != self.space:
            version = self.tables.publish(version, building=self.space)
        while True:
            for s in [s for s in version.segments if s.chunks and self.space not in s.spaces]:
                for k in range(SLICES):
                    self.tables.slice(s, self.space, k, self._maker(self.space))
            latest = self.tables.latest()
            if latest.building != self.space:
                raise Locked(f"another writer gave the rebuild of {self.store} up")
            made = {s.name for s in version.segments}
            if all(s.name in made or self.space in s.spaces or not s.chunks for s in latest.segments):
                break
            version = latest
        done = tuple(VS.replace(s, spaces=tuple(sorted({*s.spaces, self.space}))) if s.chunks else s for s in latest.segments)
        named = self.tables.documents(latest).where("embed_id is not null")
        turned = named.withColumn("embed_id", F.lit(self.space)).exceptAll(named)
        VS.publish(self.spark, self.store, latest, VS.replace(latest, segments=(*done, self.tables.segment(latest, docs=turned)), space=self.space, building=""))
        return plan

    def vacuum(self, keep: int = 2) -> int:
        """Remove segments that only older versions than the newest `keep` name; searches that still read these must be over."""
        self.cache.fold(self.settings.cache.query_max, int(self.now() - 1000 * seconds(self.settings.cache.query_ttl)))
        return self.tables.vacuum(keep)


    def watch(self, settings: Callable[[], Config], checkpoint: str | None = None) -> StreamingQuery:
        """Scan whenever the folder has changed and then been quiet, with the settings as they are then; see watch_folder() for restarts."""

        def rescan(config: Config) -> None:
            self.settings = config
            self.scan()

        return watch_folder(self.spark, lambda: self._listed()[0], rescan, Debounce(settings, problems, dump=asdict, parse=from_dict), checkpoint=checkpoint)

    def model(self) -> Callable[[Column], Column] | Runner:
        """The embedder that was set up, for callers that need one."""
        if self.embed is None and self.runner is None:
            raise NoModel("no embedder is set up; vectors are hashed tokens")
        return self.embed or self.runner
