"""Vector spaces of an index: which one is live, when to rebuild, and what a switch to a new one means for documents.

A rebuild makes vectors of the new space beside those of the live one, which searches read meanwhile; which is live is told by the published version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import OtherSpace

#: Room that a switch wants free, as a multiple of what it is thought to need.
ROOM = 1.5
#: Nullable columns that each version of the chunk table added.
ADDED: dict[int, dict[str, str]] = {2: {"source_path": "string"}, 3: {"start_ms": "bigint", "end_ms": "bigint"}, 4: {"bm25_len": "int"}}
VERSION = max(ADDED)


@dataclass(frozen=True)
class Rebuild:
    mode: str  # none, continue, cancelled, in_place or switch
    need_mb: int = 0


def rebuild(live: str, building: str, wanted: str, live_chunks: int, size: int = 0, dims: tuple[int, int] = (0, 0), free_mb: int = -1, force: bool = False) -> Rebuild:
    """What has to happen so that the space `wanted` gets live.

    `building` is the space under way, or empty; `size` the bytes of the live index, `dims` its vectors' length and the wanted
    one. An index without chunks is rebuilt in place. A switch that lacks room raises OSError unless forced; a negative
    `free_mb` is unknown and enough.
    """
    if not force:
        if wanted == live:
            return Rebuild("cancelled" if building else "none")
        if building == wanted:
            return Rebuild("continue")
    if live_chunks == 0:
        return Rebuild("in_place")
    old, new = dims
    need = (size * new // old if 0 < old < new else size) // 1_000_000 + 1
    if not force and 0 <= free_mb < ROOM * need:
        raise OSError(f"needs {need} MB, {free_mb} MB are free")
    return Rebuild("switch", need)


def migrated(chunks: DataFrame, version: int) -> DataFrame:
    """Chunks of an older version with the columns added since, all null; a newer version is refused."""
    if version > VERSION:
        raise ValueError(f"version {version} is newer than {VERSION}")
    missing = {name: F.lit(None).cast(kind) for v, added in ADDED.items() if v > version for name, kind in added.items() if name not in chunks.columns}
    return chunks.withColumns(missing) if missing else chunks


def complete(jobs: DataFrame) -> bool:
    """Nothing is left to embed: no job waits or runs. Failed ones are tried again after the switch."""
    return jobs.where(F.col("state").isin("queued", "running")).isEmpty()


def vectors_usable(live: str, asked: str, mode: str) -> bool:
    """Whether vectors of the space `asked` may search the live one; hybrid then goes on with keywords, vector mode fails."""
    if live in ("", asked):
        return True
    if mode == "vector":
        raise OtherSpace(f"the index holds vectors of {live}, not of {asked}")
    return False


def fitting(live: str, wanted: str, chunks: int) -> str:
    """The space that writes go to: the wanted one adopts an index without one, or without chunks. OtherSpace if they differ."""
    if live in ("", wanted) or chunks == 0:
        return wanted
    raise OtherSpace(f"the index holds vectors of {live}, not of {wanted}; rebuild it first")


def written(live: str, building: str) -> list[str]:
    """The spaces that a changed document's chunks are written to: the live one, and one under way, so that it misses nothing."""
    return [live] if building in ("", live) else [live, building]


def told_by(space: str) -> tuple[str, str, int]:
    """Model, revision and dimension that a space's name, model@revision:dim, tells."""
    rest, _, dim = space.rpartition(":")
    model, _, revision = rest.rpartition("@")
    if not (model and revision and dim.split("#")[0].isdigit()):
        raise ValueError(f"{space!r} names no space")
    return model, revision, int(dim.split("#")[0])


def cancelled(docs: DataFrame, chunks: DataFrame, dirty: DataFrame, live: Column) -> DataFrame:
    """Documents after a switch was given up: those that changed meanwhile or have no live chunk are pending, the rest done."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("_n"))
    moved = dirty.select("document_id").distinct().withColumn("_d", F.lit(True))
    met = docs.join(counts, "document_id", "left").join(moved, "document_id", "left").withColumn("chunk_count", F.coalesce("_n", F.lit(0)))
    redo = F.coalesce("_d", F.lit(False)) | (F.col("chunk_count") == 0)
    return met.withColumn("status", F.when(redo, "pending").otherwise("done")).withColumn("embed_id", F.when(redo, F.col("embed_id")).otherwise(live)).drop("_n", "_d")
