"""The versions of a store: a numbered file each, of which a writer can only make the next one.

A version names the segments that make up the tables. To publish, a writer makes the file of the number after the one it
started from; the file system lets one writer make it, and any other gets Locked and has changed nothing. A version is
whole before its name is there, and never changes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

from .errors import Locked

FOLDER = "versions"


@dataclass(frozen=True)
class Segment:
    """Rows that one writer added: those of the documents it wrote, of chunks, links, postings and vectors, and what of older segments is void.

    `number` is that of its version; after a merge, of the newest one merged. `spaces` are those that its chunks have vectors of.
    """

    name: str
    number: int
    documents: int = 0
    chunks: int = 0
    links: int = 0
    dead: int = 0
    total: int = 0  # chunks with tokens, and tokens, that came less those that went
    tokens: int = 0
    terms: bool = False
    spaces: tuple[str, ...] = ()


@dataclass(frozen=True)
class Version:
    number: int = 0
    space: str = ""
    building: str = ""
    segments: tuple[Segment, ...] = field(default=())

    def text(self) -> str:
        return json.dumps(asdict(self))


def _parsed(text: str) -> Version:
    told = json.loads(text)
    segments = tuple(Segment(**{**s, "spaces": tuple(s["spaces"])}) for s in told.pop("segments"))
    return Version(**told, segments=segments)


def _place(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, root: str) -> list[int]:
    folder, system = _place(spark, f"{root}/{FOLDER}")
    if not system.exists(folder):
        return []
    return sorted(int(n) for n in (s.getPath().getName() for s in system.listStatus(folder)) if n.isdigit())


def read(spark: SparkSession, root: str, number: int) -> Version:
    place, system = _place(spark, f"{root}/{FOLDER}/{number:012d}")
    stream = system.open(place)
    try:
        return _parsed(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> Version:
    """The newest version; one without segments if there is none."""
    found = numbers(spark, root)
    return read(spark, root, found[-1]) if found else Version()


def publish(spark: SparkSession, root: str, base: Version, next_: Version) -> Version:
    """Make `next_` the version after `base`, or raise Locked if another writer was first.

    Written under a passing name, then named for good by a step that fails where the name is taken: a hard link on local disks, a rename
    without overwriting elsewhere, which HDFS does as one.
    """
    next_ = replace(next_, number=base.number + 1)
    target, system = _place(spark, f"{root}/{FOLDER}/{next_.number:012d}")
    passing, _ = _place(spark, f"{root}/{FOLDER}/.{uuid.uuid4().hex}")
    out = system.create(passing, False)
    out.write(bytearray(next_.text().encode()))
    out.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    try:
        if system.getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(target), local(passing))
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(passing, target, options)
    except Exception as e:
        if system.exists(target):
            raise Locked(f"another writer published version {next_.number} of {root}") from e
        raise
    finally:
        system.delete(passing, False)
    return next_


def folder_names(spark: SparkSession, path: str) -> list[str]:
    place, system = _place(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)
