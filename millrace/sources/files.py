"""Folders of files as DataFrames: listing, kinds, filters, front matter, code text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ignore_glob

# Kinds by extension, generated files, and the largest code file that is read.
KINDS = {
    "markdown": "md markdown".split(),
    "pdf": ["pdf"],
    "image": "png jpg jpeg webp".split(),
    "code": "go py js ts tsx jsx java c h cc cpp hpp cs rb rs php sh sql html css json yaml yml toml xml".split(),
    "audio": "mp3 wav m4a flac ogg".split(),
    "video": "mp4 mov mkv webm".split(),
}
#: Kinds that settings call otherwise.
CONFIGURED = {"md": "markdown"}
GENERATED = "package-lock.json yarn.lock pnpm-lock.yaml go.sum Cargo.lock poetry.lock".split()
LARGEST_CODE = 1 << 20


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, mtime of the files below a folder; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).dropDuplicates(["path"])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(base_name(path), r"\.[^.]*$", ""))


def kind(path: Column, enabled: list[str] | None = None) -> Column:
    """Kind by extension; null for others and for kinds that are not enabled."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    out = F.lit(None).cast("string")
    for name, extensions in KINDS.items():
        if enabled is None or name in enabled:
            out = F.when(ext.isin(extensions), name).otherwise(out)
    return out


def ignored(path: Column, globs: list[str]) -> Column:
    """Hidden files and folders, and those that a glob matches; of a folder, with or without a slash at its end."""
    out = path.rlike(r"(?:^|/)\.[^/]")
    for glob in globs:
        own = ignore_glob(glob)
        out = out | path.rlike(own) | F.exists(_parents(path), lambda p: p.rlike(own) | F.concat(p, F.lit("/")).rlike(own))
    return out


def _parents(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(parts)), 2, F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def generated(path: Column, size: Column) -> Column:
    return (size > LARGEST_CODE) | path.rlike(r"\.(?:min\.js|min\.css|map)$") | base_name(path).isin(GENERATED)


def front_matter_source(text: Column) -> Column:
    """The value of ``source:`` in the front matter, null if there is none: first 200 lines, up to its closing line."""
    lines = F.split(F.regexp_replace(text, "^﻿", ""), "\r?\n")
    body = F.slice(lines, 2, 199)
    ends = F.filter(F.transform(body, lambda x, i: F.when(F.trim(x).isin("---", "..."), i)), lambda i: i.isNotNull())
    inside = F.when(F.size(ends) > 0, F.slice(body, F.lit(1), F.get(ends, F.lit(0)))).otherwise(body)
    found = F.filter(inside, lambda x: x.rlike(r"^source:"))
    value = F.trim(F.regexp_replace(F.get(found, F.lit(0)), r"^source:", ""))
    return F.when((F.get(lines, F.lit(0)) == "---") & (F.size(found) > 0), F.btrim(value, F.lit("\"'")))


def code_problem(content: Column) -> Column:
    """Why a code file (its text, or its bytes) is not read, or null: NUL bytes or no UTF-8, lines of 301 bytes or more in the mean,
    nothing but white space. The line break at its end starts no line."""
    text = content.cast("string")
    n_lines = F.size(F.split(text, "\n")) - text.endswith("\n").cast("int")
    return (
        F.when((F.instr(text, "\x00") > 0) | ~F.is_valid_utf8(text), "binary")
        .when((n_lines > 0) & (F.floor(F.octet_length(text) / n_lines) > 300), "minified")
        .when(~text.rlike(r"(?U)\S"), "empty")
    )


def listing_of(spark: SparkSession, root: str, folders: list[str]) -> tuple[DataFrame, list[str]]:
    """path (below root), size, mtime of the files of all folders, each once, and the folders that aren't there.

    `folders` are the configured ones, a handful; "." is the root.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda f: root if f == "." else f"{root}/{f}"
    there = {f: jvm.org.apache.hadoop.fs.Path(place(f)) for f in folders}
    found = [f for f, p in there.items() if p.getFileSystem(conf).exists(p)]
    rows = spark.createDataFrame([], "path string, size long, mtime timestamp")
    for f in found:
        rows = rows.unionByName(listing(spark, place(f)))
    return rows.withColumn("path", below(spark, root)).dropDuplicates(["path"]), [f for f in folders if f not in found]


def below(spark: SparkSession, root: str, path: str = "path") -> Column:
    """The place below `root` of a path that a listing gives."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    bare = F.regexp_replace(path, r"^[a-z0-9]+:(?://[^/]*)?/*", "/")
    return F.regexp_replace(bare, "^" + re.escape(base), "")


def in_scope(files: DataFrame, folders: list[str], ignore: list[str], enabled: list[str] | None = None) -> DataFrame:
    """path, size, mtime, kind of the files (path, size, mtime) that a scan takes: of an enabled kind, not generated, and not ignored
    within the folder that was asked for, which itself no rule hides. A file of several folders counts if one of them has it."""
    asked = F.lit(False)
    for folder in folders:
        own = F.col("path") if folder == "." else F.when(F.col("path") == folder, base_name(F.col("path"))).otherwise(F.substring("path", len(folder) + 2, 1 << 20))
        asked = asked | (folder_covers(F.lit(folder), F.col("path")) & ~ignored(own, ignore))
    told = files.select("path", "size", "mtime", kind(F.col("path"), enabled).alias("kind")).where(F.col("kind").isNotNull() & asked)
    return told.where((F.col("kind") != "code") | ~generated(F.col("path"), F.col("size")))


def image_units(files: DataFrame) -> DataFrame:
    """path, modality, text of image files: one unit each, named for keyword search."""
    return files.where("kind = 'image'").select("path", F.lit("image").alias("modality"), file_words(F.col("path")).alias("text"))


def file_words(path: Column) -> Column:
    """A file's name as words: without extension, dashes and underscores as blanks."""
    return F.translate(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), "-_", "  ")


def folder_covers(folder: Column, path: Column) -> Column:
    return (folder == ".") | (path == folder) | path.startswith(F.concat(folder, F.lit("/")))
