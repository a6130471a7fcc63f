"""Images that Markdown documents show: found in their text, resolved to files of the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kind
from .chunking import leaf_blocks, markdown_blocks, placed_blocks, references, without_front_matter
from .inline import inline

_SHOWN = re.compile(r"<img\b[^>]*>", re.I)
_ATTRIBUTE = re.compile(r"\b(src|alt)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)


def _tagged(html: str) -> Iterator[tuple[str, str]]:
    """(target, alternative text) of the image tags in HTML."""
    for tag in _SHOWN.findall(html):
        told = {name.lower(): a or b for name, a, b in _ATTRIBUTE.findall(tag)}
        yield told.get("src", ""), told.get("alt", "")


def images(text: str) -> list[tuple[str, str, str, int]]:
    """(target as written, alternative text, heading path, page) of the images of a Markdown text, in order; none in code or in headings at its top level."""
    blocks = list(markdown_blocks(without_front_matter(text)))
    defined = references(blocks)
    out = []
    for heading, page, block in placed_blocks(text, blocks, defined):
        if block.kind == "heading" or not ("![" in block.text or "<" in block.text):
            continue
        for leaf in leaf_blocks(block):
            if leaf.kind == "html":
                found = list(_tagged(leaf.text))
            elif leaf.kind in ("heading", "paragraph"):
                read = inline(leaf.text, defined)
                placed = [(at, to, alt) for to, alt, at in read.images] + [(at, *image) for tag, at in read.tags for image in _tagged(tag)]
                found = [(to, alt) for _, to, alt in sorted(placed, key=lambda x: x[0])]
            else:
                found = []
            out.extend((to, alt.strip(), heading, page) for to, alt in found if to)
    return out


def image_links(docs: DataFrame) -> DataFrame:
    """document_id, path, ord, target, alt, heading_path, page of the images in Markdown documents (document_id, path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, p, i, *image) for d, p, t in zip(batch["document_id"], batch["path"], batch["text"], strict=True) for i, image in enumerate(images(t or ""))]
            yield pd.DataFrame(rows, columns=["document_id", "path", "ord", "target", "alt", "heading_path", "page"])

    return docs.select("document_id", "path", "text").mapInPandas(run, "document_id long, path string, ord int, target string, alt string, heading_path string, page int")


def clean_path(path: Column) -> Column:
    """The path without empty and "." steps; a ".." takes the step before it away, where there is one."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")
    up = lambda done, s: (s == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
    walked = F.aggregate(steps, none, lambda done, s: F.when(up(done, s), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    return F.array_join(walked, "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """document_id, ord, child_path, alt, heading_path, page, warning: `links` as files of the corpus (`files`: path).

    Targets with a scheme are left out. Others lose a query and fragment and are decoded; a leading slash is the root, all
    else is relative to the document. A file that isn't there is looked for in the folder assets beside the document.
    Of links to one file, a document keeps the first. warning is outside, missing or kind where child_path is null.
    """
    written = F.regexp_replace(F.trim("target"), "^<|>$", "")
    bare = F.regexp_extract(written, r"^[^?#]*", 0)
    plain = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    local = links.where((written != "") & ~written.rlike(r"^[A-Za-z][A-Za-z0-9+.-]+:")).withColumn("_to", plain)
    absolute = F.col("_to").startswith("/")
    placed = local.withColumns({
        "_own": clean_path(F.when(absolute, F.col("_to")).otherwise(F.concat(folder(F.col("path")), "_to"))),
        "_beside": clean_path(F.concat(folder(F.col("path")), F.lit("assets/"), F.regexp_extract("_to", r"([^/]*)/*$", 1))),
    })
    here = files.select(F.col("path").alias("_file")).distinct()
    met = placed.join(here.withColumnRenamed("_file", "_a"), F.col("_own") == F.col("_a"), "left").join(here.withColumnRenamed("_file", "_b"), F.col("_beside") == F.col("_b"), "left")
    out = F.col("_own").rlike(r"^\.\.(/|$)")
    found = F.coalesce("_a", "_b")
    warning = F.when(out, "outside").when(found.isNull(), "missing").when(~kind(found, ["image"]).eqNullSafe("image"), "kind")
    told = met.withColumn("warning", warning).withColumn("child_path", F.when(F.col("warning").isNull(), found))
    same = Window.partitionBy("document_id", F.coalesce("child_path", F.concat(F.lit("?"), F.col("ord").cast("string")))).orderBy("ord")
    return told.withColumn("_n", F.row_number().over(same)).where("_n = 1").select("document_id", "ord", "child_path", "alt", "heading_path", "page", "warning")
