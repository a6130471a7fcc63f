r"""Merkle manifest of a table of documents, with checkpoint-and-recompute proofs.

Each language is a tree whose leaves are its documents by doc_id; eight nodes make one of the level above. The languages' top nodes are
the leaves of one more tree, whose top is the root. Only every STRIDE-th level is stored. A proof is taken from the top down: each
aligned subtree between two stored levels gathers its stored descendants (64 at most), makes the nodes between anew, hands every descendant
its siblings on the levels it spans, and forgets them. What reaches a task is one subtree and the siblings above it, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import LOWER, UPPER
from .shared import numbered, stored

FANOUT, STRIDE = 8, 2
WIDTH = FANOUT**STRIDE
STEP = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for a null, else its bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text))


def _over(level: Column) -> Column:
    """Digests of the level above: one per FANOUT of `level`."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), ""), 256))


def _subtrees(nodes: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """One row per aligned subtree of a stored level: its place, the stored nodes by place, and levels _l0 (these) to _l{STRIDE}, made anew.

    A tree of one node is at its top; any other, however few nodes its last run has, is hashed once more.
    """
    of = nodes.groupBy(key, F.floor(F.col("idx") / WIDTH).alias("_up"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "digest", *payload))).alias("_nodes"))
    of = of.withColumn("_l0", F.transform("_nodes", lambda x: x["digest"]))
    for j in range(STRIDE):
        below = F.col(f"_l{j}")
        of = of.withColumn(f"_l{j + 1}", F.when((F.col("n") <= WIDTH) & (F.size(below) == 1), below).otherwise(_over(below)))
    return of


def _steps(place: Column) -> Column:
    """Siblings of the node at `place` of its subtree, left and right of it, on each level it spans."""
    steps = []
    for j in range(STRIDE):
        level, at = F.col(f"_l{j}"), F.floor(place / FANOUT**j).cast("int")
        run = F.slice(level, F.floor(at / FANOUT).cast("int") * FANOUT + 1, FANOUT)
        mine = at % FANOUT
        left, right = F.slice(run, F.lit(1), mine), F.slice(run, mine + 2, FANOUT)
        step = F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))
        steps.append(F.when(~((F.col("n") <= WIDTH) & (F.size(level) == 1)), step))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


@dataclass
class Tree:
    """Stored levels of the trees of all values of `key`, lowest first, and their tops: key, digest."""

    key: str
    levels: list[DataFrame]
    tops: DataFrame


def build(leaves: DataFrame, key: str, name: str) -> Tree:
    """Trees over `leaves`: key, idx, n, digest and other columns, which only the lowest level keeps."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = _subtrees(levels[-1], key, []).select(key, F.col("_up").alias("idx"), F.ceil(F.col("n") / WIDTH).alias("n"), F.element_at(F.col(f"_l{STRIDE}"), 1).alias("digest"))
        levels.append(stored(up, name))
        most = -(-most // WIDTH)
    return Tree(key, levels, levels[-1].select(key, "digest"))


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """The leaves' columns and those of `above`, with path: the steps from a leaf up.

    `above` has one row per key, with path and what else its leaves should carry.
    """
    key, carried = tree.key, [c for c in above.columns if c not in (tree.key, "path")]
    paths = above.withColumn("idx", F.lit(0).cast("long"))
    for k in range(len(tree.levels) - 2, -1, -1):
        payload = [c for c in tree.levels[k].columns if c not in (key, "idx", "n", "digest")]
        over = paths.select(F.col(key).alias("_key"), F.col("idx").alias("_place"), F.col("path").alias("_above"), *carried)
        joined = _subtrees(tree.levels[k], key, payload).join(over, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_up") == F.col("_place")))
        each = joined.select("*", F.posexplode("_nodes").alias("_pos", "_node"))
        paths = each.select(key, F.col("_node.idx").alias("idx"), F.col("_node.digest").alias("digest"), *(F.col(f"_node.{c}").alias(c) for c in payload), F.concat(_steps(F.col("_pos")), F.col("_above")).alias("path"), *carried)
    if len(tree.levels) == 1:  # no tree has more than one leaf
        paths = tree.levels[0].join(paths.select(F.col(key).alias("_key"), "path", *carried), F.col(key).eqNullSafe(F.col("_key"))).drop("_key", "n")
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["l"], d, s["r"]), 256))


@dataclass
class Manifest:
    """Trees of the languages and, over their tops, of the whole."""

    languages: Tree
    whole: Tree


def manifest(docs: DataFrame, extra: dict[str, Column] | None = None) -> Manifest:
    """The manifest of `docs`: doc_id, source, lang, n_chars, text; `extra` columns ride along with the leaves.

    A null is a field of its own, an empty text is not one. Documents with a null doc_id come first; rows that share a doc_id follow by
    digest, and rows alike in all five fields are leaves of their own. A null lang is a language, before all others. Other columns take no part.
    """
    rows = docs.select("lang", "doc_id", leaf_of(F.col("text")).alias("digest"), *(c.alias(name) for name, c in (extra or {}).items()))
    languages = build(numbered(rows, ["lang"], ["doc_id", "digest"], "leaves"), "lang", "nodes")
    tops = numbered(languages.tops, [], ["lang"], "tops").withColumn("all", F.lit(0))
    return Manifest(languages, build(tops, "all", "nodes"))


def all_proofs(made: Manifest) -> DataFrame:
    """Per document: its leaf's columns, digest, path, subroot and root."""
    start = made.whole.tops.select("all", F.col("digest").alias("root")).withColumn("path", F.array().cast(STEP))
    over = proofs(made.whole, start).select("lang", F.col("digest").alias("subroot"), "root", "path")
    return proofs(made.languages, over)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the CRC-32 of the decimal doc_id; a null doc_id is left alone."""
    return F.when(F.crc32(doc_id.cast("string")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def merkle_digest(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. An empty table gives no row."""
    found = all_proofs(manifest(docs, {"_seen": leaf_of(tampered(F.col("doc_id"), F.col("text")))}))
    folded = fold(F.col("_seen"), F.col("path"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Unsigned CRC-32 of a string of digits, a colon, a minus sign or a space, bit by bit, in DuckDB; {s} is the string.
CRC_SQL = """xor(4294967295, list_reduce(list_transform(string_split({s}, ''), lambda ch: ascii(ch)::BIGINT),
  lambda c, b: list_reduce([1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda x, k: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295::BIGINT))"""

_F = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_F.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: The same in DuckDB, level by level: nodes of all levels, siblings by ancestor, then the fold of the tampered leaf.
DIGEST_SQL = f"""
WITH RECURSIVE src AS (
  SELECT *, row_number() OVER () AS row, CASE WHEN {CRC_SQL.format(s="doc_id::VARCHAR")} % 3 = 0
    THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS seen FROM documents),
leaves AS (SELECT row, doc_id, lang, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="seen")} AS bad FROM src),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (
  SELECT lang, 0 AS lvl, idx, n, leaf AS d FROM placed
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY lang, lvl, idx // 8, n),
subs AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, idx, n, d FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 8, n),
steps AS (
  SELECT p.row, a.lvl, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
  FROM placed p JOIN low a ON a.lang IS NOT DISTINCT FROM p.lang AND a.n > 1 AND a.idx = p.idx // (8 ** a.lvl)::BIGINT
  JOIN low b ON b.lang IS NOT DISTINCT FROM a.lang AND b.lvl = a.lvl AND b.idx // 8 = a.idx // 8 GROUP BY p.row, a.lvl, a.idx
  UNION ALL
  SELECT p.row, 100 + a.lvl, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), ''),
         coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '')
  FROM placed p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang JOIN high a ON a.n > 1 AND a.idx = s.idx // (8 ** a.lvl)::BIGINT
  JOIN high b ON b.lvl = a.lvl AND b.idx // 8 = a.idx // 8 GROUP BY p.row, a.lvl, a.idx),
ordered AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY lvl) AS k FROM steps),
folded AS (
  SELECT row, 0 AS k, bad AS d FROM leaves
  UNION ALL SELECT f.row, o.k, sha256(o.l || f.d || o.r) FROM folded f JOIN ordered o ON o.row = f.row AND o.k = f.k + 1),
ends AS (SELECT row, max_by(d, k) AS d FROM folded GROUP BY row),
said AS (SELECT row, string_agg(l || r, '' ORDER BY k) AS s FROM ordered GROUP BY row)
SELECT p.doc_id, p.leaf, s.d AS subroot, h.d AS root, sha256(coalesce(said.s, '')) AS proof_sha256, e.d AS folded_root, e.d = h.d AS verified
FROM placed p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang JOIN high h ON h.n = 1 JOIN ends e ON e.row = p.row LEFT JOIN said ON said.row = p.row
"""
