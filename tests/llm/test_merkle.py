"""The Merkle manifest: against plain Python, DuckDB, and tampered documents."""

import hashlib
import random
import zlib

import duckdb
import pytest

from millrace.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("*", "1 as idx", "2 as n", "'x' as digest", "'y' as path", "3 as _pid", "4 as _salt", "5 as root")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    tree = {}
    for r in rows:
        tree.setdefault(r[2], []).append(r)
    langs = sorted(tree, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        tree[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[x] = climb([leaf(*r) for r in tree[x]])
    top = climb([trees[x][-1][0] for x in langs])
    out = []
    for at, x in enumerate(langs):
        for i, r in enumerate(tree[x]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if bad and r[1] is not None else r[1]
            d, said = leaf(r[0], text, *r[2:]), ""
            for levels, place in ((trees[x], i), (top, at)):
                for level in levels[:-1]:
                    run = level[place // 8 * 8 : place // 8 * 8 + 8]
                    left, right = run[: place % 8], run[place % 8 + 1 :]
                    said += "".join(left + right)
                    d, place = H(*left, d, *right), place // 8
            out.append((r[0], leaf(*r), trees[x][-1][0], top[-1][0], H(said), d, d == top[-1][0]))
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted((tuple(r) for r in merkle.merkle_digest(spark.createDataFrame(rows, DOCS).selectExpr(*CLASHING)).collect()), key=repr)


ROWS = [(None, None, None, None, None), (None, "A", None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (1, "Ü é 文", "en", "", 3), (-5, "Minus", "de", "b", -2), (9, "Long " * 30000, "", "c", 1)]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 65, 520])
def test_manifest_matches_plain_python(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(400), rng.choice(["Text", "other TEXT", "x"]), "en" if n % 2 or rng.random() < 0.9 else f"l{rng.randrange(12)}", None, i) for i in range(n)]
    assert got(spark, rows) == brute(rows)
    if n in (0, 9, 520):
        assert got(spark, rows + ROWS) == brute(rows + ROWS)


def test_many_languages_and_deep_trees(spark):
    rows = [(i, f"Text {i}", f"l{i % 90}" if i < 180 else "en", "s", i) for i in range(4400)]
    assert got(spark, rows) == brute(rows)


def test_sql_on_awkward_rows(spark, tmp_path):
    rows = ROWS + [(i, f"Some TEXT {i % 5}", "fr", "s", i) for i in range(70)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    assert sorted(duck.sql(merkle.DIGEST_SQL).fetchall(), key=repr) == brute(rows)


def test_other_changes_are_found(spark):
    """A proof of one document doesn't serve another one, and no field can be changed."""
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(20)]
    made = merkle.all_proofs(merkle.manifest(spark.createDataFrame(rows, DOCS))).collect()
    for r in made:
        for changed in ((r["doc_id"] + 1, *rows[r["doc_id"]][1:]), (*rows[r["doc_id"]][:4], None)):
            d = leaf(*changed)
            for s in r["path"]:
                d = H(s["l"], d, s["r"])
            assert d != r["root"]
