"""Golden cases of the operators."""

import hashlib
import random
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import chunking as C
from millrace.operators import keyword as K
from millrace.operators import links as L
from millrace.operators import maintain as M
from millrace.operators import ranking as R
from millrace.operators import substring as SUB
from millrace.operators import merge
from millrace.plans import config, errors, spaces
from millrace.plans import index as I
from millrace.plans import queries as Q
from millrace.plans import search as SE
from millrace.plans.corpus import Corpus
from millrace.plans.search import SearchOptions, search
from millrace.sources import files as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    text = "The Transformer's multi-head attention (BLEU 28.4) is a model — 注意力"
    assert one(spark, T.tokens(F.lit(text))) == ["transformer", "multi", "head", "attention", "bleu", "28", "model", "注", "意", "力"]


def test_fit_and_codec(spark):
    assert one(spark, V.fit(F.array(*map(F.lit, [3.0, 4.0, 100.0])), 2)) == pytest.approx([0.6, 0.8])
    assert one(spark, V.fit(F.array(F.lit(1.0)), 2)) is None
    assert one(spark, V.fit(F.array(F.lit(0.0), F.lit(0.0)), 2)) is None
    assert V.decode(V.encode(np.array([1.5, -2]))).tolist() == [1.5, -2]
    with pytest.raises(ValueError):
        V.decode(b"abc")


@pytest.mark.parametrize(("ms", "windows"), [(0, None), (500, [(0, 500)]), (30000, [(0, 30000)]), (31000, [(0, 30000), (25000, 31000)]), (70000, [(0, 30000), (25000, 55000), (50000, 70000)])])
def test_media_windows(spark, ms, windows):
    got = one(spark, C.media_windows(F.lit(ms).cast("long")))
    assert (got and [tuple(w) for w in got]) == windows


@pytest.mark.parametrize(("ms", "shown"), [(0, "0:00"), (59999, "0:59"), (65000, "1:05"), (3725000, "1:02:05")])
def test_clock(spark, ms, shown):
    assert one(spark, T.clock(F.lit(ms).cast("long"))) == shown


@pytest.mark.parametrize(("path", "gone"), [("a/node_modules/x.md", True), ("node_modules/x.md", True), ("drafts/a.md", True), ("drafts/b/a.md", False), ("b/x.tmp.pdf", False), ("x.tmp.pdf", True), (".git/a.md", True), ("a/.x.md", True), ("a/b.md", False)])
def test_ignore(spark, path, gone):
    assert one(spark, S.ignored(F.lit(path), ["**/node_modules/**", "drafts/*.md", "*.tmp.pdf"])) is gone


@pytest.mark.parametrize(("path", "kind"), [("a.MD", "markdown"), ("b.markdown", "markdown"), ("c.PDF", "pdf"), ("d.JPeg", "image"), ("e.webp", "image"), ("x.txt", None)])
def test_kind(spark, path, kind):
    assert one(spark, S.kind(F.lit(path))) == kind
    assert one(spark, S.kind(F.lit(path), ["audio"])) is None


def test_front_matter(spark):
    assert one(spark, S.front_matter_source(F.lit("---\nsource: 'a b.pdf'\n---\nx"))) == "a b.pdf"
    assert one(spark, S.front_matter_source(F.lit("source: a.pdf"))) is None
    assert one(spark, S.front_matter_source(F.lit("---\n---\nsource: a.pdf"))) is None


def test_small_sections_join():
    sections = [("Guide", "Short.", 0), ("Guide > Setup", "Install it.", 0), ("Guide > Use", "word " * 300, 0), ("Other", "End.", 1)]
    got = C.split_sections(sections, 320, 30)
    assert got[0][1] == "Short.\n\n## Setup\nInstall it." or "## Setup\nInstall it." in got[0][1]
    assert got[-1][2] == 1


def test_packing_keeps_all_words():
    text = " ".join(f"w{i}." for i in range(900))
    parts = C.pack(text, 100, 10)
    assert all(C.estimate(p) <= 110 for p in parts)
    assert {w for p in parts for w in p.split()} == set(text.split())


def test_markdown_sections():
    text = "---\na: b\n---\n# A\none\n\n## B\n```\n# no heading\n```\n<!-- page 3 -->\ntwo\n\nTitle\n=====\nthree"
    assert C.markdown_sections(text) == [("A", "one", 0), ("A > B", "```\n# no heading\n```", 0), ("A > B", "two", 3), ("Title", "three", 3)]


def test_code_chunks_cover_all_lines():
    text = "\n".join("" if i % 9 == 0 else f"line {i} of code" for i in range(1, 200))
    chunks = C.code_chunks(text, "a.py", 60, 10)
    assert {n for _, _, a, b in chunks for n in range(a, b + 1)} == set(range(1, 200))


def moments(spark, rows):
    """(doc, start, end, sim, kw, modality) in order of rank."""
    hits = spark.createDataFrame([(1, i + 1, d, s, e, x, k, m, "") for i, (d, s, e, x, k, m) in enumerate(rows)], "query_id long, rank int, doc long, start long, end long, sim double, kw boolean, modality string, heading string")
    return [tuple(r)[1:] for r in merge.merge_moments(hits).orderBy("rank").collect()]


def test_merge_moments(spark):
    got = moments(spark, [(1, 0, 30000, 0.5, False, "video"), (2, 0, 30000, 0.1, False, "video"), (1, 25000, 55000, 0.6, True, "audio"), (3, 0, 0, 0.2, False, "text"), (1, 50000, 80000, 0.3, False, "video")])
    assert got == [(1, 1, 0, 55000, 0.6, True, "audio+video", "0:00-0:55"), (2, 2, 0, 30000, 0.1, False, "video", ""), (3, 3, 0, 0, 0.2, False, "text", ""), (4, 1, 50000, 80000, 0.3, False, "video", "")]
    # the first result that fits takes a hit in, even if a later one overlaps more; widened ranges count
    assert [h[2:4] for h in moments(spark, [(1, 0, 20000, 0.0, False, "a"), (1, 30000, 50000, 0.0, False, "a"), (1, 15000, 40000, 0.0, False, "a"), (1, 35000, 60000, 0.0, False, "a")])] == [(0, 60000), (30000, 50000)]


def pairs(spark, rows):
    """(rank of the result, page, path, paired_path, text, modality) for hits (doc, kind, page, text); documents 1 and 2 are a pair."""
    named = {1: "a.md", 2: "a.pdf", 3: "b.md"}
    hits = spark.createDataFrame([(7, i + 1, d, {1: 2, 2: 1}.get(d, 0), d == 1 and k == "image", k, p, named[d], 0.1 * i, i == 1, "pdf_page" if k == "pdf" else "text", "h", t) for i, (d, k, p, t) in enumerate(rows)], "query_id long, rank int, doc long, pair long, linked boolean, kind string, page int, path string, sim double, kw boolean, modality string, heading string, text string")
    return [(r["rank"], r["page"], r["path"], r["paired_path"], r["text"], r["modality"]) for r in merge.merge_pairs(hits).orderBy("rank").collect()]


def test_merge_pairs(spark):
    md, pdf = "markdown", "pdf"
    assert pairs(spark, [(1, md, 0, "words"), (2, pdf, 1, "scan")]) == [(1, 1, "a.pdf", "a.md", "words", "text")]
    assert len(pairs(spark, [(1, md, 1, "x"), (1, md, 1, "y"), (3, md, 1, "z")])) == 3
    assert len(pairs(spark, [(1, "image", 0, "x"), (2, pdf, 1, "y")])) == 2  # a linked image goes by itself
    # a page's hit of the same document is no host, so that it goes on to the text without pages
    assert [r[1:4] for r in pairs(spark, [(2, pdf, 1, "a"), (1, md, 0, "b"), (1, md, 0, "c"), (2, pdf, 1, "d")])] == [(1, "a.pdf", "a.md"), (1, "a.pdf", "a.md")]
    # of several hits of a page the latest takes the other side in
    assert [r[4] for r in pairs(spark, [(2, pdf, 1, "first"), (2, pdf, 1, "second"), (1, md, 1, "said")])] == ["first", "said"]
    # an empty transcription leaves the PDF's words
    assert pairs(spark, [(2, pdf, 1, "scan"), (1, md, 1, "")]) == [(1, 1, "a.pdf", "a.md", "scan", "pdf_page")]
    # a result that has both sides takes more of the later document's hits on its page
    assert pairs(spark, [(1, md, 2, "one"), (2, pdf, 2, "two"), (2, pdf, 2, "three")]) == [(1, 2, "a.pdf", "a.pdf", "three", "pdf_page")]


@pytest.mark.parametrize(("hits", "setting", "kept"), [([(0.8, False), (0.72, False)], "auto", [3, 2]), ([(0.8, False), (0.66, False), (0.66, True)], "auto", [3, 3]), ([(0.5, False)] * 5, "auto", [1, 1, 1]), ([(0.5, False)] * 5, "all", [1, 1, 1]), ([(0.7, False), (0.5, False)], "high", []), ([(0.7, True), (0.5, False)], "high", [3]), ([(0.0, False)] * 4, "auto", [0] * 4)])
def test_confidence(spark, hits, setting, kept):
    rows = spark.createDataFrame([(1, i, s, k, i + 1) for i, (s, k) in enumerate(hits)], "query_id long, chunk_id long, sim double, kw boolean, rank int")
    assert [r["level"] for r in R.by_confidence(rows, setting, 0.75, 0.65).orderBy("rank").collect()] == kept


def test_search_modes(spark):
    docs = K.analyzed(spark.createDataFrame([(1, "attention of heads"), (2, "bread and yeast"), (3, None)], "chunk_id long, text string")).withColumn("vector", V.embed_tokens(F.col("tokens"), 32))
    ask = spark.createDataFrame([(7, "attention heads")], "query_id long, text string").withColumn("vector", V.embed_tokens(T.tokens(F.col("text")), 32))
    for mode in ("hybrid", "vector", "keyword"):
        assert search(ask, docs, SearchOptions(k=1, mode=mode)).first()["chunk_id"] == 1
    with pytest.raises(ValueError, match="unknown mode"):
        search(ask, docs, SearchOptions(mode="x"))


def test_pairing_precedence(spark):
    texts = spark.createDataFrame([("n/a.md", None, None), ("n/b.md", "p/a.pdf", None), ("n/c.md", "p/gone.pdf", None)], "path string, source string, mirror string")
    pdfs = spark.createDataFrame([("p/a.pdf",), ("p/c.pdf",)], "path string")
    assert [tuple(r) for r in M.pairs(texts, pdfs).collect()] == [("n/b.md", "p/a.pdf", "source")]


def test_vector_search_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(99, None), (98, [0.0, 0.0, 0.0])], "row_id long, vector array<float>")
    asked = rows.where("row_id < 9").select(F.col("row_id").alias("query_id"), "vector")
    whole = sorted(map(tuple, V.search(asked, rows, 4).collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    monkeypatch.setattr(V, "ROW_BLOCK", 7)
    assert sorted(map(tuple, V.search(asked, rows, 4).collect())) == whole and len(whole) == 36
    data = {r["row_id"]: np.array(r["vector"], float) for r in rows.where("row_id < 90").collect()}
    cosine = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    for q in range(9):
        best = sorted(((-cosine(data[q], v), i) for i, v in data.items()))[:4]
        assert [(r[1], r[3]) for r in whole if r[0] == q] == sorted((i, n + 1) for n, (_, i) in enumerate(best))
    assert V.search(asked.where("false"), rows, 4).count() == 0 == V.search(asked, rows.where("false"), 4).count()


def test_vectors_of_other_lengths_are_refused(spark):
    ragged = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0])], "row_id long, vector array<float>")
    four, two = (spark.createDataFrame([(1, v)], "query_id long, vector array<float>") for v in ([1.0, 0.0, 0.0, 0.0], [1.0, 0.0]))
    for asked, rows in ((four, ragged), (two, ragged.where("row_id = 3")), (ragged.withColumnRenamed("row_id", "query_id"), four.withColumnRenamed("query_id", "row_id"))):
        with pytest.raises(Exception, match="length"):
            V.search(asked, rows, 2).collect()
    with pytest.raises(Exception, match="length [35] instead of 4"):
        ragged.select(V.of_length(F.col("vector"), 4)).collect()


def test_postings_after_any_changes_are_those_made_anew(spark, tmp_path):
    texts = {i: " ".join(f"w{(i * j) % 11}" for j in range(1, i % 5 + 2)) for i in range(20)} | {20: "", 21: "the"}
    chunks = lambda held: K.analyzed(spark.createDataFrame(list(held.items()), "chunk_id long, text string"))
    K.store(K.on_the_way(chunks(texts)), str(tmp_path / "k"))
    found = K.stored(spark, str(tmp_path / "k"))
    for gone, came in (([3, 4, 20], {3: "w1 new words", 30: "w2"}), ([0, 1, 2, 30], {}), ([], {40: "w3 w3"})):
        texts = {i: t for i, t in texts.items() if i not in gone} | came
        found = found.replaced(spark.createDataFrame([(g,) for g in gone], "chunk_id long"), chunks(came))
        anew = K.on_the_way(chunks(texts))
        for a, b in ((found.post.select("term", "chunk_id", "tf", "bm25_len"), anew.post.select("term", "chunk_id", "tf", "bm25_len")), (found.terms.select("term", "df"), anew.terms), (found.stats(), anew.stats())):
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    ask = spark.createDataFrame([(1, "w1 w2 w3 absent")], "query_id long, text string")
    assert K.keyword_hits(ask, found, 5).collect() == K.keyword_hits(ask, anew, 5).collect()


@pytest.mark.parametrize("width", [1, 4, 64])
def test_bounds_lose_no_hit(spark, tmp_path, width):
    rng = random.Random(width)
    texts = [(i * 3, " ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randrange(30)))) for i in range(400)]
    K.store(K.on_the_way(K.analyzed(spark.createDataFrame(texts, "chunk_id long, text string")), width), str(tmp_path / "k"))
    found = K.stored(spark, str(tmp_path / "k"))
    ask = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(60)}" for _ in range(1 + q % 4))) for q in range(30)] + [(90, "absent"), (91, "")], "query_id long, text string")
    some = spark.createDataFrame([(i * 6,) for i in range(60)], "chunk_id long")
    for pool, allowed in ((5, None), (5, some), (500, None)):
        runs = [sorted(map(tuple, K.keyword_hits(ask, found, pool, allowed, pruned).collect())) for pruned in (False, True)]
        assert runs[0] == runs[1] and runs[0]
    shares = K.postings_read(ask, found, 5).agg(F.sum("read") / F.sum("postings")).first()[0]
    assert shares < (0.9 if width < 64 else 1.01)


def test_index_that_is_not_there(spark, tmp_path):
    with pytest.raises(errors.NotBuilt):
        I.opened(spark, str(tmp_path / "none"))


def test_code_overlap_counts_joined_lines():
    lines = "\n".join(["x" * 40] * 60) + "\n"
    assert [(a, b) for _, _, a, b in C.code_chunks(lines, "a.py")] == [(1, 23), (21, 43), (41, 60)]
    assert C.code_chunks("\n\n", "a.py") == [] and [c[1] for c in C.code_chunks("a\n\n", "a.py")] == ["a\n"]


@pytest.mark.parametrize(("title", "words"), [("A `b*c` **d** _e_", "A b*c d e"), ("[x *y*](u) ![alt](v)", "x y alt"), ("snake_case 2 * 3 \\*", "snake_case 2 * 3 *"), ("<b>t</b> <http://a>", "t http://a"), ("", "")])
def test_inline_text(title, words):
    shown = C.inline_text(title)
    assert shown.replace("  ", " ") == words.replace(" 2 * 3", " 2  3").replace("  ", " ") or shown == words


def test_fences_end_with_their_own_kind():
    assert C.markdown_sections("````\n```\n# no\n~~~\n````\n# yes\nx") == [("", "```\n```\n# no\n~~~\n```", 0), ("yes", "x", 0)]


@pytest.mark.parametrize(("content", "problem"), [(b"a\n", None), (b"a\x00", "binary"), (b"\xff\xfe", "binary"), (b"\n \n\n", "empty"), (b"x" * 300 + b"\n", "minified"), (b"x" * 299 + b"\n", None), (b"x" * 300, None), (b"x" * 301, "minified")])
def test_code_problem(spark, content, problem):
    assert spark.createDataFrame([(bytearray(content),)], "c binary").select(S.code_problem(F.col("c")).alias("x")).first()["x"] == problem


def test_debounce():
    from millrace.streaming.watch import Debounce

    told = {"v": 1}

    def settings():
        if told["v"] == "broken":
            raise ValueError("cannot read")
        return told["v"]

    run = Debounce(settings, lambda v: ["bad"] if v == "bad" else [])
    assert [run.due(m, t) for m, t in (("a", 0), ("b", 1), ("c", 2), ("c", 3), ("c", 4), ("c", 5), ("d", 6), ("d", 8.5), ("d", 700))] == [True, False, False, False, True, False, False, True, True]
    for told["v"] in ("bad", "broken"):
        run.due("d", 701)
        assert run.settings == 1 and run.faults
    told["v"] = 2
    run.due("d", 702)
    assert run.settings == 2 and not run.faults


def test_spaces_that_writes_go_to():
    assert spaces.fitting("", "b", 0) == spaces.fitting("a", "b", 0) == spaces.fitting("b", "b", 9) == "b"
    with pytest.raises(errors.OtherSpace):
        spaces.fitting("a", "b", 1)
    assert spaces.written("a", "") == spaces.written("a", "a") == ["a"] and spaces.written("a", "b") == ["a", "b"]
    assert spaces.told_by("m/x@abc:64#ff") == ("m/x", "abc", 64)
    with pytest.raises(ValueError):
        spaces.told_by("m")


def test_search_of_pairs_and_moments(spark):
    docs = spark.createDataFrame([(1, "a.md", "markdown", 2), (2, "a.pdf", "pdf", 1), (3, "v.mp4", "video", None), (4, "b.md", "markdown", None)], "document_id long, path string, kind string, pair_id long")
    rows = [(10, 1, "text", "alpha beta words", 0, None, None, None), (20, 2, "pdf_page", "alpha beta", 1, None, None, None), (30, 3, "video", "alpha clip", 0, None, 0, 30000), (31, 3, "audio", "alpha clip", 0, None, 25000, 55000), (40, 4, "image", "alpha picture", 0, "i.png", None, None)]
    chunks = K.analyzed(spark.createDataFrame([(c, d, m, t, "", p, s, a, b) for c, d, m, t, p, s, a, b in rows], "chunk_id long, document_id long, modality string, text string, heading_path string, page int, source_path string, start_ms long, end_ms long"))
    own = chunks.withColumn("vector", V.embed_tokens(F.col("tokens"), 32))
    ask = spark.createDataFrame([(7, "alpha beta"), (8, " ")], "query_id long, text string").withColumn("vector", V.embed_tokens(T.tokens(F.col("text")), 32))
    got, notices = SE.search_documents(ask, own, docs, SearchOptions())
    shown = {r["path"]: r for r in got.collect()}
    assert set(shown) == {"a.pdf", "v.mp4", "i.png"} and shown["a.pdf"]["paired_path"] == "a.md" and shown["i.png"]["parent_path"] == "b.md"
    assert (shown["v.mp4"]["modality"], shown["v.mp4"]["heading"], shown["v.mp4"]["end"]) == ("audio+video", "0:00-0:55", 55000)
    assert [tuple(r) for r in notices.collect()] == [(8, "empty query")]
    few, _ = SE.search_documents(ask, own, docs, SearchOptions(modalities=("image",), mode="vector"))
    assert [r["path"] for r in few.collect()] == ["i.png"]
    grouped, _ = SE.search_documents(ask, own, docs, SearchOptions(group="doc", path_glob="*.md"))
    assert {r["path"]: r["chunks"] for r in grouped.collect()} == {"a.md": 1}
    weak, told = SE.search_documents(ask, own, docs, SearchOptions(mode="vector", strong=2.0, fair=1.5, confidence="high"))
    assert weak.count() == 0 and [r["notice"] for r in told.orderBy("query_id").collect()] == [R.NOTHING_SURE, "empty query"]
    with pytest.raises(errors.OtherSpace):
        SE.search_documents(ask, own, docs, SearchOptions(mode="vector"), spaces=("a", "b"))
    assert SearchOptions(k=-3).settled().k == 10 and SearchOptions().settled().max_chars == 2000


@pytest.mark.parametrize("n", [0, 1, 97])
def test_numbers_follow_the_order_over_all_parts(spark, tmp_path, n):
    rows = spark.createDataFrame([(f"p{(i * 37) % 101:03}",) for i in range(n)], "path string").repartition(3)
    rows.repartitionByRange(5, "path").withColumn("_part", F.spark_partition_id()).write.parquet(str(tmp_path / "parts"))
    parts = spark.read.parquet(str(tmp_path / "parts"))
    found = M.numbered(parts, "path", 10, "document_id").collect()
    assert n < 50 or parts.select("_part").distinct().count() > 1
    assert sorted((r["document_id"], r["path"]) for r in found) == list(enumerate(sorted(r["path"] for r in rows.collect()), 11))


def test_stored_postings_use_all_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2000")
        assert all(K.spread(spark, K.parts_for(n)) * K.parts_for(n) >= 2000 for n in (1, 10**6, 10**13))
        assert K.parts_for(0) == 1 and K.parts_for(10**6) < K.parts_for(10**9) < K.parts_for(10**13) < 1 << 17
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_corpus_from_scan_to_search(spark, tmp_path):
    root, store = tmp_path / "docs", tmp_path / "store"
    (root / "a b").mkdir(parents=True)
    (root / "drafts").mkdir()
    (root / "a b" / "one.md").write_text("# Bread\nyeast and flour make bread")
    (root / "two.md").write_text("# Trains\nrails and engines")
    (root / "tool.py").write_text("def oven():\n    return 'flour'\n")
    (root / "min.js").write_text("x" * 900)
    (root / "drafts" / "no.md").write_text("flour")
    (root / "cat-photo.png").write_bytes(b"\x89PNG")
    (root / "notes.txt").write_text("flour")
    settings = config.load("[scan]\nfolders = ['.', 'a b', 'gone']\nignore = ['drafts/**']")
    corpus = Corpus(spark, str(root), str(store), settings)
    with pytest.raises(errors.NotBuilt):
        corpus.status()
    report = corpus.scan()
    assert (report["new"], report["indexed"], report["failed"], report["missing_folders"]) == (5, 4, 1, ["gone"])
    assert [r["path"] for r in corpus.documents().collect()] == ["a b/one.md", "cat-photo.png", "min.js", "tool.py", "two.md"]
    assert [r["error"] for r in corpus.documents("failed").collect()] == ["minified"]
    rows, _ = corpus.search("bread flour", SearchOptions(k=2))
    best = rows.orderBy("rank").collect()
    assert best[0]["path"] == "a b/one.md" and "Bread" in best[0]["heading"] and len(best) == 2
    with pytest.raises(errors.EmptyQuery):
        corpus.search("  ")
    ids = {r["path"]: r["document_id"] for r in corpus.documents().collect()}
    (root / "two.md").rename(root / "rails.md")
    (root / "tool.py").unlink()
    (root / "a b" / "one.md").write_text("# Bread\nrye and salt only")
    report = corpus.scan()
    assert (report["moved"], report["changed"], report["deleted"], report["new"]) == (1, 1, 1, 0)
    after = {r["path"]: r["document_id"] for r in corpus.documents().collect()}
    assert after["rails.md"] == ids["two.md"] and "tool.py" not in after
    asked = spark.createDataFrame([(1, "rye"), (2, "flour"), (3, "engines"), (4, "photo")], "query_id long, text string")
    found = corpus.search(asked, SearchOptions(mode="keyword"))[0].select("query_id", "path").collect()
    assert sorted(map(tuple, found)) == [(1, "a b/one.md"), (3, "rails.md"), (4, "cat-photo.png")]
    again = corpus.scan()
    assert (again["unchanged"], again["indexed"]) == (4, 0)
    told = corpus.status()
    assert told["documents"] == 4 and told["folders"] == {".": 4, "a b": 1, "gone": 0} and told["queued"] == 0
    corpus.settings = config.load("[embed]\ndim = 32")
    _, notices = corpus.search("rye", SearchOptions())
    assert "keywords only" in notices.first()["notice"]
    with pytest.raises(errors.OtherSpace):
        corpus.scan()
    assert corpus.rebuild().mode == "switch" and corpus.rebuild().mode == "none"
    assert corpus.search("rye", SearchOptions(mode="vector", k=1))[0].first()["path"] == "a b/one.md"


def test_watch_sees_edits_and_deletes(spark, tmp_path):
    from millrace.streaming.watch import watch

    (tmp_path / "a.md").write_text("one")
    (tmp_path / "b.md").write_text("two")
    seen = []
    run = watch(spark, lambda n: seen.append({r["path"][-4:]: r["size"] for r in S.listing(spark, str(tmp_path)).collect()}), "1 second")
    try:
        import time

        end = time.time() + 60
        while not seen and time.time() < end:
            time.sleep(0.2)
        (tmp_path / "a.md").write_text("longer")
        (tmp_path / "b.md").unlink()
        while seen[-1:] != [{"a.md": 6}] and time.time() < end:
            time.sleep(0.2)
    finally:
        run.stop()
    assert seen[-1] == {"a.md": 6}


def test_images():
    text = "# A\n![one](a.png \"t\") `![no](b.png)`\n\n![two][r] ![r]\n<img src='c.png'>\n~~~\n![no](d.png)\n~~~\n<!-- page 2 -->\n![x](<e f.png>)\n\n[R]: g.png"
    assert L.images(text) == [("a.png", "one", "A", 0), ("g.png", "two", "A", 0), ("g.png", "r", "A", 0), ("c.png", "", "A", 0), ("<e f.png>", "x", "A", 2)]
    assert L.images("") == [] == L.images("![x][nowhere] ![]()")


@pytest.mark.parametrize(("path", "clean"), [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../a", "../a"), ("a/../../b", "../b"), ("../../a/..", "../.."), ("", "")])
def test_clean_path(spark, path, clean):
    assert one(spark, L.clean_path(F.lit(path))) == clean


def test_diff_of_stale(spark):
    columns = "path string, size long, mtime long, sha256 string"
    known = spark.createDataFrame([("a", 1, 1, "x", "stale"), ("b", 1, 1, "x", "stale"), ("c", 1, 1, "x", "stale"), ("d", 1, 1, "x", "done")], columns + ", status string")
    found = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 2, "x"), ("c", 2, 2, "y"), ("d", 1, 2, "x")], columns)
    assert {r["path"]: r["change"] for r in M.snapshot_diff(known, found).collect()} == {"a": "revived", "b": "revived", "c": "changed", "d": "touched"}


def test_settings():
    told = config.load("[scan]\nkeep = ['old']\n[[pairs]]\nmd = 'md'\npdf = '../pdf'\n[chunk]\ntokens = 16\n[cache]\nquery_ttl = '1x'")
    assert told.scan.keep == ["old"] and told.chunk.overlap == 32 and config.seconds("1h30m") == 5400
    assert sorted(x.split(":")[0] for x in config.problems(told)) == ["cache.query_ttl", "chunk.overlap", "chunk.tokens", "pairs"]
    assert [bool(config._bad_path(p)) for p in ("", "/a", "a/../b", "a\\b", "a/b..c", ".")] == [True, True, True, True, False, False]
    assert len(config.problems(told)) == 4 and config.problems(config.Config()) == []
    with pytest.raises(ValueError, match="chunk.size"):
        config.load("[chunk]\nsize = 1")


def test_folders():
    assert config.add_folder(["a/b", "c"], "a") == ["a", "c"] and config.add_folder(["a"], "a/b") == ["a"] and config.add_folder(["a"], "ab") == ["a", "ab"]
    assert config.remove_folder(["a", "b"], "a") == ["b"]
    with pytest.raises(ValueError):
        config.remove_folder(["a"], "a/b")


def test_rebuild():
    run = lambda *a, **k: spaces.rebuild(*a, **k).mode
    assert [run("a", "", "a", 5), run("a", "b", "a", 5), run("a", "b", "b", 5), run("a", "", "b", 0), run("a", "b", "c", 5), run("a", "", "a", 5, force=True)] == ["none", "cancelled", "continue", "in_place", "switch", "switch"]
    assert spaces.rebuild("a", "", "b", 1, 3_000_000, (2, 4), 11).need_mb == 7
    with pytest.raises(OSError, match="7 MB"):
        spaces.rebuild("a", "", "b", 1, 3_000_000, (2, 4), 10)
    assert spaces.rebuild("a", "", "b", 1, 3_000_000, (2, 4), 10, force=True).need_mb == 7


def test_spaces(spark):
    old = spark.createDataFrame([(1, "x")], "id long, source_path string")
    assert spaces.migrated(old, 1).columns == ["id", "source_path", "start_ms", "end_ms", "bm25_len"] and spaces.migrated(old, 4).columns == old.columns
    with pytest.raises(ValueError, match="newer"):
        spaces.migrated(old, 5)
    jobs = spark.createDataFrame([(1, "failed")], "document_id long, state string")
    assert spaces.complete(jobs) and not spaces.complete(jobs.withColumn("state", F.lit("running")))
    assert spaces.vectors_usable("a", "a", "vector") and not spaces.vectors_usable("a", "b", "hybrid")


def test_cache_counts_hits(spark):
    cache = spark.createDataFrame([("s", "a b", [1.0], 4, 0), ("t", "a b", [2.0], 1, 0), ("s", "c", [3.0], 1, 0)], "space string, query string, vector array<double>, hits long, last_used long")
    asked = spark.createDataFrame([(1, " a  b "), (2, "a b"), (3, "A b")], "query_id long, text string")
    found, after = M.cached(asked, cache, "s", 1, F.lit(9).cast("long"))
    assert {r["query_id"]: r["vector"] for r in found.collect()} == {1: [1.0], 2: [1.0], 3: None}
    assert sorted((r["space"], r["query"], r["hits"], r["last_used"]) for r in after.collect()) == [("s", "a b", 6, 9), ("s", "c", 1, 0), ("t", "a b", 1, 0)]


@pytest.mark.parametrize(("text", "sections"), [
    ("a\n<!-- page: 3 -->\nb", [("", "a", 0), ("", "b", 3)]),  # a mark is a block of its own and may end a paragraph
    ("<!--page3-->\n# A\nb\n\n<!-- PAGE 4 -->\nc", [("A", "b", 3), ("A", "c", 4)]),
    ("a <!-- page 7 --> b", [("", "a  b", 0)]),  # within a line it marks nothing
    ("- item\n\n  # no heading\n- more\n\n# Yes\nx", [("", "- item\n\n  # no heading\n- more", 0), ("Yes", "x", 0)]),
    ("<div>\n# no heading\n</div>\n\n# Yes\nx", [("", "<div>\n# no heading\n</div>", 0), ("Yes", "x", 0)]),
    ("<!-- a\n# no\n\nb -->\n# Yes\nx", [("", "<!-- a\n# no", 0), ("Yes", "x", 0)]),
    ("Two\nlines\n===\nx", [("Two lines", "x", 0)]),
    ("> # quoted\n> text\nlazy\n\n## B\ny", [("", "> # quoted\n> text\nlazy", 0), ("B", "y", 0)]),
    ("    # code\n\n    more\n\n# A\nb", [("", "    # code\n\n    more".strip(), 0), ("A", "b", 0)]),
    ("para\n    # still para\n***\nnext", [("", "para\n    # still para\n\nnext", 0)]),
    ("1) one\n2) two\n\n3. other list", [("", "1) one\n2) two\n\n3. other list", 0)]),
    ("x\n2. no list\n- a list\n", [("", "x\n2. no list\n\n- a list", 0)]),
    ("~~~py x\n# no\n~~~\nt", [("", "```py\n# no\n```\n\nt", 0)]),
    ("```\nnever closed\n# no", [("", "```\nnever closed\n# no\n```", 0)]),
    ("![A b](x.png) and <img src=q alt='c d'> end ![e][r]\n\n\n\n[r]: http://x\nlast", [("", "A b and c d end e\n\nlast", 0)]),
    ("\ufeff---\ntitle: x\n...\n# A\nb", [("A", "b", 0)]),
    ("---\nnever closed\n\n# A\nb", [("", "never closed", 0), ("A", "b", 0)]),
    ("# A\n### C\nx\n## B\ny\n#\nz", [("A > C", "x", 0), ("A > B", "y", 0), ("", "z", 0)]),
    ("#no heading\n####### seven", [("", "#no heading\n####### seven", 0)]),
    ("a\r\n# B\r\nc\r\n", [("", "a", 0), ("B", "c", 0)]),
    ("", []),
])
def test_blocks_of_markdown(text, sections):
    assert C.markdown_sections(text) == sections


def test_guide_of_several_pages():
    text = "---\nsource: ../a.pdf\n---\n# guide\n\nIndexes documents.\n\n![Diagram](img/a.png)\n\n## Installing\n\n- Windows: `a.exe`\n- macOS: `a`\n\n<!-- page 2 -->\n\n## Searching\n\n### Terminal\n\nRun it.\n\n![logo][ref]\n\n<img src=\"screens/t%20s.png\" alt=\"The screen\">\n\n```sh\na search\n```\n\n[ref]: logo.png"
    assert C.markdown_sections(text) == [
        ("guide", "Indexes documents.\n\nDiagram", 0),
        ("guide > Installing", "- Windows: `a.exe`\n- macOS: `a`", 0),
        ("guide > Searching > Terminal", "Run it.\n\nlogo\n\nThe screen\n\n```sh\na search\n```", 2),
    ]
    assert L.images(text) == [("img/a.png", "Diagram", "guide", 0), ("logo.png", "logo", "guide > Searching > Terminal", 2), ("screens/t%20s.png", "The screen", "guide > Searching > Terminal", 2)]


def test_images_in_headings_and_code_do_not_count():
    assert [x[:3] for x in L.images("# ![h](h.png)\n\n    ![i](i.png)\n\n- a ![l](l.png)\n\n> ![q](q.png)\n\n<p>\n![raw](raw.png)\n</p>")] == [("l.png", "l", "h"), ("q.png", "q", "h")]


@pytest.mark.parametrize("text", ["> " * 20000 + "x", "- " * 20000 + "x", "<div>\n" * 20000, "a\n" * 40000, "```\n" * 20001, "[" * 40000, "<!--\n" * 20000, "* * " * 20000])
def test_markdown_takes_time_in_proportion(text):
    began = time.time()
    C.markdown_sections(text)
    assert time.time() - began < 5


@pytest.mark.parametrize("clustered", [True, False])
def test_stored_blocks_lose_no_hit(spark, tmp_path, monkeypatch, clustered):
    monkeypatch.setattr(V, "ROW_BLOCK", 16)
    monkeypatch.setattr(V, "SEED_ROWS", 32)
    rng = np.random.default_rng(4)
    heads = rng.standard_normal((12, 8)) * (3 if clustered else 0)
    data = [(i, (heads[i % 12] + rng.standard_normal(8) * 0.3).tolist()) for i in range(600)] + [(900, [0.0] * 8), (901, None), (902, data_of(1)), (903, data_of(1))]
    rows = spark.createDataFrame(data, "row_id long, vector array<float>")
    V.stored_blocks(rows, 600).write.parquet(str(tmp_path / "v"))
    blocks = spark.read.schema(V.STORED).parquet(str(tmp_path / "v"))
    ask = spark.createDataFrame([(i, (heads[i % 12] + rng.standard_normal(8) * 0.3).tolist()) for i in range(40)] + [(70, [0.0] * 8), (71, None), (72, data_of(1))], "query_id long, vector array<double>")
    for k in (1, 7, 700):
        want = sorted(map(tuple, V.search(ask, rows, k).collect()))
        for bounded in (False, True):
            assert sorted(map(tuple, V.search_blocks(ask, blocks, k, bounded).select("query_id", "row_id", "sim", "rank").collect())) == want
    read = V.blocks_read(ask, blocks, 7).agg(F.sum("read") / F.sum("blocks")).first()[0]
    assert read < (0.3 if clustered else 1.01)
    with pytest.raises(Exception, match="length"):
        V.search_blocks(ask.limit(1).withColumn("vector", F.array(F.lit(1.0))), blocks, 1).collect()
    assert V.stored_blocks(rows.where("false"), 0).count() == 0


def data_of(seed):
    return np.random.default_rng(seed).standard_normal(8).tolist()


def test_substring_join_matches_brute_force(spark):
    from millrace.operators import substring as SUB

    rng = random.Random(11)
    long = [(i, "".join(rng.choice("ab c") for _ in range(rng.randrange(60)))) for i in range(60)] + [(90, None), (91, ""), (92, "文字の列 é")]
    short = [(i, "".join(rng.choice("ab c") for _ in range(n))) for i, n in enumerate([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 3, 5])] + [(70, None), (71, ""), (72, "字の"), (73, long[0][1])]
    got = SUB.contained(spark.createDataFrame(short, "short_id long, text string"), spark.createDataFrame(long, "long_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, s in short for b, t in long if s and t and s in t)
    assert SUB.contained(spark.createDataFrame([(1, "")], "short_id long, text string"), got.selectExpr("long_id", "'x' as text")).count() == 0


def test_scores_as_arrays_are_those_of_joins(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    docs = [(7 * i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(300)] + [(5, None), (6, "the")]
    stored = str(tmp_path / "k")
    K.store(K.on_the_way(K.analyzed(spark.createDataFrame(docs, "chunk_id long, text string"))), stored)
    found = K.stored(spark, stored)
    ask = spark.createDataFrame([(f"q{i}", " ".join(rng.choices([*words, "unknown"], k=6))) for i in range(30)] + [("none", "unknown")], "query_id string, text string")
    allowed = spark.createDataFrame([(7 * i,) for i in range(0, 300, 3)], "chunk_id long")
    told = lambda own: [sorted(map(tuple, K.keyword_hits(ask, own, 9, some).collect())) for some in (None, allowed)]
    monkeypatch.setattr(K, "SCORES", 64)
    monkeypatch.setattr(K, "AT_ONCE", 50)
    arrays, plan = told(found), K.keyword_hits(ask, found, 9)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(K, "TOLD", 0)
    assert arrays == told(found) == told(K.on_the_way(K.analyzed(spark.createDataFrame(docs, "chunk_id long, text string"))))
    assert "HashAggregate(keys=[query_id" not in plan  # no table of all pairs of query and chunk


def test_postings_are_dealt_once(spark):
    docs = K.analyzed(spark.createDataFrame([(1, "b a b"), (2, "a1 bb bb"), (3, None), (4, "")], "chunk_id long, text string"))
    rows = K.lengthed(docs)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [("a1", 2, 1, 3), ("bb", 2, 2, 3)]


def test_vector_blocks_meet_without_a_product(spark):
    rows = spark.range(300).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    asked = rows.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    blocks = V.stored_blocks(rows, 300)
    for found in (V.search(asked, rows, 3), V.search_blocks(asked, blocks, 3, False), V.search_blocks(asked, blocks, 3, True)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_grams_that_are_not_sought_stay_where_they_arise(spark, monkeypatch):
    short = spark.createDataFrame([(1, "bread and yeast"), (2, "of"), (3, "")], "short_id long, text string")
    long = spark.createDataFrame([(1, "we bake bread and yeast cakes of flour"), (2, "off"), (3, None), (4, "bread and butter")], "long_id long, text string")
    found = SUB.contained(short, long)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(SUB, "SOUGHT", 0)
    assert pairs == sorted(map(tuple, SUB.contained(short, long).collect())) == [(1, 1), (2, 1), (2, 2)]


def test_blocks_stay_where_they_lie_when_few_chunks_change(spark):
    texts = spark.createDataFrame([(i, f"word{i} common") for i in range(40)], "chunk_id long, text string")
    some = texts.where("chunk_id < 3")
    after = K.on_the_way(K.analyzed(texts)).replaced(some, K.analyzed(some.withColumn("text", F.lit("fresh"))))
    assert "strategy=broadcast" in after.terms._jdf.queryExecution().optimizedPlan().toString()
    found = {r["term"]: r["df"] for r in after.terms.collect()}
    assert found["common"] == 37 and found["fresh"] == 3 and "word1" not in found


def test_chunks_are_handed_on_some_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"# T{i}\n\n" + "word " * 90 * i) for i in range(9)] + [(9, None)], "document_id long, text string")
    chunks = lambda: sorted(map(tuple, C.chunk_documents(docs, 64, 8).collect()))
    whole = chunks()
    monkeypatch.setattr(C, "AT_ONCE", 2)
    assert chunks() == whole and len({row[0] for row in whole}) == 8


def test_postings_are_gathered_by_term_before_they_are_dealt(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    texts = [(rng.randrange(-40, 400), " ".join(f"w{int(rng.paretovariate(0.6)) % 50}" for _ in range(rng.randrange(40)))) for _ in range(200)] + [(1 << 40, "w1 w1"), (5, None), (6, "the")]
    docs = K.analyzed(spark.createDataFrame(list(dict(texts).items()), "chunk_id long, text string")).coalesce(1)
    post = sorted(map(tuple, K.lengthed(docs).collect()))
    gathered = K._gathered(docs, 8, 1)
    assert gathered.count() == len({p[0] for p in post})
    assert sorted((r["term"], *p) for r in gathered.collect() for p in zip(r["ids"], r["tfs"], r["sizes"])) == post
    monkeypatch.setattr(K, "GATHERED", 64)
    monkeypatch.setattr(K, "STORED_ROWS", 200)  # several files of a part
    K.store(K.on_the_way(docs), str(tmp_path / "k"))
    told = lambda blocks: sorted(map(str, blocks.select("term", "cell", "n", "tops", "held").collect()))
    assert told(K.stored(spark, str(tmp_path / "k")).blocks) == told(K.blocks_of(K.lengthed(docs), 8))


def test_hashed_vectors_count_tokens(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["b"])], "i int, tokens array<string>")
    at = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8
    want = {1: ["a", "b", "a"], 2: [], 3: [], 4: ["b"]}
    for r in rows.select("i", V.embed_tokens(F.col("tokens"), 8).alias("v")).collect():
        assert r["v"] == [float(sum(at(w) == i for w in want[r["i"]])) for i in range(8)]


def test_texts_stay_where_they_lie_when_few_hits_ask(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"p{i}.md", "markdown", None) for i in range(9)], "document_id long, path string, kind string, pair_id long")
    chunks = K.analyzed(spark.createDataFrame([(i, i, "text", f"alpha word{i}", "", 0, None, None, None) for i in range(9)], "chunk_id long, document_id long, modality string, text string, heading_path string, page int, source_path string, start_ms long, end_ms long"))
    ask = spark.createDataFrame([(7, "alpha"), (8, "alpha word3")], "query_id long, text string")
    found = lambda: SE.search_documents(ask, chunks, docs, SearchOptions(k=4, mode="keyword"))[0]
    few = found()
    assert "strategy=broadcast" in few._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(map(str, few.collect()))
    monkeypatch.setattr(SE, "TOLD_HITS", 0)
    assert rows == sorted(map(str, found().collect())) and len(rows) == 8


def test_passages_are_found_without_dealing_texts(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(1, "One Rare passage here"), (2, "one rare Passage"), (3, None), (4, "a passage here of one rare kind"), (5, "so one rare passage herein")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "one rare passage here"), (2, "rare kind"), (3, "no such passage at all")], "query_id long, text string")
    postings = I.build(texts, str(tmp_path / "i")).postings
    found = Q._holding(asked, postings, texts)
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(SE, "TOLD_HITS", 0)
    assert pairs == sorted(map(tuple, Q._holding(asked, postings, texts).collect())) == [(1, 1), (1, 5), (2, 4)]


def test_moments_of_long_files_match_plain_search(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(40):
        for _ in range(rng.randrange(60)):
            start = rng.randrange(-20_000, 400_000)
            rows.append((rng.randrange(2), doc, start, start + rng.choice([0, 500, 20_000, 30_000, 60_000, 60_001, 90_000]), rng.random(), rng.random() < 0.3, rng.choice(["audio", "video"])))
    rng.shuffle(rows)
    hits = [(q, i + 1, d, s, e, x, k, m, "h") for i, (q, d, s, e, x, k, m) in enumerate(rows)]
    held: dict = {}
    for q, rank, d, s, e, x, k, m, h in hits:  # every result of the file is looked at
        own = held.setdefault((q, d), [])
        fits = [r for r in own if s < e and r[1] < r[2] and r[1] < e and s < r[2] and max(r[2], e) - min(r[1], s) <= merge.SPAN_MS]
        if fits:
            r = fits[0]
            r[1:] = [min(r[1], s), max(r[2], e), max(r[3], x), r[4] or k, r[5] | {m}, r[6] + 1]
        else:
            own.append([rank, s, e, x, k, {m}, 1])
    want = sorted((q, r[0], d, r[1], r[2], r[3], r[4], "audio+video" if len(r[5]) > 1 else min(r[5]), r[6] > 1) for (q, d), own in held.items() for r in own)
    schema = "query_id long, rank int, doc long, start long, end long, sim double, kw boolean, modality string, heading string"
    table = spark.createDataFrame(hits, schema)
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # files go over several batches
    try:
        got = merge.merge_moments(table).collect()
        dealt = merge._merged_moments(table.repartition(3, "query_id"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    placed = {}
    for w in want:
        placed.setdefault(w[0], []).append((w[0], len(placed.get(w[0], [])) + 1, *w[2:]))
    assert sorted((r["query_id"], r["rank"], r["doc"], r["start"], r["end"], r["sim"], r["kw"], r["modality"], r["heading"] != "h") for r in got) == sorted(x for own in placed.values() for x in own)
    assert dealt.count("Exchange hashpartitioning") == 1  # hits that lie together by query are not dealt anew


def test_media_hits_of_orders_that_repeat(spark, tmp_path):
    orders = [(1, 5, 70000.0), (1, 5, 70000.0), (1, 6, 70000.0), (1, 7, 0.0), (2, 8, 20000.4), (1, 9, None), (1, 4, 90000.0)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((r["query_id"], r["rank"], r["doc"], r["start"]) for r in Q._media_hits(spark, str(tmp_path)).collect())
    rows = [(c, -p, o, i * 25000) for c, o, p in orders if p for i in range(max(0, -(-(round(p) - 30000) // 25000)) + 1)]
    rows.sort()
    want = [(c, sum(r[0] == c for r in rows[:n]) + 1, o, s) for n, (c, _, o, s) in enumerate(rows)]
    assert got == want
