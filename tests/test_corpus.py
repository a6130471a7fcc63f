"""A corpus through its life: segments against a full build, interleaved writers, cut-off work, and every kind of document."""

import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import keyword as K
from millrace.operators import maintain as M
from millrace.plans import config, errors, segments
from millrace.plans import versions as VS
from millrace.plans.cache import QueryCache
from millrace.plans.corpus import LEASE_MS, PAIRED, Corpus
from millrace.plans.search import SearchOptions


@pytest.fixture(autouse=True)
def plain_plans(spark):
    """Tiny tables, many jobs: compiling them would take longer than they do."""
    told = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def state(corpus):
    """What a corpus holds, by paths instead of numbers."""
    version = corpus.version()
    docs = corpus.tables.documents(version).select("document_id", "path", "status", "chunk_count")
    chunks = corpus.tables.chunks(version).join(docs, "document_id")
    found = corpus.tables.postings(version)
    place = chunks.select("chunk_id", "path", "ord")
    return {
        "documents": sorted(map(tuple, docs.drop("document_id").collect())),
        "chunks": sorted((r["path"], r["ord"], r["text"], r["modality"]) for r in chunks.collect()),
        "postings": sorted((r["term"], r["path"], r["ord"], r["tf"], r["bm25_len"]) for r in found.post.join(place, "chunk_id").collect()),
        "terms": sorted(map(tuple, found.of(found.post.select("term")).terms.select("term", "df").collect())),
        "stats": tuple(found.stats().first()),
        "vectors": sorted((r["path"], r["ord"], tuple(r["vector"])) for r in corpus.tables.vectors(version, version.space).join(place, "chunk_id").collect()),
        "links": sorted((r["path"], r["child_path"]) for r in corpus.tables.links(version).join(docs, "document_id").collect()),
    }


def bytes_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_random_edits_equal_a_full_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FANOUT", 3)
    monkeypatch.setattr(segments, "LOWEST", 200)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["the", "bread"]
    text = lambda: f"# {rng.choice(words)}\n" + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "\n![pic](p.png)"])
    root = tmp_path / "docs"
    write(root, {f"d{i}.md": text() for i in range(25)} | {"p.png": "x"})
    corpus = Corpus(spark, str(root), str(tmp_path / "store"))
    corpus.scan()
    merged = 0
    for step in range(2):
        for _ in range(6):
            name, act = f"d{rng.randrange(30)}.md", rng.randrange(4)
            if act == 0 and (root / name).exists():
                (root / name).unlink()
            elif act == 1 and (root / name).exists():
                (root / name).rename(root / f"moved{step}-{name}")
            else:
                write(root, {name: text()})
        before = len(corpus.version().segments)
        corpus.scan()
        merged += len(corpus.version().segments) < before + 2
    assert merged
    anew = Corpus(spark, str(root), str(tmp_path / "anew"))
    anew.scan()
    whole = state(anew)
    assert state(corpus) == whole
    corpus.tables.compact(corpus.version(), len(corpus.version().segments))
    assert len(corpus.version().segments) == 1 and state(corpus) == whole
    ask = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(3))) for i in range(6)], "query_id long, text string")
    for mode in ("keyword", "hybrid"):
        hits = [sorted((r["query_id"], r["rank"], r["score"]) for r in c.search(ask, SearchOptions(mode=mode, k=4))[0].collect()) for c in (corpus, anew)]
        assert hits[0] == hits[1] and hits[0]
    assert corpus.vacuum(1) > 0 and state(corpus) == whole and len(VS.numbers(spark, str(tmp_path / "store"))) == 1


def test_a_scan_writes_what_changed(spark, tmp_path):
    root, store = tmp_path / "docs", tmp_path / "store"
    write(root, {f"d{i}.md": " ".join(f"x{(i * j) % 997}" for j in range(1, 700)) for i in range(60)})
    corpus = Corpus(spark, str(root), str(store))
    corpus.scan()
    first = bytes_of(store / "segments")
    write(root, {"d7.md": "only a few words now"})
    assert corpus.scan()["changed"] == 1
    assert bytes_of(store / "segments") - first < first / 5
    assert not (store / "work").exists() or not os.listdir(store / "work")


def test_interleaved_writers(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "docs", str(tmp_path / "store")
    write(root, {"a.md": "first words"})
    one, two = Corpus(spark, str(root), store), Corpus(spark, str(root), store)
    one.scan()
    write(root, {"b.md": "second words"})
    plain, met = segments.Store.segment, []

    def overtaken(self, *args, **kept):
        if not met:
            met.append(1)
            write(root, {"c.md": "third words"})
            two.scan()
        return plain(self, *args, **kept)

    monkeypatch.setattr(segments.Store, "segment", overtaken)
    with pytest.raises(errors.Locked):
        one.scan()
    monkeypatch.setattr(segments.Store, "segment", plain)
    assert [r["path"] for r in one.documents("done").collect()] == ["a.md", "b.md", "c.md"]
    base = one.version()
    VS.publish(spark, store, base, base)
    with pytest.raises(errors.Locked):
        VS.publish(spark, store, base, base)
    assert VS.latest(spark, store).number == base.number + 1


def test_failed_and_cut_off_work_is_taken_up_again(spark, tmp_path, monkeypatch):
    root, store, tries, clock = tmp_path / "docs", str(tmp_path / "store"), [], [1_000_000]
    write(root, {"a.md": "apples here", "b.md": "pears here"})

    def reader(files):
        if any(r["path"] == "b.md" for r in files.select("path").collect()):
            tries.append(1)
        bad = (F.col("path") == "b.md") & F.lit(len(tries) < 3)
        return files.select("path", F.col("content").cast("string").alias("text"), F.when(bad, "unreadable").alias("error"))

    make = lambda: Corpus(spark, str(root), store, reader=reader, now=lambda: clock[0])
    corpus = make()
    seen = [corpus.scan() for _ in range(3)]
    assert [(r["indexed"], r["failed"]) for r in seen] == [(1, 1), (0, 1), (1, 0)] and len(tries) == 3
    assert corpus.documents("done").count() == 2
    write(root, {"c.md": "cherries here"})
    monkeypatch.setattr(Corpus, "_work", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
    with pytest.raises(RuntimeError):
        corpus.scan()
    monkeypatch.undo()
    other = make()
    assert other.scan()["indexed"] == 0 and other.status()["queued"] == 1  # the claim still holds
    clock[0] += LEASE_MS + 1
    assert other.scan()["indexed"] == 1 and other.search("cherries", SearchOptions(mode="keyword"))[0].first()["path"] == "c.md"


def test_rebuild_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "docs", str(tmp_path / "store")
    write(root, {f"d{i}.md": f"word{i} bread" for i in range(12)})
    corpus = Corpus(spark, str(root), store)
    corpus.scan()
    wide = config.load("[embed]\ndim = 32")
    plain, made = segments.Store.slice, []

    def counted(self, segment, space, k, make):
        if len(made) == 3:
            raise KeyboardInterrupt
        done = plain(self, segment, space, k, make)
        made.extend([k] * done)
        return done

    monkeypatch.setattr(segments.Store, "slice", counted)
    with pytest.raises(KeyboardInterrupt):
        Corpus(spark, str(root), store, wide).rebuild()
    write(root, {"d3.md": "changed meanwhile rye", "new.md": "rye new"})
    corpus.scan()  # writes both spaces
    assert corpus.status()["building"] == Corpus(spark, str(root), store, wide).space
    again: list = []
    monkeypatch.setattr(segments.Store, "slice", lambda self, s, space, k, make: again.append(k) if plain(self, s, space, k, make) else None)
    fresh = Corpus(spark, str(root), store, wide)
    assert fresh.rebuild().mode == "continue"
    assert len(again) == segments.SLICES - 3
    version = fresh.version()
    assert (version.space, version.building) == (fresh.space, "")
    assert fresh.tables.vectors(version, version.space).count() == fresh.tables.chunks(version).count() == 13
    assert fresh.search("rye new", SearchOptions(mode="vector", k=1))[0].first()["path"] == "new.md"
    assert {r["embed_id"] for r in fresh.documents().collect()} == {fresh.space}
    assert fresh.rebuild().mode == "none"


def test_known_queries_are_not_embedded_again(spark, tmp_path):
    root = tmp_path / "docs"
    write(root, {"a.md": "bread", "b.md": "rye"})
    calls = []

    def embed(text):
        calls.append(1)
        return V.embed_tokens(T.tokens(text), 64)

    corpus = Corpus(spark, str(root), str(tmp_path / "store"), embed=embed)
    corpus.scan()
    ask = spark.createDataFrame([(1, "bread"), (2, " rye  now"), (3, "rye now")], "query_id long, text string")
    calls.clear()
    first = sorted(map(tuple, corpus.search(ask)[0].collect()))
    assert len(calls) == 1
    assert sorted(map(tuple, corpus.search(ask)[0].collect())) == first and len(calls) == 1
    assert {r["query"]: r["hits"] for r in corpus.cache.known().collect()} == {"bread": 2, "rye now": 4}


def test_cache_keeps_the_most_used(spark, tmp_path):
    cache = QueryCache(spark, str(tmp_path))
    embed = lambda rows: rows.withColumn("vector", F.array(F.lit(1.0)).cast("array<float>"))
    for at, batch in enumerate([["a", "b", "c", "d"], ["a", "b"], ["a", "e"], ["f"]], 1):
        cache.embedded(spark.createDataFrame(list(enumerate(batch)), "query_id long, text string"), "s", embed, at, 9).count()
    assert cache.fold(4, 1) == 4
    assert {r["query"]: (r["hits"], r["last_used"]) for r in cache.known().collect()} == {"a": (3, 3), "b": (2, 2), "f": (1, 4), "e": (1, 3)}
    assert cache.fold(9, 3) == 3 and {r["query"] for r in cache.known().collect()} == {"a", "e", "f"}
    assert cache.fold(0, 0) == 0 and cache.known().count() == 0


def test_every_kind_of_document(spark, tmp_path):
    root = tmp_path / "docs"
    write(root, {
        "notes/guide.md": "# Guide\nMulti-head attention explained.\n\n![Diagram](img/diagram.png)\n\n## More\nEnd words.",
        "notes/img/diagram.png": "x", "photos/cat-photo.png": "x", "md/report.md": "# Budget\nmoney words", "pdf/report.pdf": "%PDF", "papers/bert.pdf": "%PDF", "papers/scan.pdf": "%PDF", "papers/none.pdf": "%PDF", "talk.mp4": "v", "song.mp3": "a", "old/x.md": "old words",
    })
    pages = spark.createDataFrame([("papers/bert.pdf", 1, "first page\x02 words"), ("papers/bert.pdf", 2, "second page"), ("papers/scan.pdf", 1, None), ("pdf/report.pdf", 1, "money printed")], "path string, page int, text string")
    media = spark.createDataFrame([("talk.mp4", 70_000, True, True), ("song.mp3", 0, True, False)], "path string, duration_ms long, has_audio boolean, has_video boolean")
    settings = config.load("[scan]\nfolders = ['notes', 'photos', 'md', 'pdf', 'papers', 'old', 'talk.mp4', 'song.mp3']\n[[pairs]]\nmd = 'md'\npdf = 'pdf'")
    corpus = Corpus(spark, str(root), str(tmp_path / "store"), settings, pages=pages, media=media)
    report = corpus.scan()
    docs = {r["path"]: r for r in corpus.documents().collect()}
    counts = {p: r["chunk_count"] for p, r in docs.items()}
    assert counts == {"notes/guide.md": 2, "notes/img/diagram.png": 0, "photos/cat-photo.png": 1, "md/report.md": 1, "pdf/report.pdf": 1, "papers/bert.pdf": 4, "papers/scan.pdf": 1, "papers/none.pdf": 0, "talk.mp4": 6, "song.mp3": 0, "old/x.md": 1}
    assert (docs["papers/none.pdf"]["status"], docs["song.mp3"]["error"], docs["notes/img/diagram.png"]["error"], docs["pdf/report.pdf"]["error"]) == ("failed", "no length", M.LINKED, PAIRED)
    assert (docs["md/report.md"]["pair_path"], report["pairs"], corpus.status()["pairs"]) == ("pdf/report.pdf", 1, 1)
    best = lambda text, **more: corpus.search(text, SearchOptions(mode="keyword", k=3, **more))[0].orderBy("rank").first()
    assert (best("diagram")["path"], best("diagram")["parent_path"]) == ("notes/img/diagram.png", "notes/guide.md")
    assert best("first page words")["path"] == "papers/bert.pdf" and best("talk")["modality"] in ("video", "audio", "audio+video")
    assert corpus.remove_folder("old") == 1 and best("old words")["path"] == "old/x.md"
    assert corpus.documents("stale").count() == 1
    # the text loses its image, the PDF its transcription, and the stale document its folder
    write(root, {"notes/guide.md": "# Guide\nNo pictures."})
    (root / "md" / "report.md").unlink()
    report = corpus.scan()
    docs = {r["path"]: r for r in corpus.documents().collect()}
    assert "old/x.md" not in docs and report["deleted"] == 2
    assert (docs["notes/img/diagram.png"]["chunk_count"], docs["notes/img/diagram.png"]["status"]) == (1, "done")
    assert (docs["pdf/report.pdf"]["chunk_count"], docs["pdf/report.pdf"]["pair_id"], docs["pdf/report.pdf"]["error"]) == (2, None, None)
    assert best("diagram")["parent_path"] is None and best("money printed")["path"] == "pdf/report.pdf"


def test_documents_that_wait_are_read_though_their_files_did_not_change(spark, tmp_path):
    root = tmp_path / "docs"
    write(root, {"a.md": "apples here", "b.md": "pears"})
    corpus = Corpus(spark, str(root), str(tmp_path / "store"))
    corpus.scan()
    base = corpus.version()
    turned = corpus.tables.documents(base).where("path = 'a.md'").withColumn("status", F.lit("pending"))
    corpus.tables.publish(base, corpus.tables.segment(base, docs=turned))
    assert corpus.scan()["indexed"] == 1
    assert corpus.search("apples", SearchOptions(mode="keyword"))[0].first()["path"] == "a.md"
    shutil.rmtree(root)
    root.mkdir()
    assert corpus.scan()["deleted"] == 2 and corpus.search("apples", SearchOptions(mode="keyword"))[0].count() == 0
    assert K.corpus_stats(corpus.index().chunks).first()["n"] == 0


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    from dataclasses import asdict

    from millrace.streaming.watch import Debounce, watch_folder

    good = config.load("[scan]\nkeep = ['a']")
    make = lambda read: Debounce(read, config.problems, quiet=5.0, safety=1e9, dump=asdict, parse=config.from_dict)
    one = make(lambda: good)
    assert one.due([1, "x", 2], 100.0) and not one.due([2, "y", 3], 200.0)

    def broken():
        raise ValueError("no settings")

    two = make(broken)
    assert two.settings is None and not two.due([9], 1.0)
    two = make(broken)
    two.restore(one.state())
    assert not two.due([2, "y", 3], 204.0) and two.due([2, "y", 3], 205.0) and two.settings == good and two.faults
    two.again(205.0)
    assert not two.due([2, "y", 3], 209.0) and two.due([2, "y", 3], 210.0)
    # the same with streams: the first one sees a change and is stopped in its rescan; the second one makes up for it
    root, memory = tmp_path / "docs", str(tmp_path / "memory")
    write(root, {"a.md": "one"})
    corpus, seen = Corpus(spark, str(root), str(tmp_path / "store")), []

    def run(rescan, until):
        query = watch_folder(spark, lambda: corpus._listed()[0], rescan, Debounce(lambda: good, config.problems, quiet=0.5, dump=asdict, parse=config.from_dict), checkpoint=memory)
        end = time.time() + 60
        while not until(query) and time.time() < end:
            time.sleep(0.2)
        query.stop()

    run(lambda s: seen.append("first"), lambda q: len(seen) == 1 and os.path.exists(f"{memory}/debounce.json"))
    write(root, {"b.md": "two"})

    def cut_off(settings):
        seen.append("cut")
        raise RuntimeError("cut off")

    run(cut_off, lambda q: q.exception() is not None)
    run(lambda s: seen.append("made up"), lambda q: seen[-1] == "made up")
    assert seen[0] == "first" and "cut" in seen and seen[-1] == "made up"


def test_runner_batches_in_order(spark, tmp_path):
    from millrace.functions.embedder import Runner, batches_of, embed_units

    assert list(batches_of(["text"] * 5 + ["audio"] * 2 + ["text"], 3)) == [(0, 3), (3, 5), (5, 6), (6, 7), (7, 8)]
    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def model(modality, inputs):
            with open(log, "a") as f:
                f.write(f"{modality} {len(inputs)}\n")
            return [[float(len(x)), 1.0] for x in inputs]

        return model

    rows = [(i, "video" if i % 10 == 3 else "text" if i % 10 < 8 else "pdf_page", None if i == 5 else "x" * i) for i in range(60)]
    units = spark.createDataFrame(rows, "id long, modality string, input string").coalesce(1)
    runner = Runner(f"m{tmp_path}", load, 2, ("text", "video"))
    got = {r["id"]: r["vector"] for r in embed_units(units, runner).collect()}
    assert got == {i: [float(i), 1.0] if m != "pdf_page" and x is not None else None for i, m, x in rows}
    told = open(log).read().split("\n")[:-1]
    loads = [x for x in told if x.startswith("load")]
    assert len(loads) == len(set(loads)) and "video 1" in told and not any(x.startswith("video") and x != "video 1" for x in told)
    assert max(int(x.split()[1]) for x in told if x.startswith("text")) <= 16
    for bad, match in ((lambda m, xs: [[1.0, 2.0]] * (len(xs) + 1), "vectors for"), (lambda m, xs: [[1.0]] * len(xs), "length 1")):
        with pytest.raises(Exception, match=match):
            embed_units(units, Runner(f"bad{match}{tmp_path}", lambda bad=bad: bad, 2)).collect()
    root = tmp_path / "docs"
    write(root, {"a.md": "# One\nbread", "b.md": "rye and salt"})
    corpus = Corpus(spark, str(root), str(tmp_path / "store"), config.load("[embed]\ndim = 2"), runner=Runner(f"c{tmp_path}", load, 2))
    corpus.scan()
    version = corpus.version()
    assert sorted(tuple(r["vector"]) for r in corpus.tables.vectors(version, version.space).collect()) == [(10.0, 1.0), (12.0, 1.0)]
    assert corpus.search("rye", SearchOptions(k=1))[0].first()["path"] == "b.md"
