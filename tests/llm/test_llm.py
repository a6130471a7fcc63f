"""The training-data operators: SQL twins, brute force, round trips, held-out accuracy, and awkward rows."""

import hashlib
import random
import struct
import time
import zlib
from base64 import b32encode

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, html, language, leaks, lines, mixing, neardup, passages, queries, tiff, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000
AWKWARD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", None), (4, "same text of a few words here twice over for all to see now", "en", "b", 1), (5, "same text of a few words here twice over for all to see now", "en", "b", 1), (5, "same text of a few words here twice over for all to see now", "en", "b", 1), (None, "no id at all but some words to keep", "de", None, 3), (6, "\n\n \t", "fr", "c", 2), (7, "12 34", None, "c", 5), (8, "Ünïcödé 文字 \x0b end", "fr", "a", 9)]


def docs_of(spark, rows):
    """With columns whose names clash with those that operators add."""
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as kept_text", "'x' as size", "2 as taken", "true as kept", "0 as score", "'y' as value", "3 as node", "4 as component_id")


def test_awkward_rows(spark):
    docs, none = docs_of(spark, AWKWARD), docs_of(spark, [])
    for run in (language.language_digest, tiff.media_digest, lines.line_digest, passages.passage_digest, neardup.near_duplicates, mixing.mix_digest):
        assert run(docs).count() == len(AWKWARD), run
        assert run(none).count() == 0, run
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert (got[5]["component_id"], got[5]["kept"], got[4]["kept"], got[1]["n_shingles"], got[None]["kept"]) == (4, False, True, 0, True)
    assert {r["doc_id"]: r["lang_pred"] for r in language.language_digest(docs).collect()}[7] == "und"
    for keep in (language.keep_identified, neardup.drop_near_duplicates):
        assert keep(docs).columns == docs.columns
    items = spark.createDataFrame([(1, "same text of a few words here"), (2, None), (3, "")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).collect()) == [(4, 1), (5, 1)]
    assert leaks.find_leaks(docs, items.where("false")).count() == 0 and leaks.find_leaks(none, items).count() == 0


@pytest.mark.parametrize("sql", ["op4_line_dedup"])
def test_lines_of_awkward_rows(spark, sql):
    rows = [r for r in AWKWARD if r[0] is not None][:5] + [(9, "A repeated line\nshort\n a REPEATED line \nlast", "en", "a", 1), (10, "a repeated line\nshort", "en", "a", 1)]
    got = {r["doc_id"]: r.asDict() for r in lines.drop_repeated_lines(docs_of(spark, rows)).collect()}
    assert (got[9]["n_dropped"], got[10]["n_dropped"], got[10]["kept_text"]) == (0, 1, "short")
    assert (got[1]["n_lines"], got[5]["n_dropped"], got[5]["kept_text"]) == (1, 1, "")


def test_lines_of_one_id_keep_their_own(spark):
    rows = [(5, "a repeated line here\nfirst unique line"), (5, "another unique line\nsecond unique line"), (1, "a repeated line here\nx"), (5, "a repeated line here\nfirst unique line"), (None, "a repeated line here")]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    one = (5, 2, 1, "first unique line")
    assert sorted(got, key=repr) == sorted([one, one, (5, 2, 0, "another unique line\nsecond unique line"), (1, 2, 0, "a repeated line here\nx"), (None, 1, 0, "a repeated line here")], key=repr)


def near_brute(texts, words=4):
    sets = {d: neardup.shingle_set(t, words) for d, t in texts.items()}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    return {d: (len(sets[d]), root[d]) for d in sets}


def test_near_duplicates_match_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    chain = list(base)
    for i in range(120):  # a group of graded copies, copies of copies among them, and short texts
        words = list(base if i % 3 else chain)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        chain = words
        rows.append((100_000 + i, " ".join(words)))
    rows += [(200_000 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == near_brute(dict(rows))


def test_letters_in_patterns_are_no_near_duplicates(spark):
    word = "a"
    while len(word) < 2048:  # such a word and its complement are equal to polynomials modulo a power of two
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 2, 3: 1}


def test_shingle_width(spark):
    words = [f"w{i}" for i in range(44)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:22], "x", *words[23:]]))]  # 37 of 45 shingles of four words are shared, 35 of 45 of five
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [neardup.near_duplicates(docs, n).where("kept").count() for n in (4, 5)] == [1, 2]
    assert neardup.drop_near_duplicates(docs).count() == 2


@pytest.mark.parametrize("hot", [1000, 3])
def test_passages_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(60)]
    shared = [" ".join(rng.choice(pool) for _ in range(n)) for n in (12, 13, 20, 70)]
    rows = [(i, " ".join(" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) + " \n" + rng.choice(shared) for _ in range(rng.randrange(4)))) for i in range(80)]
    rows += [(i + 500, rows[i][1]) for i in range(10)] + [(900, None)]
    rows += [(40, rows[3][1] + " other words"), (40, rows[40][1]), (41, "other " + rows[3][1]), (77, rows[1][1] + " " + rows[2][1])]  # ids of several texts
    found = passages.passage_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == passages.brute_force(rows)


def test_passages_of_one_id_keep_their_own_words(spark):
    unique = " ".join(f"u{i}" for i in range(60))
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(5, shared), (5, unique), (1, shared)]
    got = sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in passages.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(60, 60, ""), (60, 0, unique), (60, 0, shared)])


def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op2_language"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95 and got.where("score < 0 or score > 1").isEmpty()


SCRIPTS = {"ar": (0x627, 28), "el": (0x3B1, 24), "hi": (0x905, 50), "ko": (0xAC00, 800), "ru": (0x430, 32), "th": (0xE01, 40), "zh": (0x4E00, 800)}


def in_script(lang, rng):
    first, n = SCRIPTS[lang]
    return " ".join("".join(chr(first + int(n * rng.random() ** 2)) for _ in range(rng.randrange(1, 7))) for _ in range(60))


def test_language_of_many_scripts():
    rng = random.Random(2)
    model = language.fit([(lang, in_script(lang, rng)) for lang in SCRIPTS for _ in range(64)])
    fresh = [(lang, in_script(lang, rng)) for lang in SCRIPTS for _ in range(20)]
    found, scores = language.predict(model, [text for _, text in fresh])
    assert found == [lang for lang, _ in fresh] and scores.min() > 0.5


def test_language_matches_plain_kernel_ridge():
    """The same kernel from Python sets, and ridge regression on the landmarks' columns of the kernel matrix."""
    docs = duckdb.sql(f"select lang, text from '{DATA}/documents.parquet' where lang is not null and length(text) > 200 order by doc_id").fetchall()
    train, fresh = docs[:60], docs[60:110]
    model = language.fit(train, landmarks=100)
    found, _ = language.predict(model, [t for _, t in fresh])

    def grams(text):
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        spaced = f" {' '.join(words)} "
        return {spaced[i : i + n] for n in (1, 2, 3) for i in range(len(spaced) - n + 1)}

    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    sets, langs = [grams(t) for _, t in train], sorted({lang for lang, _ in train})
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    goal = np.array([[1.0 if lang == own else -1.0 for lang in langs] for own, _ in train])
    share = np.array([1 / sum(own == lang for own, _ in train) for lang, _ in train])
    weights = np.linalg.solve(k @ (k * share[:, None]) + language.RIDGE / len(train) * k + 1e-9 * np.eye(len(k)), k @ (goal * share[:, None]))
    plain = [langs[int(np.argmax([sum(kernel(grams(t), s) * w for s, w in zip(sets, weights[:, j], strict=True)) for j in range(len(langs))]))] for _, t in fresh]
    assert sum(a == b for a, b in zip(found, plain, strict=True)) >= 49


def test_rows_stay_without_a_language_to_learn_from(spark):
    docs = docs_of(spark, AWKWARD).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] or 0 for r in language.keep_identified(docs).collect()) == [0, 3, 4, 5, 5, 8]
    held = docs_of(spark, AWKWARD).where(language.held_out(F.col("doc_id")))
    assert language.train(held) is None and language.keep_identified(held).count() == held.where(r"text rlike '\\p{L}'").count() > 0


def test_leaks_match_brute_force(spark):
    docs, items = (duckdb.sql(f"select * from '{DATA}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    exact = {(d[0], i[0]) for d in docs for i in items if i[1] in d[1]}
    found = queries.QUERIES["op10_decontamination"](spark, DATA)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == exact


def test_leaks_with_other_slots(spark):
    items = spark.createDataFrame([(1, "If the baker Anna sells 12 kg of flour for 3.50 a bag, how much does the baker Anna earn from 12 bags?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Well: if the baker Boris sells 70 lb of flour for 9 a bag, how much does the baker Boris earn from 70 bags? Yes."), (2, "If the baker Boris sells 70 lb of flour for 9 a bag, how much does the baker Carla earn from 71 bags?"), (3, "The baker sells flour and bags of sugar all day long.")], "doc_id long, text string")
    assert [r["doc_id"] for r in leaks.find_leaks(docs, items).collect()] == [1]


def test_leaks_in_capitals(spark):
    text = "La. Éai éonleeau pour an ñ éonqueê aivi ai, éenaitreoiaux éoiré anvitre, pour 3.50 kg. Ouèà les à 7% au."
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"THE!! {text.upper()}!! IN"), (2, f"one {text.lower()} two"), (3, text.upper().replace("POUR", "PAR").replace("AIVI", "AVI"))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in leaks.find_leaks(docs, items).collect()) == [1, 2]


def leaky(spark, item, texts):
    """Numbers of the texts that hold the item, by itself a benchmark."""
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in leaks.find_leaks(docs, items).collect())


def test_leaks_with_names_in_any_case_and_place(spark):
    item = "We went to see Paris and then took Anna along to Rome where old Mario met Carla near some Tiber bridge"
    assert leaky(spark, item, [item.upper(), item.lower(), item.replace(" ", "\n"), "We went home."]) == [0, 1, 2]
    assert leaky(spark, "Anna has 3 apples. Anna buys 5 more.", ["Boris has 4 apples. Boris buys 7 more.", "so Boris has 4 apples\nBoris buys 7 more", "Boris has 4 pears. Boris sells 7 more."]) == [0, 1]


def test_leaks_with_words_put_in_dropped_or_replaced(spark):
    words = [f"w{chr(97 + i)}" for i in range(26)]
    for n in (11, 13, 14, 15, 18, 22, 23, 26):
        own, half = words[:n], n // 2
        assert leaky(spark, " ".join(own), [" ".join(x) for x in (own[:half] + ["new"] + own[half:], own[:half] + own[half + 1 :], own[:half] + ["new"] + own[half + 1 :], own[: half - 1], words[::-1])]) == [0, 1, 2], n
    item = "yesterday the baker saw Ann buy 5 loaves of bread and then the miller gave Ann back some 7 coins of gold"
    assert leaky(spark, item, [item.replace("Ann", "Mary Jane").replace("5", "$5").replace("7", "7%"), item.replace("Ann", "Mary, Jane").replace("bread", "cake").replace("gold", "tin").replace("baker", "boy")]) == [0]


def test_leaks_of_few_or_no_ordinary_words(spark):
    for item in ("12 + 7 = 19 and 30 - 4 = 26 and 8 / 2 = 4", "Ann Lee, Bob Ray, Cy Fox, Di Orr, Ed Poe", "5 km 3.50 kg 7% 12 h 9 m", "3 + 4", "Quito", "who was it"):
        assert leaky(spark, item, [f"So, it says: {item}, and {item}! The end", item.upper(), "The end it was 11 + 3 who"]) == [0, 1], item


def test_leaks_with_slots_that_disagree(spark):
    item = "yesterday the boy put 3 red balls and then 4 blue balls into some old box while his little sister Ann looked on and counted up to 9 then after the dinner she took out 3 balls again and gave Ann 9 of those that were left over from last week"
    same = item.replace("3 red", "5 red").replace("4 blue", "5 blue").replace("out 3", "out 5").replace("Ann", "Eve")
    once = item.replace("3 red", "7 red").replace("out 3", "out 8").replace("Ann", "Eve").replace("9", "6").replace("4", "2")
    two = " ".join(item.replace("3", a).replace("9", b).replace("4", c).replace("Ann", d) for a, b, c, d in (("11", "12", "13", "Eve"), ("21", "22", "23", "Zoe")))
    apart = item.replace("3 red", "7 red").replace("out 3", "out 8").replace("Ann looked", "Eve looked").replace("gave Ann", "gave Zoe").replace("to 9", "to 61").replace("Eve 9", "62").replace("Zoe 9", "Zoe 62")
    assert leaky(spark, item, [same, once, two, apart]) == [0, 1, 2]


FRAMES = [
    "{n} and {m} share {a} apples between them so that {n} gets {b} more than {m} does. How many apples does {m} get in the end?",
    "A train leaves {p} at {a} km an hour and another one leaves {q} {b} hours later. When do both trains meet on the way from {p} to {q}?",
    "The baker {n} sells {a} kg of flour for {b} usd a bag, while {m} from {p} asks for {c} usd. How much does {n} earn from {a} bags of flour?",
    "If {n} reads {a} pages of a book every day and {m} reads {b}, how many days after {n} will {m} have read all {c} pages of it?",
    "{n} pays {a} eur for {b} tickets to the old theatre of {p}. What would {c} tickets have cost if {m} had bought them instead?",
    "In the garden of {n} there are {a} trees that each bear {b} kg of fruit. After a storm {c} trees are gone. What can {n} still harvest?",
]
NAMES = "Anna Boris Carla David Emil Frida Gustav Helga Ivan Julia Karim Lea Mona Nils Olga Pavel".split()
PLACES = "Lisbon Vienna Oslo Prague Riga Turin Ghent Malmo".split()


def asked_again(frame, rng):
    n, m = rng.sample(NAMES, 2)
    p, q = rng.sample(PLACES, 2)
    return frame.format(n=n, m=m, p=p, q=q, a=rng.randrange(2, 99), b=rng.randrange(2, 99), c=rng.randrange(100, 999))


def test_leaks_of_reparameterised_items(spark):
    """Recall of at least 0.9 over questions with other names, places, numbers and units, in other texts; none found where there are none."""
    rng = random.Random(4)
    items = [(i, asked_again(frame, rng)) for i, frame in enumerate(FRAMES)]
    filler = lambda: " ".join(rng.choice("some words of no weight that stand around a question in a longer text".split()) for _ in range(30))
    docs, expected = [], set()
    for i in range(120):
        frame = i % len(FRAMES)
        text = asked_again(FRAMES[frame], rng).replace(" kg ", rng.choice([" kg ", " lb ", " t "])).replace(" usd", rng.choice([" usd", " eur"]))
        docs.append((i, f"{filler()}. {text} {filler()}"))
        expected.add((i, frame))
    docs += [(1000 + i, f"{filler()}. {rng.choice(NAMES)} has {rng.randrange(9)} of {filler()}") for i in range(60)]
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got <= expected and len(got) >= 0.9 * len(expected), sorted(expected - got)


def test_sieve_keeps_all_windows(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(-(1 << 63), 1 << 63, 3000)
    sieve = leaks.sieve_of(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert leaks._passes(sieve, h.view(np.uint64)).all()
    assert leaks._passes(sieve, rng.integers(0, 1 << 63, 100000).astype(np.uint64)).mean() < 1e-3


def test_mix_is_near_its_targets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mix_digest(docs.union(docs.limit(3)).repartition(7))
    again = mixing.mix_digest(docs.union(docs.limit(3)).repartition(2))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    assert got.where("taken > 2 * size or taken < 0").isEmpty()
    sums = got.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.first("source_size").alias("s"), F.sum("size").alias("z")).collect()
    total = sum(r["z"] for r in sums)
    assert all(r["s"] == r["z"] and 0 <= r["t"] - r["k"] < 1 for r in sums)
    assert sum(r["t"] for r in sums) == pytest.approx(1.5 * total)


def test_schedule_matches_brute_force(spark, monkeypatch):
    """Slots are those of the golden-ratio points; the blocks of a source, in slot order, are its documents in turn, up to its target."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    monkeypatch.setattr(mixing, "RUN_ROWS", 4)
    rng = random.Random(8)
    rows = [(None if i % 17 == 0 else i % 90, " ".join(f"d{i}w{j}" for j in range(rng.choice([0, 1, 3, 40, 90]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    targets = mixing.fill_targets(sizes.items())
    pieces = sorted(mixing.schedule(docs).collect(), key=lambda r: (r["slot"], r["place"]))
    names, whole = list(targets), sum(t for _, t in targets.values())
    edges = np.cumsum([t for _, t in targets.values()])[:-1] / whole
    slots = sum(-(-int(t + 1e-6) // 16) for _, t in targets.values())
    for r in pieces:
        point = (r["slot"] + 0.5) * mixing.GOLDEN
        assert r["slot"] >= slots or names[int(np.searchsorted(edges, point - int(point), side="right"))] == r["source"]
    texts = {}
    for d, text, source in rows:
        texts.setdefault((d, source), []).append(text.split())
    blocks = {r["slot"]: (r["source"], r["text"].split()) for r in mixing.mixed_blocks(docs).collect()}
    for source, (size, target) in targets.items():
        own = [r for r in pieces if r["source"] == source]
        said = [w for slot in sorted(blocks) if blocks[slot][0] == source for w in blocks[slot][1]]
        assert sum(r["n_words"] for r in own) == len(said) == int(target + 1e-6)
        sizes_of = [sum(r["n_words"] for r in own if r["slot"] == slot) for slot in sorted({r["slot"] for r in own})]
        assert all(n == 16 for n in sizes_of[:-1])
        assert said[size:] == said[: len(said) - size]  # the second pass is the first one over again
        once = said[:size]
        if len(once) == size:  # every word of the source, documents in one piece
            assert sorted(once) == sorted(w for (_, s), many in texts.items() if s == source for t in many for w in t)
            runs = [w.split("w")[0] for w in once]
            assert sum(a != b for a, b in zip(runs, runs[1:], strict=False)) == len(set(runs)) - 1
    taken = {}
    for r in pieces:
        taken[r["doc_id"], r["_h"], r["_copy"]] = taken.get((r["doc_id"], r["_h"], r["_copy"]), 0) + r["n_words"]
    assert {k: v for k, v in taken.items()} == {(r["doc_id"], r["_h"], r["_copy"]): r["taken"] for r in mixing.mix(docs).where("taken > 0").collect()}


def test_targets():
    got = mixing.fill_targets([("b", 10), (None, 100), ("a", 10)])
    assert got == {"a": (10, 20.0), "b": (10, 20.0), None: (100, 140.0)}


def test_tiff_codecs_and_pages(spark):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 6, (70, 50), np.uint8), np.zeros((3, 40, 3), np.uint8), rng.integers(0, 256, (300, 260), np.uint8)]
    for compression in tiff.PACK:
        for tile in (None, 16):
            for predictor in (1, 2):
                blob = tiff.write_tiff(pages, compression, predictor, tile)
                back = [tiff.read_page(blob, tags) for _, tags in tiff.directories(blob)]
                assert all(np.array_equal(a.reshape(b.shape), b) for a, b in zip(pages, back, strict=True)), (compression, tile, predictor)
    bad = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HI", 0, 8)

    def one_page(*tags):
        return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + b"\0" * 8

    plain = [(tiff.WIDTH, 4), (tiff.LENGTH, 4), (tiff.BITS, 8)]
    halved = one_page(*plain, (tiff.TILE_WIDTH, 16), (tiff.TILE_OFFSETS, 8), (tiff.TILE_COUNTS, 4))  # a tile without its length
    huge = one_page((tiff.WIDTH, 4_000_000), (tiff.LENGTH, 4_000_000), (tiff.BITS, 8), (tiff.STRIP_OFFSETS, 8), (tiff.STRIP_COUNTS, 4))
    vast = one_page((tiff.WIDTH, 1 << 31), (tiff.LENGTH, 1 << 31), (tiff.BITS, 8), (tiff.ROWS_PER_STRIP, 1), (tiff.STRIP_OFFSETS, 8), (tiff.STRIP_COUNTS, 4))
    flat = one_page(*plain, (tiff.ROWS_PER_STRIP, 0), (tiff.STRIP_OFFSETS, 8), (tiff.STRIP_COUNTS, 4))
    frame = spark.createDataFrame([(1, blob), (2, b"junk"), (3, None), (4, bad), (5, halved), (6, huge), (7, vast), (8, flat), (9, blob[:-9])], "id long, media binary")
    rows = tiff.read_pages(frame, ["id"]).collect()
    assert [r["page"] for r in rows if r["id"] == 1] == [0, 1, 2]
    assert {r["id"] for r in rows if r["error"]} == {2, 3, 4, 5, 6, 7, 8, 9}
    assert tiff.read_pages(frame.where("false"), ["id"]).count() == 0


def test_tiff_digest(spark):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall() + [(-1, None), (-2, "x" * 64), (-3, LONG)]
    got = {r["doc_id"]: r for r in tiff.media_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, text in rows:
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (got[key]["n_bytes"], got[key]["payload_bytes"], got[key]["payload_sha256"], got[key]["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        file = tiff.write_tiff([np.frombuffer(padded, np.uint8).reshape(-1, 64)], *tiff.LAYOUTS[zlib.crc32(raw) % len(tiff.LAYOUTS)])
        assert (got[key]["media_bytes"], got[key]["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        bins = [sum(x >> 5 == b for x in padded) for b in range(8)]
        assert got[key]["feature"] == f"64x{len(padded) // 64}x1;mean={sum(padded) / len(padded):.4f};bins={'/'.join(map(str, bins))}"


def test_chat_escapes(spark):
    rows = [(1, 0, "user", "a\\"), (1, 1, "assistant", "</turn>\n### user:\nx"), (1, 1, "assistant", None), (1, None, None, ":\n"), (2, 0, "assistant", ""), (3, 0, "a:\n\\", "t"), (None, 0, "assistant", LONG)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digest(turns).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        expected = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), expected, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digest(turns.where("false")).count() == 0
    assert {"n_turns": 2}.items() <= {r["conv_id"]: r.asDict() for r in chat.chat_digest(chat.with_probe(turns)).collect()}[-7].items()


def test_warc_reader_refuses_damage(spark):
    page = b"<p>hello</p>" * 200
    digest = hashlib.sha1(page).hexdigest()
    records = [warc.write_record(i, f"http://a/{i}\n", digest, len(page), None, page) for i in range(40)]
    archive = warc.write_archive(records)
    assert struct.unpack_from("<I", archive)[0] == warc.DICTIONARY_MAGIC and list(warc.read_archive(archive)) == records
    assert warc.read_record(records[3])[:4] == (3, "http://a/3\n", "response", None)
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_archive(archive[:-3]))
    with pytest.raises(ValueError, match="content length"):
        warc.read_record(records[0] + b"x")
    other = b32encode(hashlib.sha1(b"").digest())
    with pytest.raises(ValueError, match="digest"):
        warc.read_record(records[0].replace(b32encode(bytes.fromhex(digest)), other))
    frame = spark.createDataFrame([("a", archive[:-3]), ("b", b""), ("c", None)], "archive string, content binary")
    assert warc.read_archives(frame).where("error is not null").count() == 1


def test_warc_reader_gives_a_row_for_what_it_cannot_read(spark):
    import zstandard

    skip = lambda body: struct.pack("<II", warc.DICTIONARY_MAGIC, len(body)) + body
    held = zstandard.ZstdCompressor().compress(b"words " * 400)
    page = warc.write_record(1, "u", hashlib.sha1(b"x").hexdigest(), 1, None, b"x")
    revisit = warc.write_record(1, "u", hashlib.sha1(b"x").hexdigest(), 1, 7, b"")
    frame = zstandard.ZstdCompressor().compress
    bad = [skip(held[:20] + b"\xff" * 9 + held[29:]) + frame(page), skip(held[:-9]) + frame(page), skip(b"\x37\xa4\x30\xec" + b"\x00" * 40) + frame(page)]
    bad += [frame(page.replace(b"X-Page-ID: 1", b"X-Page-ID: 99999999999999999999")), frame(revisit.replace(b"X-Payload-Length: 1", b"X-Payload-Length: 99999999999999999999")), frame(page.replace(b"X-Page-ID: 1", b"X-Page-ID: one"))]
    archives = spark.createDataFrame([(str(i), b) for i, b in enumerate([*bad, frame(page)])], "archive string, content binary")
    rows = warc.read_archives(archives).collect()
    assert len(rows) == len(bad) + 1 and sum(r["error"] is not None for r in rows) == len(bad)


def test_warc_records_of_one_id_have_names_of_their_own():
    names = {warc.record_id(None, hashlib.sha1(x).hexdigest()) for x in (b"a", b"b")} | {warc.record_id(1, hashlib.sha1(b"a").hexdigest())}
    assert len(names) == 3
    assert b"WARC-Target-URI: http://a/%C3%A9\r\n" in warc.write_record(1, "http://a/é", hashlib.sha1(b"").hexdigest(), 0, None, b"")


def test_language_sample_is_bounded(spark):
    rows = [(1, f"text number {i} of one id", "en") for i in range(1500)] + [(3, "les mots", "fr")] * 40 + [(4, "x" * (language.SAMPLE_CHARS + 9), "de")]
    got = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 64)
    assert sum(lang == "en" for lang, _ in got) <= 64 and sum(lang == "fr" for lang, _ in got) == 1
    assert max(len(t) for _, t in got) <= language.SAMPLE_CHARS


def foreign(kind, block, *more):
    head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", "WARC-Target-URI: http://e.org/caf%C3%A9?q=a%2Fb", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.0", *head, "", ""]).encode() + block + b"\r\n\r\n"


def test_warc_records_of_others():
    http = "Content-Type: application/http; msgtype=response"
    page = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"
    sha = hashlib.sha1(b"hello").digest()
    own = (None, "http://e.org/caf%C3%A9?q=a%2Fb")
    assert warc.read_record(foreign("response", page, http)) == (*own, "response", None, b"hello", 5, sha.hex())
    assert warc.read_record(foreign("response", page, http, f"WARC-Payload-Digest: sha1:{sha.hex()}"))[4] == b"hello"
    assert warc.read_record(foreign("response", page, http, "WARC-Payload-Digest: sha256:00", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>", "X-Long: a\r\n b"))[4] == b"hello"
    assert warc.read_record(foreign("request", b"GET / HTTP/1.1\r\nHost: e.org\r\n\r\n", "Content-Type: application/http; msgtype=request"))[2:5] == ("request", None, b"")
    assert warc.read_record(foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"))[2:5] == ("warcinfo", None, b"software: x\r\n")
    for wrong in (foreign("response", page, http, f"WARC-Payload-Digest: sha1:{'0' * 40}"), foreign("response", page, f"WARC-Block-Digest: sha1:{'0' * 40}"), foreign("response", page, "A: 1", "A: 2"), foreign("response", b"no header", http)):
        with pytest.raises(ValueError):
            warc.read_record(wrong)


@pytest.mark.parametrize("url", ["http://a/b", "http://a/b%20c?d=%2F", "http://ä/é ü\n%", "", None])
def test_warc_urls_come_back(url):
    digest = hashlib.sha1(b"x").hexdigest()
    assert warc.read_record(warc.write_record(1, url, digest, 1, None, b"x"))[1] == url


def test_warc_reads_in_proportion_to_its_size():
    payload = random.Random(1).randbytes(20_000)
    record = warc.write_record(1, "u", hashlib.sha1(payload).hexdigest(), len(payload), None, payload)
    archive = warc.write_archive([record] * 1500)  # 30 MB that do not compress; copies of the rest for each record would be 22 GB
    assert sum(r == record for r in warc.read_archive(archive)) == 1500


def test_warc_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, payload string")
    assert warc.warc_digest(none).count() == 0 and warc.read_archives(warc.write_archives(none)).count() == 0


def test_warc_ties(spark):
    big = "z" * 1200
    rows = [(1, "u", big), (2, None, big), (2, "u", big), (None, "u", big), (3, "u", None), (4, "u", "z" * 900), (5, "u", "z" * 900)]
    got = warc.warc_digest(spark.createDataFrame(rows, "page_id long, url string, html string"))
    kinds = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got.collect()), key=repr)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None)]


def test_html():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site to serve you better. Accept them all.</p></div>
    <article><h1>On &amp; off</h1><p>First  para&nbsp;graph,
    long enough to be content of the page.</p><div class="ad">Buy now. Buy a lot of it today.</div><p>Second <b>one</b>.</p><form><p>Your mail</p></form></article>
    <section id="comments"><p>Nice article, I have read it twice and liked it a lot!</p></section>
    <aside><p>Related reading about many things that happen.</p></aside><script>if (a < b) "</p>"</script><footer>&copy; 2020</footer></body></html>"""
    assert html.main_text(page) == "On & off\nFirst para graph, long enough to be content of the page.\nSecond one."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""


def test_minimum_cut():
    assert html.minimum_cut([3.0, -1.0, 3.0], [(0, 1, 1.0, 1.0), (1, 2, 1.0, 1.0)]) == [True, True, True]
    assert html.minimum_cut([3.0, -5.0, 3.0], [(0, 1, 1.0, 1.0), (1, 2, 1.0, 1.0)]) == [True, False, True]
    assert html.minimum_cut([], []) == []


def cost_of(side, leans, edges):
    return sum(abs(x) for x, s in zip(leans, side, strict=True) if (x > 0) != s) + sum(there * (side[a] and not side[b]) + back * (side[b] and not side[a]) for a, b, there, back in edges)


def test_minimum_cut_costs_least():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randrange(1, 9)
        leans = [rng.choice([-4.0, -1.5, -0.5, 0.0, 0.3, 1.0, 3.0]) for _ in range(n)]
        edges = [(*rng.sample(range(n), 2), rng.choice([0.0, 0.5, 4.0]), rng.choice([0.0, 1.0])) for _ in range(rng.randrange(12))] if n > 1 else []
        least = min(cost_of([bool(k >> i & 1) for i in range(n)], leans, edges) for k in range(1 << n))
        assert cost_of(html.minimum_cut(leans, edges), leans, edges) == pytest.approx(least)


def test_labels_are_a_cut_of_least_cost():
    """On random pages of up to 10 nodes, against all labellings of their graphs."""
    rng = random.Random(7)
    tags = ['<div class="comments">', "<article>", "<div>", "<aside>", '<div class="post share">']
    for _ in range(120):
        page = "".join(rng.choice(tags) + "".join(rng.choice(["<p>Short</p>", f"<p>{'A longer sentence of the page. ' * 6}</p>", "<p><a href=x>link</a></p>"]) for _ in range(rng.randrange(1, 3))) + rng.choice(["", "</div></article></aside>"]) for _ in range(rng.randrange(1, 4)))
        read = html.parsed(page)
        leans, edges = html.graph(read)
        if len(leans) <= 12:
            least = min(cost_of([bool(k >> i & 1) for i in range(len(leans))], leans, edges) for k in range(1 << len(leans)))
            assert cost_of(html.minimum_cut(leans, edges), leans, edges) == pytest.approx(least)


def test_the_cut_decides():
    """Blocks whose own text says otherwise follow what is around them."""
    prose = "This is a whole sentence of some length that looks like content, and another clause follows it to the end."
    page = html.parsed(f'<div class="comments"><div><p>{prose}</p><p>{prose}</p></div></div><article><h2>Part</h2><p>{prose}</p><p>All rights reserved.</p></article>')
    own = [html.score(b) > 0 for b in page.blocks]
    assert own == [True, True, False, True, False] and html.label(page) == [False, False, True, True, True]
    shop = html.parsed(f'<div class="article-body shared-box"><p>{prose}</p></div><div class="share article"><p>Mail</p></div>')
    assert html.label(shop) == [True, False]
    pages = duckdb.sql(f"select html from '{DATA.replace('0.001', '0.01')}/pages.parquet'").fetchall()
    changed = total = 0
    for (raw,) in pages:
        read = html.parsed(raw or "")
        changed += sum((html.score(b) > 0) != content for b, content in zip(read.blocks, html.label(read), strict=True))
        total += len(read.blocks)
    assert 0 < changed < total


PROSE = "This is a long paragraph of an article that says quite a lot of things, and goes on for some time so that it is content."
READER = f"<p>{PROSE} COMMENT</p>"


@pytest.mark.parametrize(("page", "blocks"), [
    (f"<article><p>{PROSE}</p><ul><li>Apples</li><li>Pears</li></ul><p>{PROSE}</p></article>", [PROSE, "Apples", "Pears", PROSE]),
    (f"<article><p>{PROSE}</p><table><tr><th>Year</th><td>1999</td></tr></table><dl><dt>Term</dt><dd>Def</dd></dl><figure><figcaption>A cap</figcaption></figure></article>", [PROSE, "Year", "1999", "Term", "Def", "A cap"]),
    (f"<article><p>{PROSE}</p><p>No end here</p><div>Short words</div><p><a href=x>mostly a link of words here</a> ok</p><p>{PROSE}</p></article>", [PROSE, "No end here", "Short words", "mostly a link of words here ok", PROSE]),
    (f"<article><header><h1>My title</h1></header><p>{PROSE}</p></article>", ["My title", PROSE]),
    (f"<article><p>{PROSE}</p></article><section id=comments><div class='post-body'>{READER}</div></section>", [PROSE]),
    (f"<article><p>{PROSE}</p><section id=comments><div class='entry-content'>{READER}{READER}</div></section></article>", [PROSE]),
    (f"<article><p>{PROSE}</p></article><footer><div class=text>{READER}</div></footer>", [PROSE]),
    (f"<article><p>{PROSE}</p></article><div class=reader-opinions>{READER}</div>", [PROSE]),
    (f"<article><p>{PROSE}</p><p>{PROSE}</p></article><div class=unheard-of>{READER}</div>", [PROSE, PROSE]),
    (f"<article><p>{PROSE}</p><div class='ad'>{READER}</div><p>{PROSE}</p></article>", [PROSE, PROSE]),
    (f"<main><p>{PROSE}</p><p>{PROSE}</p><aside>{READER}{READER}</aside></main>", [PROSE, PROSE]),
    (f"<div class='nav'>a b</div><div class='content with-sidebar'><h1>Title here</h1><p>{PROSE}</p><ul><li>One</li></ul><div class='sidebar'>{READER}</div></div>", ["Title here", PROSE, "One"]),
    (f"<body><p>{PROSE}</p><p>{PROSE}</p></body>", [PROSE, PROSE]),
])
def test_html_pages(page, blocks):
    assert html.main_text(page).split("\n") == blocks


@pytest.mark.parametrize("page", ["<b>" * 20000, "<div>" * 5000 + "</p></i>" * 11000, "<b>x" * 20000, "<p>" * 20000, "<b><p>" * 8000, "<a><div>" * 8000])
def test_html_takes_time_in_proportion(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 3


def test_html_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    good = "<article><p>Some words of content, and more of them here.</p></article>"
    rows = [(1, "u", None, "x", "y"), (None, None, good, None, None), (1, "u", "", "x", "y"), (None, None, good, None, None)]
    got = html.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 45, 45]
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
    long = "<article>" + "<div><p>Some words of content, and more of them here.</p><ul><li><a href=x>Home</a></li></ul></div>" * 5000 + "</article>" + "<div>" * 5000 + "<a>x" * 2000
    assert html.extract(spark.createDataFrame([(1, "u", long, "", "")], schema)).first()["text"].count("Some words") == 5000


def pipeline_brute(docs, items):
    from corpus_pipeline import LINE_DOCS

    kept = [d for d in docs if d[1] and any(map(str.isalpha, d[1]))]
    first, holders = {}, {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for d in sorted(kept):
        for line in d[1].split("\n"):
            first.setdefault(key(line), d[0])
            holders.setdefault(key(line), set()).add(d[0])
    out = []
    for d in kept:
        stays = [x for x in d[1].split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < LINE_DOCS or first[key(x)] == d[0]]
        if stays:
            out.append((d[0], "\n".join(stays)))
    groups = near_brute(dict(out), 5)
    return {d: t for d, t in out if groups[d][1] == d and not any(i[1] in t for i in items)}


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA)
    docs = duckdb.sql(f"select doc_id, text, source from '{DATA}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select * from '{DATA}/benchmark.parquet'").fetchall()
    expected = pipeline_brute([d[:2] for d in docs], items)
    rows = got.collect()
    found = {r["doc_id"]: r["text"] for r in rows}
    assert found.items() <= expected.items()
    sources, sizes = {d: s for d, _, s in docs}, {}
    for d, text in expected.items():
        sizes[sources[d]] = sizes.get(sources[d], 0) + len(text.split())
    targets = mixing.fill_targets(sizes.items())
    taken = {}
    for r in rows:
        assert (r["source_size"], r["target"]) == pytest.approx(targets[r["source"]]) and 0 < r["taken"] <= 2 * r["size"] == 2 * len(r["text"].split())
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert taken == {s: int(t + 1e-6) for s, (_, t) in targets.items() if t >= 1}
    full = {s for s, (size, target) in targets.items() if target >= size}  # the mix reaches all documents of these
    assert full and not [d for d in expected.keys() - found.keys() if sources[d] in full and expected[d].split()]


def test_stages_of_awkward_rows(spark):
    import corpus_pipeline

    docs = docs_of(spark, AWKWARD)
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.where("false")):
            out = stage(spark, rows, DATA)
            if name == "mixing":
                assert set(docs.columns) <= set(out.columns) and out.select(*docs.columns).count() <= rows.count()
            else:
                assert out.columns == docs.columns, name
            kept = {r["doc_id"] for r in out.collect()}
            assert kept == {"language_id": {3, 4, 5, 8, None}, "line_dedup": {1, 2, 3, 4, 5, 6, 7, 8, None}, "near_dedup": {1, 2, 3, 4, 6, 7, 8, None}, "decontamination": {1, 2, 3, 4, 5, 6, 7, 8, None}, "mixing": {3, 4, 5, 7, 8, None}}[name] if rows is docs else kept == set(), name
    same = {r["kept_text"] for r in corpus_pipeline.unrepeated(spark, docs, DATA).collect()}
    assert same == {1}  # the table's own column of that name


def test_leaks_with_units_and_numbers_in_letters(spark):
    item = "A train goes 60 km in 2 h before it stops for water at the bridge. How far does it go in twelve hours at this pace?"
    other = "A train goes fifty miles in 3 hours before it stops for water at the bridge. How far does it go in 11 days at this pace?"
    most = "A train goes two hundred feet in twenty-five seconds before it stops for water at the bridge. How far does it go in 3 million years at this pace?"
    assert leaky(spark, item, [other, most, other.replace("train", "boat").replace("stops", "halts").replace("bridge", "harbour").replace("far", "long").replace("pace", "price").replace("goes", "sails"), item.upper()]) == [0, 1, 3]
    assert leaky(spark, other, [item, most]) == [0, 1]


SCRIPTS = [
    ("У {n} было {a} яблок, и половину из них {n} отдал соседу по имени {m} в городе {p}. Сколько яблок осталось у {n} после этого?", "Иван Ольга Борис Пётр Елена Юрий", "Киеве Москве Риге"),
    ("Η {n} έχει {a} μήλα και δίνει τα μισά από αυτά στον γείτονα {m} στην πόλη {p}. Πόσα μήλα έμειναν τότε στο καλάθι της {n};", "Άννα Ελένη Μαρία Νίκη Σοφία Όλγα", "Αθήνα Πάτρα Λάρισα"),
    ("{n} má {a} jablek a polovinu z nich dá sousedovi, který se jmenuje {m} a bydlí ve městě {p}. Kolik jablek pak {n} ještě má?", "Šárka Čeněk Žofie Řehoř Ďurko Ľudmila", "Žilina Říčany Šumperk"),
    ("{n} có {a} quả táo và cho người hàng xóm tên là {m} ở thành phố {p} một nửa số đó. Hỏi sau đó {n} còn lại bao nhiêu quả?", "Ánh Đức Ổi Ẩn Ước Ý Ngọc", "Huế Vinh Quảng"),
]


def test_leaks_in_other_scripts(spark):
    """Recall of at least 0.9 with names and numbers of other scripts, in small letters and capitals as well; other questions are not found."""
    rng = random.Random(5)
    items, docs, expected = [], [], set()
    ask = lambda frame, names, places: frame.format(a=rng.randrange(2, 99), p=rng.choice(places.split()), **dict(zip("nm", rng.sample(names.split(), 2), strict=True)))
    for i, script in enumerate(SCRIPTS):
        items.append((i, ask(*script)))
        for j in range(12):
            docs.append((len(docs), f"{ask(*script)} And more."))
            expected.add((len(docs) - 1, i))
        for change in (str.upper, str.lower):
            docs.append((len(docs), change(items[i][1])))
            expected.add((len(docs) - 1, i))
        docs.append((len(docs), " ".join(rng.sample(items[i][1].split(), len(items[i][1].split())))))
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got <= expected and len(got) >= 0.9 * len(expected), sorted(expected - got)


@pytest.mark.parametrize("text", ["ÀÉÎ Öß", "Ελλάδα ΣΟΦΊΑ", "Щука Ёж", "Đức ẤN Ộ", "Ａｂ", "İK ẞ", "日本 x", "𐐀𐐁 a", "ÿ"])
def test_capitals_of_any_script(text):
    """Words hash as those of the text in small letters, as far as these take as many bytes."""
    small = "".join(c.lower() if len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) and ord(c) < 0x10000 else c for c in text)
    of = lambda t: leaks.words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    assert of(text).words.tolist() == of(small).words.tolist()


def test_pipeline_writes_the_mix(spark, tmp_path):
    """The blocks hold the words that the last stage says were taken, each slot once, all full but for one a source."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA, str(tmp_path))
    blocks = corpus_pipeline.blocks(spark, str(tmp_path))
    n = blocks.count()
    assert blocks.columns == ["slot", "source", "text"] and blocks.select("slot").distinct().count() == n > 0
    counted = blocks.select("source", F.size(F.split("text", " ")).alias("n"))
    assert counted.where(F.col("n") > mixing.BLOCK_WORDS).isEmpty()
    assert counted.where(F.col("n") < mixing.BLOCK_WORDS).groupBy("source").count().where("count > 1").isEmpty()
    assert sorted(map(tuple, counted.groupBy("source").agg(F.sum("n")).collect()), key=str) == sorted(map(tuple, got.groupBy("source").agg(F.sum("taken")).collect()), key=str)
    own, kept = (set(" ".join(r["text"] for r in df.select("text").collect() if r["text"]).split()) for df in (blocks, got))
    assert own and own <= kept  # the last document of a source may be taken in part
    corpus_pipeline.run(spark, DATA, str(tmp_path))  # a second run into the folder takes the place of the first
    assert corpus_pipeline.blocks(spark, str(tmp_path)).count() == n


def test_blocks_of_awkward_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (None, "x y", None), (3, "  p\u00a0q\tr\n", "b"), (3, "s " * 5000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {(r["slot"], r["source"]): r["text"] for r in mixing.mixed_blocks(docs).collect()}
    words = [w for (_, source), text in texts.items() if source == "b" for w in text.split(" ")]
    assert set(words) <= {"p\u00a0q", "r", "s"} and all(len(t.split(" ")) <= mixing.BLOCK_WORDS for t in texts.values())
    assert sum(len(t.split(" ")) for t in texts.values()) == mixing.mix_digest(docs).agg(F.sum("taken")).first()[0]
    assert mixing.mixed_blocks(docs.where("false")).isEmpty()
