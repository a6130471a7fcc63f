"""Personal data: base spans against the plain patterns, the tagger against brute force and on unseen forms, windows against the whole."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from millrace.llm import pii

DATA = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = "".join(str(int(c) * (1 + i % 2)) if int(c) * (1 + i % 2) < 10 else str(int(c) * 2 - 9) for i, c in enumerate(digits[::-1]))
            good = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and sum(map(int, twice)) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 200"))


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]


def test_base_spans_match_the_plain_patterns(texts):
    rng = random.Random(4)
    awkward = ["".join(rng.choice("a1.@- +()9\n5é") for _ in range(rng.randrange(60))) for _ in range(4000)]
    awkward += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "001.02.255.0", "1.2.3.256", "4111 1111-1111 1111", "+1 (132) 555-1352", "x@@y.z@w.v", "@a.b", ""]
    for text in awkward + texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_little_time():
    for text in ("a" * 400_000, "1" * 100_000 + ".", "a@" * 50_000, "+" * 100_000, "1.2.3." * 40_000, "12 " * 80_000):
        pii.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(2)
    model = pii.Tagger(1)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    x, y = rng.integers(0, pii.CODES, (3, 7)), np.zeros((3, 7), int)
    y[0, 2:4], y[1, 5], y[2, 0] = (1, 2), 7, 4
    _, grads = model.loss(x, y)
    for name, p in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            kept, losses = p[at], []
            for step in (1e-4, -1e-4):
                p[at] = kept + step
                losses.append(model.loss(x, y)[0])
            p[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-4 - grads[name][at]) < 1e-5, name


def test_viterbi_against_all_tags():
    model = pii.Tagger(5)
    rng = np.random.default_rng(3)
    model.p["A"] = rng.standard_normal(model.p["A"].shape).astype(np.float32)
    x = rng.integers(0, pii.CODES, (5, 4))
    e, (tags, _) = model.emissions(x), model.decode(x)
    for n in range(5):
        score = lambda y: sum(e[t, n, k] for t, k in enumerate(y)) + sum(model.p["A"][a, b] if pii.ALLOWED[a, b] else -1e9 for a, b in itertools.pairwise(y))  # noqa: E731, B023
        best = max(itertools.product(range(pii.TAGS), repeat=4), key=score)
        assert abs(score(best) - score(tags[n])) < 1e-3


def test_reconciling_against_all_sets():
    rng = random.Random(6)
    for _ in range(300):
        spans = [(a, a + rng.randrange(1, 6), rng.choice(pii.KINDS), rng.random()) for a in (rng.randrange(20) for _ in range(rng.randrange(8)))]
        base = [(a, a + 2, "ip") for a in rng.sample(range(25), rng.randrange(3))]
        got = pii.reconciled(base, spans)
        apart = lambda s: all(x[1] <= y[0] for x, y in itertools.pairwise(sorted(s)))
        free = [s for s in spans if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
        best = max((sum(s[3] for s in some) for n in range(len(free) + 1) for some in itertools.combinations(free, n) if apart(some)), default=0)
        added = [s for s in got if s not in base]
        assert set(base) <= set(got) and apart(added)
        assert abs(sum(max(x[3] for x in free if x[:3] == s) for s in added) - best) < 1e-9


def test_unseen_forms_are_found_and_other_numbers_left_alone(model, texts):
    rng = random.Random(77)
    rows, found, wrong = [], {}, 0
    for _ in range(600):
        ground = " ".join(rng.choice(texts)[:400].split(" ")[:30])
        kind = rng.choice([*pii.KINDS, ""])
        said = pii.rewritten(pii.fresh(kind, rng), kind, rng) if kind else pii.unrelated(rng)
        rows.append((f"{ground} {said} and {ground}", (len(ground) + 1, len(ground) + 1 + len(said), kind)))
    for (text, true), (base, spans) in zip(rows, pii.tag_texts(model, [r[0] for r in rows]), strict=True):
        added = [s for s in spans if s not in base and not any(s == b for b in plain_spans(text))]
        if true[2] and true not in base:
            hits = found.setdefault(true[2], [0, 0])
            hits[0] += true in added
            hits[1] += 1
        wrong += sum(s != true for s in added)
    assert all(a >= 0.8 * n for a, n in found.values()), found
    assert wrong <= 6, wrong


def test_clean_texts_stay_clean(model, texts):
    for text, (base, spans) in zip(texts, pii.tag_texts(model, texts), strict=True):
        assert base == plain_spans(text) and spans == base


def test_windows_of_a_text_are_those_of_any_batch(model, texts):
    rng = random.Random(8)
    long = " ".join(t + " " + pii.rewritten(pii.fresh(k, rng), k, rng) for t, k in zip(texts[:60], pii.KINDS * 15, strict=True))
    some = ["", long, "no digits", long[: len(long) // 3], "mail me: jo (at) mail (dot) org"]
    together = list(pii.tag_texts(model, some))
    assert [next(iter(pii.tag_texts(model, [t]))) for t in some] == together
    assert len(together[1][1]) > len(together[1][0])


def test_rows(spark, model, texts):
    rows = [(1, None), (2, ""), (None, "jo@mail.org"), (3, "jo@mail.org, 10.0.0.1, 4111111111111111, +1 (132) 555-1352"), (3, "x"), (4, "word " * 30000 + "a@b.c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as base", "'x' as n_ip")
    got = pii.find_personal(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {(3, 4): rows[3][1], (4, 1): rows[5][1], (None, 1): rows[2][1]}.get((r["doc_id"], sum(r[f"n_{k}"] for k in pii.KINDS)), "")
        assert r["base"] == pii.listed(plain_spans(text)) and set(r["base"].split(",")) <= set(r["spans"].split(","))
    assert pii.find_personal(docs.where("false"), model).count() == 0
    assert pii.masked("mail jo@mail.org now", pii.base_spans("mail jo@mail.org now")) == "mail <email> now"


def test_query_over_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.personal_digest(docs).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        r, spans = got[doc_id], plain_spans(text)
        assert r["base_sha256"] == hashlib.sha256(pii.listed(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in spans) for k in pii.KINDS]


def test_fit_without_rows(spark, monkeypatch):
    monkeypatch.setattr(pii, "MADE_WINDOWS", 48)
    monkeypatch.setattr(pii, "PASSES", 1)
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert pii.find_personal(docs).count() == 1 and pii.find_personal(docs.where("false")).count() == 0
