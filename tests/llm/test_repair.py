"""Repair of conversations: against every sequence of edits, DuckDB, and conversations over many blocks."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from millrace.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHING = ("*", "1 as idx", "2 as n", "'x' as audit", "4 as block", "'z' as head", "5 as cost")
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        role = "user" if fate == 4 else role
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(c, t, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All edits of each turn with up to two insertions before it and at the end."""
    best = None
    choices = [("D",)] if not rows else None
    for edits in itertools.product(*[[x for x in ("K", "Ru", "Ra", "D") if x == "D" or f not in ("blank", "duplicate")] for f in found]):
        cost = sum({"K": 0, "D": 2}.get(e, 1) + 5 * (f == "truncated" and e != "D") for e, f in zip(edits, found))
        for put in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            if best and cost + 5 * len("".join(put)) > best[0]:
                continue
            audit, turns = "", []
            for (_, _, role, text), e, before in zip(rows, edits, put):
                turns += [("user" if x == "u" else "assistant", "") for x in before]
                audit += "I" * len(before) + e[0]
                turns += [] if e == "D" else [({"K": role, "Ru": "user", "Ra": "assistant"}[e], text)]
            turns += [("user" if x == "u" else "assistant", "") for x in put[-1]]
            audit += "I" * len(put[-1])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in turns)):
                answer = (cost + 5 * len("".join(put)), audit, "\n".join(f"{r}:{t}" for r, t in turns))
                best = min(best, answer) if best else answer
    return best if choices is None else (0, "", "")


def brute(rows):
    talks = {r[0]: [] for r in rows}
    for r in damage(rows):
        talks[r[0]].append(r)
    out = []
    for c, mine in talks.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        found = faults(mine)
        turns = {r[1] for r in mine} - {None}
        cost, audit, said = cheapest(mine, found)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(rng, c, n):
    texts = ["Yes.", "No!", "cut off", "", " \t", "What?  ", "Ünïcode 文.", "two\nlines."]
    return [(c, rng.choice([i, i, i, i * 3, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice([*texts, f"t{i}.", f"t{i}.", None])) for i in range(n)]


@pytest.mark.parametrize("block", [512, 2])
def test_every_sequence_of_edits(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "BRANCHES", 2)
    rng = random.Random(7)
    rows = [r for c in range(60) for r in talk(rng, None if c == 3 else c, rng.randrange(1, 5))]
    got = repair.repair_digest(spark.createDataFrame(rows, SCHEMA).selectExpr(*CLASHING))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("block", [512, 16])
def test_long_conversations_match_sql(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "BRANCHES", 4)
    rng = random.Random(8)
    rows = [r for c, n in enumerate([700, 40, 1, 16, 17, 33]) for r in talk(rng, c if c else None, n)] + [r for c in range(50, 90) for r in talk(rng, c, 12)]
    turns = spark.createDataFrame(rows, SCHEMA)
    turns.write.parquet(f"{tmp_path}/turns")
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/turns/*.parquet'")
    got = [tuple(r) for r in repair.repair_digest(turns).collect()]
    assert sorted(got, key=repr) == sorted(duck.sql(repair.DIGEST_SQL).fetchall(), key=repr)


def test_grammar_is_shared(spark):
    strings = spark.createDataFrame([("suauaua" * 20,), ("suauauauaua",), ("ua",), ("-",)], "signs string")
    rules = repair.grammar(strings)
    assert "ua" in rules and any(ord(x) >= repair.FIRST_SYMBOL for pair in rules for x in pair)
    for r in repair.solved(strings, rules).collect():
        m = repair.of_sign(r["signs"][0])
        for sign in r["signs"][1:]:
            m = repair.product(m, repair.of_sign(sign))
        assert (r["cost"], r["audit"]) == repair.finished(m)
        assert [x and tuple(x) for x in r["matrix"]] == [x and tuple(x.values()) for x in repair.packed(m)]


def test_repaired_turns_and_empty_tables(spark):
    rng = random.Random(9)
    rows = [r for c in range(20) for r in talk(rng, c, 6)]
    turns = spark.createDataFrame(rows, SCHEMA)
    said = {}
    for r in sorted(repair.repaired_turns(turns).collect(), key=lambda r: (r["conv_id"], r["place"])):
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.repair_digest(turns).collect():
        assert hashlib.sha256("\n".join(said.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
    assert repair.repair_digest(turns.where("false")).count() == 0
    far = spark.createDataFrame([(1, -(2**63), "user", "Hi."), (1, 2**63 - 1, "assistant", "Yes.")], SCHEMA)
    assert [r["gaps"] for r in repair.repair(far).talks.collect()] == [None]
