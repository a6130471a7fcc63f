r"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Each turn becomes one sign of its role's initial and its fault. The conversations' strings of signs, in blocks of bounded length, are
compressed by a Re-Pair grammar: rounds of the most frequent adjacent pairs of all distinct strings, each replaced by a symbol of its own.
A symbol stands for a min-plus matrix over the states of the role grammar, whose entries are a cost and the audit of edits that has it, held as
a rope; a rule's matrix is the product of its two symbols', made once, from the rules below it up. A distinct string is the product
of the symbols left in it, whichever conversations share it, and a long conversation the product of its blocks, in a tree.

Letters of an audit: K keeps, R renames to user or assistant, D deletes, I inserts a turn without text. Of equally cheap audits the least by letters
counts. Audits of equal cost are never one the other's beginning (an insertion costs more than nothing), so the least of a whole is made
of the least of its parts, and the products keep it. An audit decides the repaired turns: K, R and D take the turns in order, and after
any turn but a first system turn the role to come is set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import BLANKS
from .merkle import CRC_SQL
from .shared import numbered, stored

#: Turns of a block, blocks that a task multiplies at a time.
BLOCK, BRANCHES = 512, 64
#: Rounds of the grammar, and new symbols per round at most. They set how much is shared, not what comes out.
ROUNDS, PER_ROUND = 6, 16
#: First of the grammar's symbols: a private range of characters.
FIRST_SYMBOL = 0xE000

DROP, RENAME, INSERT, CUT = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: States that an initial leads to.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (START, ASSISTANT)
SIGNS = "suaxSUAX-"
MATRIX = "array<struct<cost:bigint,audit:string>>"


class Rope:
    """A string kept as the two ropes it is made of."""

    __slots__ = ("parts", "text")

    def __init__(self, text: str | None, *parts: Rope) -> None:
        self.text, self.parts = text, parts

    def __str__(self) -> str:
        if self.text is None:
            out, todo = [], [self]
            while todo:
                x = todo.pop()
                if x.text is None:
                    todo += reversed(x.parts)
                else:
                    out.append(x.text)
            self.text, self.parts = "".join(out), ()
        return self.text


NOTHING = Rope("")
Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def joined(a: Rope, b: Rope) -> Rope:
    return b if a is NOTHING else a if b is NOTHING else Rope(None, a, b)


def least(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    return a if a[0] < b[0] or (a[0] == b[0] and str(a[1]) <= str(b[1])) else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        made: list[Entry] = [None] * len(b)
        for x, after in zip(row, b, strict=True):
            if x:
                for j, y in enumerate(after):
                    if y and ((z := made[j]) is None or z[0] >= x[0] + y[0]):
                        made[j] = least(z, (x[0] + y[0], joined(x[1], y[1])))
        out.append(made)
    return out


def _edge(out: Matrix, i: int, j: int, cost: int, letter: str) -> None:
    out[i][j] = least(out[i][j], (cost, Rope(letter)))


def insertions() -> Matrix:
    """Any number of inserted turns, none included."""
    one: Matrix = [[(0, NOTHING) if i == j else None for j in range(4)] for i in range(4)]
    for initial in "ua":
        for i, j in MOVES[initial].items():
            _edge(one, i, j, INSERT, "I")
    return product(one, one)


def of_sign(sign: str) -> Matrix:
    """One turn, with what is inserted before it."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        _edge(out, i, i, DROP, "D")
    if sign != "-":
        more = CUT * sign.isupper()
        for i, j in MOVES.get(sign.lower(), {}).items():
            _edge(out, i, j, more, "K")
        for initial in "ua":
            for i, j in MOVES[initial].items():
                _edge(out, i, j, RENAME + more, "R")
    return product(insertions(), out)


def symbols(rules: list[str]) -> dict[str, Matrix]:
    """Matrices of the signs and of the rules, each rule's from those of its two symbols, bottom up."""
    of = {sign: of_sign(sign) for sign in SIGNS}
    for k, pair in enumerate(rules):
        of[chr(FIRST_SYMBOL + k)] = product(of[pair[0]], of[pair[1]])
    return of


def finished(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a conversation whose turns have matrix `m`."""
    best: Entry = None
    for end in ENDS:
        best = least(best, product(m[:1], insertions())[0][end])
    assert best is not None  # all turns can be deleted
    return best[0], str(best[1])


def packed(m: Matrix) -> list[dict | None]:
    return [x and {"cost": x[0], "audit": str(x[1])} for row in m for x in row]


def unpacked(flat: list[dict | None]) -> Matrix:
    return [[x and (x["cost"], Rope(x["audit"])) for x in flat[i * 4 : i * 4 + 4]] for i in range(4)]


def pairs(text: Column) -> Column:
    return F.when(F.char_length(text) > 1, F.transform(F.sequence(F.lit(1), F.char_length(text) - 1), lambda i: F.substr(text, i, F.lit(2))))


def rewritten(text: Column, rules: list[str]) -> Column:
    """`text` with each rule's pairs replaced by its symbol, in the rules' order."""
    if not rules:
        return text
    known = F.array(*(F.struct(F.lit(pair).alias("pair"), F.lit(chr(FIRST_SYMBOL + k)).alias("symbol")) for k, pair in enumerate(rules)))
    return F.aggregate(known, text, lambda s, r: F.replace(s, r["pair"], r["symbol"]))


def grammar(strings: DataFrame) -> list[str]:
    """Re-Pair rules over the column signs: the pair that symbol number k stands for.

    A round counts adjacent pairs with partial sums and brings only the most frequent ones to the driver; of these it takes pairs that
    occur twice at least and don't overlap with one taken before. Pairs are of at most ROUNDS * PER_ROUND symbols besides the signs.
    """
    rules: list[str] = []
    for _ in range(ROUNDS):
        found = strings.select(F.explode(pairs(rewritten(F.col("signs"), rules))).alias("pair")).groupBy("pair").count().where("count > 1")
        taken: list[str] = []
        for (pair, _n) in found.orderBy(F.desc("count"), "pair").limit(4 * PER_ROUND).collect():
            if len(taken) < PER_ROUND and all(pair[0] != x[1] and pair[1] != x[0] for x in taken):
                taken.append(pair)
        if not taken:
            break
        rules += taken
    return rules


def solved(strings: DataFrame, rules: list[str]) -> DataFrame:
    """Per row of `strings`, which has signs: its matrix, and cost and audit of a conversation that consists of it."""

    def evaluate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = symbols(rules)
        for batch in batches:
            rows = []
            for signs, short in zip(*(batch.column(c).to_pylist() for c in ("signs", "_short")), strict=True):
                m = of[short[0]]
                for symbol in short[1:]:
                    m = product(m, of[symbol])
                cost, audit = finished(m)
                rows.append({"signs": signs, "matrix": packed(m), "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(rows, schema=SOLVED)

    return strings.select("signs", rewritten(F.col("signs"), rules).alias("_short")).mapInArrow(evaluate, f"signs string, matrix {MATRIX}, cost long, audit string")


_MATRIX = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
SOLVED = pa.schema([("signs", pa.string()), ("matrix", _MATRIX), ("cost", pa.int64()), ("audit", pa.string())])


def _multiplied(table: pa.Table) -> pa.Table:
    """The product of a group's matrices, by block."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    m = unpacked(rows[0]["matrix"])
    for r in rows[1:]:
        m = product(m, unpacked(r["matrix"]))
    cost, audit = finished(m)
    row = {"conv_id": rows[0]["conv_id"], "block": rows[0]["block"] // BRANCHES, "matrix": packed(m), "cost": cost, "audit": audit}
    return pa.Table.from_pylist([row], schema=pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), *list(SOLVED)[1:]]))


def damaged(turns: DataFrame) -> DataFrame:
    """`turns` after the faults that op11 plants by the CRC-32 of `conv_id:turn`; nulls are one space, but for conv_id and turn as columns."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    role = F.when(fate == 4, "user").otherwise(said("role"))
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


@dataclass
class Repair:
    """turns: conv_id, idx, role, text. talks: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""

    turns: DataFrame
    talks: DataFrame


def repair(turns: DataFrame) -> Repair:
    """The faults of each conversation of `turns` (conv_id, turn, role, text; others take no part), and the cheapest edits.

    Turns are taken by turn, nulls first, then by role and by the text's SHA-256, so that repeated turn numbers have a set order. A null role or text
    is one space, which makes a null text blank. Rows with a null conv_id form one conversation. A role without a character has no
    legal initial: it is renamed or deleted. gaps is null where the distance of two turn numbers is no long. An empty table gives no conversations.

    What is gathered per group is a block of turns, without texts; an audit, one value of the result, is a letter per turn and insertion.
    """
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    rows = numbered(turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("_sha")), ["conv_id"], ["turn", "role", "_sha"], "turns")
    bare = F.btrim("text", F.lit(BLANKS))
    ended = F.right(bare, F.lit(1)).isin(".", "!", "?")
    light = rows.select("conv_id", "idx", "n", "turn", "role", "_sha", (bare == "").alias("_blank"), ended.alias("_ended"))
    again = light.groupBy("conv_id", "role", "_sha").agg(F.min("idx").alias("_first"), F.count("*").alias("_times")).where("_times > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_sha").alias("_s"), "_first")
    judged = light.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_sha") == F.col("_s")), "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("idx") > F.col("_first"), "duplicate").when(~F.col("_ended"), "truncated").otherwise("")
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    sign = F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(known)).otherwise(known)
    block = F.floor(F.col("idx") / BLOCK)
    last = (F.col("idx") % BLOCK == BLOCK - 1) & (F.col("idx") + 1 < F.col("n"))  # the next block sees it too, as what comes before its first turn
    dealt = judged.select("conv_id", "n", F.struct("idx", sign.alias("sign"), initial.alias("initial"), fault.alias("fault"), "turn").alias("_row"), F.explode(F.when(last, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"))
    blocks = dealt.groupBy("conv_id", "block", "n").agg(F.array_sort(F.collect_list("_row")).alias("_all"))
    own = F.filter("_all", lambda x: x["idx"] >= F.col("block") * BLOCK)
    count = lambda name: F.size(F.filter(own, lambda x: x["fault"] == name)).cast("long").alias(name)
    later = F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0)))
    pair = F.transform(later, lambda x, i: F.struct(F.concat(F.get("_all", i)["initial"], x["initial"]).alias("initials"), (F.get("_all", i)["turn"].eqNullSafe(x["turn"])).alias("same")))
    fresh = F.size(F.filter(pair, lambda p: ~p["same"])) + F.when((F.col("block") == 0) & F.get("_all", F.lit(0))["turn"].isNotNull(), 1).otherwise(0)
    spans = blocks.select(
        "conv_id",
        "block",
        "n",
        F.array_join(F.transform(own, lambda x: x["sign"]), "").alias("signs"),
        count("blank"),
        count("duplicate"),
        count("truncated"),
        F.size(F.filter(pair, lambda p: ~p["initials"].isin("su", "ua", "au"))).cast("long").alias("illegal"),
        fresh.cast("long").alias("_turns"),
        F.array_min(F.transform(own, lambda x: x["turn"])).alias("_low"),
        F.array_max(F.transform(own, lambda x: x["turn"])).alias("_high"),
    )
    spans = stored(spans, "blocks")
    distance = F.max("_high").cast("decimal(38,0)") - F.min("_low").cast("decimal(38,0)") + 1 - F.sum("_turns")
    counts = spans.groupBy("conv_id").agg(F.coalesce(F.when(F.max("_high").isNull(), 0), distance.try_cast("long")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    strings = stored(spans.select("signs").distinct(), "strings")
    answers = solved(strings, grammar(strings))
    audits = spans.where(F.col("n") <= BLOCK).join(answers, "signs").select("conv_id", "cost", "audit")
    most = spans.agg(F.max("n")).first()[0] or 0
    if most > BLOCK:
        parts, left = spans.where(F.col("n") > BLOCK).join(answers, "signs").select("conv_id", "block", "matrix"), -(-most // BLOCK)
        parts = parts.withColumn("conv_id", F.col("conv_id").cast("long"))
        while left > 1:
            up = parts.groupBy("conv_id", F.floor(F.col("block") / BRANCHES)).applyInArrow(_multiplied, f"conv_id long, block long, matrix {MATRIX}, cost long, audit string")
            parts, left = stored(up, "products"), -(-left // BRANCHES)
        audits = audits.unionByName(parts.select("conv_id", "cost", "audit"))
    audits = audits.withColumnRenamed("conv_id", "_conv")
    return Repair(rows.select("conv_id", "idx", "role", "text"), counts.join(audits, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"))


@dataclass
class Turn:
    """A repaired turn, or the head of a conversation (role None)."""

    head: dict
    edit: str
    role: str | None
    text: str


def edited(batches: Iterable[pa.RecordBatch]) -> Iterator[Turn]:
    """Heads, and the repaired turns after each, from rows by conversation and idx of which a head is the first. Deleted turns are left out."""
    role, head, rest = "", {}, iter("")

    def inserted() -> Iterator[Turn]:
        """Turns put in before the next edit of a turn of the input, then that edit."""
        nonlocal role
        for letter in rest:
            if letter != "I":
                yield Turn(head, letter, None, "")
                return
            role = "assistant" if role[:1] == "u" else "user"
            yield Turn(head, "I", role, "")

    for batch in batches:
        for row in batch.to_pylist():
            if row["idx"] == -1:
                yield from (t for t in inserted() if t.role)
                role, head = "", row["head"]
                rest = iter(head["audit"])
                yield Turn(head, "", None, "")
                continue
            for t in inserted():
                if t.role:
                    yield t
                elif t.edit != "D":
                    role = row["role"] if t.edit == "K" else "assistant" if role[:1] == "u" else "user"
                    yield Turn(head, t.edit, role, row["text"])
    yield from (t for t in inserted() if t.role)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(turns: DataFrame) -> DataFrame:
    """Turns sorted by conversation and idx within partitions, each conversation headed by its row of `talks`, -1; those without turns too.

    A conversation goes through one task, a batch at a time, since its digest is one pass over its text.
    """
    made = repair(damaged(turns))
    every = turns.select(F.col("conv_id").alias("_all")).distinct()
    talks = every.join(made.talks, F.col("_all").eqNullSafe(F.col("conv_id")), "left")
    head = F.struct(F.col("_all").cast("long").alias("conv_id"), *(F.coalesce(c, F.when(F.col("audit").isNull(), F.lit(0))).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"))
    heads = talks.select(F.col("_all").alias("conv_id"), F.lit(-1).cast("long").alias("idx"), head.alias("head"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = made.turns.select("conv_id", "idx", F.lit(None).alias("head"), "role", "text")
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "idx")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations of damaged `turns`: conv_id, place (from 0), edit, role, text."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        out, place = [], 0
        for t in edited(batches):
            place = place + 1 if t.role is not None else 0
            if t.role is not None:
                out.append({"conv_id": t.head["conv_id"], "place": place - 1, "edit": t.edit, "role": t.role, "text": t.text})
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _streamed(turns).mapInArrow(rows, "conv_id long, place long, edit string, role string, text string")


def repair_digest(turns: DataFrame) -> DataFrame:
    """Per conv_id of `turns`, which are damaged first: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation that loses all turns to the damage has zeros and an empty audit.
    """
    fields = [("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, said, more = [], None, hashlib.sha256(), b""
        for t in edited(batches):
            if t.role is None:
                if head is not None:
                    out.append(head | {"repaired_sha256": said.hexdigest()})
                head, said, more = t.head, hashlib.sha256(), b""
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))
                    out = []
            else:
                said.update(more + f"{t.role}:{t.text}".encode())
                more = b"\n"
        if head is not None:
            out.append(head | {"repaired_sha256": said.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    return _streamed(turns).mapInArrow(digests, ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in fields))


def _sql() -> str:
    """The same in DuckDB: best edits from each turn on to the end, from the last turn back, as nine digits of cost and the audit; then a walk along the audit."""
    put = lambda cost, letter, value: f"lpad((left({value}, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({value}, 10)"
    cut = "(5 * cut)"
    keep = {("w0", "s"): "vs", ("w0", "u"): "vu", ("ws", "u"): "vu", ("wu", "a"): "va", ("wa", "u"): "vu"}
    named = {"w0": "vu", "ws": "vu", "wu": "va", "wa": "vu"}
    own = {"w0": "v0", "ws": "vs", "wu": "vu", "wa": "va"}
    steps = []
    for w, v in own.items():
        kept = " ".join(f"WHEN initial = '{c}' THEN {put(cut, 'K', to)}" for (state, c), to in keep.items() if state == w)
        steps.append(f"least({put(2, 'D', v)}, CASE WHEN dead THEN NULL {kept} END, CASE WHEN NOT dead THEN {put(f'(1 + {cut})', 'R', named[w])} END) AS {w}")
    more = {"v0": [("5", "I", "wu"), ("10", "II", "wa")], "vs": [("5", "I", "wu"), ("10", "II", "wa")], "vu": [("5", "I", "wa")], "va": [("5", "I", "wu")]}
    closed = ", ".join(f"least({v.replace('v', 'w')}, {', '.join(put(*x) for x in xs)}) AS {v}" for v, xs in more.items())
    fate = f"{CRC_SQL.format(s='''(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))''')} % 20"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE fated AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {fate} AS fate FROM conversations),
bad AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(2) AS copy(k) WHERE fate <> 0 AND (k = 0 OR fate = 3)),
rows AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         trim(text, {blanks}) AS bare FROM bad),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows),
told AS (
  SELECT *, left(role, 1) AS initial, bare = '' OR nth > 1 AS dead, (bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?'))::INT AS cut FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE bare = '') AS blank,
         count(*) FILTER (WHERE bare <> '' AND nth > 1) AS duplicate, sum(cut)::BIGINT AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
best AS (
  SELECT conv_id, n + 1 AS i, '000000000' AS v0, '000000010II' AS vs, '000000005I' AS vu, '000000000' AS va FROM (SELECT DISTINCT conv_id, n FROM told)
  UNION ALL
  SELECT conv_id, i, {closed} FROM (
    SELECT t.conv_id, t.i, {", ".join(steps)} FROM best b JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i - 1)),
answers AS (SELECT conv_id, left(v0, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM best WHERE i = 1),
walk AS (
  SELECT conv_id, audit, 0 AS k, 0::BIGINT AS i, '' AS state, '' AS said FROM answers
  UNION ALL
  SELECT conv_id, audit, k, i, CASE WHEN letter = 'D' THEN state WHEN letter = 'K' THEN initial ELSE left(named, 1) END,
         said || CASE WHEN letter = 'D' THEN '' ELSE CASE WHEN state = '' THEN '' ELSE chr(10) END || CASE WHEN letter = 'K' THEN role ELSE named END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END END
  FROM (SELECT w.conv_id, w.audit, w.k + 1 AS k, w.i + (w.audit[w.k + 1] <> 'I')::INT AS i, w.audit[w.k + 1] AS letter, w.state, w.said, t.role, t.text, t.initial,
               CASE WHEN w.state = 'u' THEN 'assistant' ELSE 'user' END AS named
        FROM walk w LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 WHERE w.k < length(w.audit))),
final AS (SELECT conv_id, max_by(said, k) AS said FROM walk GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN answers a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""


DIGEST_SQL = _sql()
