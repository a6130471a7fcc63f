"""Benchmark decontamination by template canonicalisation.

Words are canonicalised to templates: numbers, names and units become typed placeholders, everything else is lower-cased.
Windows of template words are hash-joined with those of the benchmark; the windows of an item that a document holds in
one place are counted as far as they agree on what the slots of their placeholders became. So a question is
caught also with other numbers, names or units. A second family of windows has the plain lower-cased words, so that a passage
is caught as it stands in any case. Either family is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import OUT_ROWS, grams, mix, settle, slices, span_hashes, texts_of

#: Words in a window, and words of it that are no placeholders at least. Items of fewer words are one window of all.
WINDOW, LITERALS = 8, 4
#: From so many words of an item to below the next number, windows have the words and literals given, so that half of them are
#: left when a word in the middle is another one.
SHORTER = ((11, 14, 4, 3), (14, 23, 5, 3))
#: Words that an item needs to be looked for by templates (one of fewer is looked for as it stands), and share of its windows that a document must hold in one place.
LEAST_WORDS, SHARE = 5, 0.5
#: Windows of so many words at most are whole items, so that a document needs each but once.
SINGLE = min(LEAST_WORDS, *(x[2] for x in SHORTER)) - 1
#: Bits that name a place in the sieve of benchmark windows that all tasks get (2 MB, whatever the benchmark's size), and one
#: in the table of its words.
SIEVE_BITS, VOCABULARY_BITS = 24, 21

# Units of measure as they are short and in full (those in full with an s or es too), words for numbers; in lower case. "One" is no such, being mostly a pronoun.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml cl l gal s sec min h hr hrs kmh mph kb mb gb tb w kw mw v a hz khz mhz ghz k c f usd eur gbp percent"
FULL_UNITS = (
    "millimetre millimeter centimetre centimeter metre meter kilometre kilometer inch foot feet yard mile acre hectare milligram gram kilogram kilo tonne ton ounce pound stone "
    "millilitre milliliter litre liter pint quart gallon cup barrel bushel second minute hour day week month year decade watt kilowatt volt ampere hertz degree celsius fahrenheit "
    "byte kilobyte megabyte gigabyte calorie joule knot dollar euro cent penny pence yen rupee franc"
)
NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
LITERAL, NUMBER, NAME, UNIT, SIGN = 0, 1, 2, 3, 4
PLAIN, TYPED = 0, 1
_GAP, _LETTER, _DIGIT, _SIGN = 0, 1, 2, 3

_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b'.!?:;\n"')] = True
_JOINS = np.zeros(256, bool)
_JOINS[list(b" \t\n\r-'")] = True


@dataclass
class Words:
    """Words of some texts: number of the text, kind (names are not told yet), hash of the word in lower case, and whether it
    has a capital and then a small letter, begins with no capital, starts a sentence, follows the last one with nothing or only
    blanks, hyphens and apostrophes between them, is a number in letters."""

    text: np.ndarray
    kind: np.ndarray
    words: np.ndarray
    capital: np.ndarray
    small: np.ndarray
    fresh: np.ndarray
    close: np.ndarray
    spelled: np.ndarray


@dataclass
class Template:
    """Template words of some texts: number of the text, kind, hash of the template word, hash of the word as it stands."""

    text: np.ndarray
    kind: np.ndarray
    forms: np.ndarray
    words: np.ndarray


def _word_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of words in ASCII."""
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    gaps = np.flatnonzero(raw == 32)
    return np.sort(span_hashes(_LOWER[raw], np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])))


@cache
def _listed() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units and of the words for numbers."""
    full = FULL_UNITS.split()
    return _word_hashes([*UNITS.split(), *full, *(w + "s" for w in full), *(w + "es" for w in full)]), _word_hashes([w + end for w in NUMBERS.split() for end in ("", "s")])


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


@cache
def _small_letters() -> np.ndarray:
    """The small letter of each code point of two or three bytes, if that has as many, else itself."""
    width = lambda c: 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    small = [chr(c).lower() for c in range(0x10000)]
    return np.array([ord(x) if len(x) == 1 and width(ord(x)) == width(c) else c for c, x in enumerate(small)], np.int64)


def _lower_wide(data: np.ndarray, value: np.ndarray) -> np.ndarray:
    """First bytes of the capitals of two or three bytes; `value` gets the bytes of their small letters."""
    found = []
    for width, from_, to in ((2, 0xC3, 0xDF), (3, 0xE1, 0xEF)):
        at = np.flatnonzero((data >= from_) & (data <= to))
        code = data[at].astype(np.int64) & (0x3F >> (width - 1))
        for step in range(1, width):
            code = code << 6 | data[at + step] & 0x3F
        small = _small_letters()[code]
        raised = np.flatnonzero(small != code)
        at, small = at[raised], small[raised]
        for step in range(width - 1, 0, -1):
            value[at + step] = (small & 0x3F | 0x80) + 1
            small = small >> 6
        value[at] = (small | (0xC0 if width == 2 else 0xE0)) + 1
        found.append(at)
    return np.concatenate(found)


def words_of(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of the texts that `bounds` parts in UTF-8 bytes.

    A word is a run of letters or of digits; 3.5 and 1:30 are one number, and so are the words of NUMBERS. A unit is a word of UNITS or FULL_UNITS after
    a number, a sign is a percent or dollar sign at one. Capitals are those of any script whose small letters take as many bytes. Latin-1 and
    general punctuation and currency signs part words.
    """
    n = len(data)
    none, flags = np.zeros(0, np.int64), np.zeros(0, bool)
    nothing = Words(none, none, none.astype(np.uint64), flags, flags, flags, flags, flags)
    if n == 0:
        return nothing
    kind_of = _CLASS[data]
    value = _LOWER[data]
    wide = data >= 0xC2
    if wide.any():
        upper = _lower_wide(data, value)
        marks = np.flatnonzero(data == 0xC2)
        kind_of[marks] = kind_of[np.minimum(marks + 1, n - 1)] = _GAP
        marks = np.flatnonzero(data[:-1] == 0xE2)
        marks = marks[(data[marks + 1] >= 0x80) & (data[marks + 1] <= 0x82)]
        for step in range(3):
            kind_of[np.minimum(marks + step, n - 1)] = _GAP
    else:
        upper = none
    percent = np.flatnonzero(data == 37)
    kind_of[percent[(percent > 0) & (kind_of[percent - 1] == _DIGIT)]] = _SIGN
    dollar = np.flatnonzero(data[:-1] == 36)
    kind_of[dollar[kind_of[dollar + 1] == _DIGIT]] = _SIGN

    edge = np.ones(n, bool)
    edge[1:] = kind_of[1:] != kind_of[:-1]
    edge[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(edge & (kind_of != _GAP))
    if not len(starts):
        return nothing
    edges = np.append(np.flatnonzero(edge), n)
    ends = edges[np.searchsorted(edges, starts, side="right")]
    text = np.searchsorted(bounds, starts, side="right") - 1
    digit = kind_of[starts] == _DIGIT

    same = np.zeros(len(starts), bool)
    same[1:] = text[1:] == text[:-1]
    inner = np.zeros(len(starts), bool)  # the later parts of numbers such as 3.5
    inner[1:] = same[1:] & digit[1:] & digit[:-1] & (starts[1:] - ends[:-1] == 1) & np.isin(data[np.maximum(starts[1:] - 1, 0)], np.frombuffer(b".,:/", np.uint8))
    hashes = span_hashes(value, starts, ends)
    closes = np.concatenate([[0], np.cumsum(_ENDS[data])])
    fresh = ~same
    fresh[1:] |= closes[starts[1:]] > closes[ends[:-1]]
    raised = (data >= 65) & (data <= 90)
    raised[upper] = True
    first = data[starts]
    second = starts + 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    capital = raised[starts] & (second < ends) & ~raised[np.minimum(second, n - 1)]
    after_number = np.zeros(len(starts), bool)
    units, numbers = _listed()
    spelled = (kind_of[starts] == _LETTER) & _among(hashes, numbers)
    after_number[1:] = same[1:] & (digit | spelled)[:-1] & ~spelled[1:]
    after = np.flatnonzero(after_number)
    after_number[after] = _among(hashes[after], units)
    kind = np.where(digit | spelled, NUMBER, np.where(kind_of[starts] == _SIGN, SIGN, np.where(after_number, UNIT, LITERAL)))
    head = np.flatnonzero(~inner)
    words = np.add.reduceat(hashes * np.where(inner, np.uint64(3), np.uint64(1)), head)
    small = (kind_of[starts] == _LETTER) & ~raised[starts]
    marks = np.concatenate([[0], np.cumsum(~_JOINS[data])])
    close = same.copy()
    close[1:] &= marks[starts[1:]] == marks[ends[:-1]]
    return Words(text[head], kind[head], words, capital[head], small[head], fresh[head], close[head], spelled[head])


def plain(w: Words) -> Template:
    """Every word as it stands, in lower case."""
    return Template(w.text, np.full(len(w.text), LITERAL), w.words, w.words)


def _named(inside: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Of words that occur with a capital: whether they are names, by how often they have one inside a sentence and how often none."""
    return (inside > small) | (small == 0)


def typed(w: Words, known: np.ndarray, is_name: np.ndarray) -> Template:
    """Numbers, names and units as placeholders, other words in lower case. A name of several words is one placeholder, and so
    is a number with its sign or of several words, as in twenty-five and 3 million.

    A word is a name or not wherever it stands and in whatever case: `known` (sorted) and `is_name` say it of the words of the
    benchmark, and of other words the text itself does.
    """
    name = np.zeros(len(w.text), bool)
    loose = w.kind == LITERAL
    if len(known):
        places = w.words >> np.uint64(64 - VOCABULARY_BITS)
        at = np.minimum(np.searchsorted(known, places), len(known) - 1)
        met = known[at] == places
        name = met & is_name[at] & loose
        loose &= ~met
    raised = np.flatnonzero(loose & w.capital)
    if len(raised):
        own = np.flatnonzero(loose)
        key = mix(w.words ^ mix(w.text.astype(np.uint64) + np.uint64(1)))
        keys, where = np.unique(key[raised], return_inverse=True)
        place = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
        same = keys[place] == key[own]
        told = _named(np.bincount(where, ~w.fresh[raised], len(keys)), np.bincount(place[same & w.small[own]], minlength=len(keys)))
        name[own] = same & told[place]
    kind = np.where(name, NAME, w.kind)
    more = np.zeros(len(kind), bool)
    more[1:] = w.close[1:] & (((kind[1:] == NAME) & (kind[:-1] == NAME)) | ((kind[1:] == SIGN) & (kind[:-1] == NUMBER)) | ((kind[1:] == NUMBER) & (kind[:-1] == SIGN)) | (w.spelled[1:] & (kind[:-1] == NUMBER)))
    head = np.flatnonzero(~more)
    if not len(head):
        return Template(w.text, kind, w.words, w.words)
    words = np.add.reduceat(w.words * np.where(more, np.uint64(3), np.uint64(1)), head)
    kind = np.where(kind == SIGN, NUMBER, kind)[head]
    return Template(w.text[head], kind, np.where(kind == LITERAL, words, kind.astype(np.uint64)), words)


def vocabulary(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the benchmark's words that occur in small letters or with a capital, sorted, and whether they are names: those
    that more often have a capital inside a sentence than none, or that never have none.

    A place is the first VOCABULARY_BITS of a word's hash. So the table is bounded whatever the benchmark; words that share a
    place are judged as one, in items and documents alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in slices(texts_of(batch.column(0))):
                w = words_of(data, bounds)
                use = np.flatnonzero((w.kind == LITERAL) & (w.capital | w.small))
                h, where = np.unique(w.words[use] >> np.uint64(64 - VOCABULARY_BITS), return_inverse=True)
                sums = [np.bincount(where, x[use], len(h)).astype(np.int64) for x in (w.capital, w.capital & ~w.fresh, w.small)]
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), *map(pa.array, sums)], names=["h", "raised", "inside", "small"])

    found = items.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "h long, raised long, inside long, small long")
    h, raised, inside, small = (c.to_numpy() for c in found.groupBy("h").agg(F.sum("raised"), F.sum("inside"), F.sum("small")).toArrow().columns)
    order = np.argsort(h)
    return h[order].astype(np.uint64), ((raised > 0) & _named(inside, small))[order]


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a window's hash in the sieve."""
    least = np.uint64((1 << SIEVE_BITS) - 1)
    return h >> np.uint64(64 - SIEVE_BITS), h >> np.uint64(40 - SIEVE_BITS) & least


def sieve_of(windows: DataFrame) -> np.ndarray:
    """Bits that are set at both places of every window's hash (h), in words of 64: at most 2**(SIEVE_BITS - 6) rows are read."""
    places = F.array(F.shiftrightunsigned("h", 64 - SIEVE_BITS), F.shiftrightunsigned("h", 40 - SIEVE_BITS).bitwiseAND((1 << SIEVE_BITS) - 1))
    bits = windows.select(F.explode(places).alias("p")).select(F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    word, bit = (c.to_numpy() for c in bits.groupBy("w").agg(F.bit_or("b")).toArrow().columns)
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    out[word] = bit.view(np.uint64)
    return out


def _passes(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for place in _probes(h):
        out &= (sieve[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def window_size(n_words: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in the windows of items of so many words, 0 for none, and literals that a window needs."""
    size = np.where(n_words >= (1 if family == PLAIN else LEAST_WORDS), np.minimum(n_words, WINDOW), 0)
    least = np.minimum(size, LITERALS)
    for from_, to, own, literals in SHORTER:
        inside = (n_words >= from_) & (n_words < to)
        size, least = np.where(inside, own, size), np.where(inside, literals, least)
    return size, least


def window_hashes(t: Template, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first words, hashes and literals of the windows that lie in one text and hold the fewest literals that
    an item's window can have."""
    literal = np.concatenate([[0], np.cumsum(t.kind == LITERAL)])
    for size in sizes:
        found = grams(t.forms, size)
        if len(found):
            held = literal[size:] - literal[:-size]
            fewest = min([LITERALS, size, *(x[3] for x in SHORTER if x[2] == size)])
            good = np.flatnonzero((t.text[: len(found)] == t.text[size - 1 :]) & (held >= fewest))
            yield size, good, found[good], held[good]


def _slots(t: Template, at: int, size: int) -> list[int]:
    """Hashes of what stands in the placeholders of a window, 0 for its other words; none where it has no placeholders."""
    held = np.where(t.kind[at : at + size] != LITERAL, t.words[at : at + size], np.uint64(0)).view(np.int64).tolist()
    return held if any(held) else []


def agreeing(hits: list[dict]) -> int:
    """How many windows of an item agree on what its slots became, at most, of hits `at` in the item, `there` in the document, with
    the slots of both (`mine`, `theirs`).

    Of each window the hit that lies nearest to an offset is taken, and each offset that occurs is tried. A value of the item
    became that which most of its places have in the document; of several that as many places have, its own value, or else
    none, and no window with it agrees. Several values may become the same.
    """
    by_window: dict[int, list[dict]] = {}
    for hit in hits:
        by_window.setdefault(hit["at"], []).append(hit)
    most = 0
    for offset in sorted({hit["there"] - hit["at"] for hit in hits}):
        near = [min(own, key=lambda x: (abs(x["there"] - x["at"] - offset), x["there"])) for own in by_window.values()]
        places: dict[int, dict[int, set[int]]] = {}
        for hit in near:
            for i, (a, b) in enumerate(zip(hit["mine"], hit["theirs"], strict=True)):
                if a:
                    places.setdefault(a, {}).setdefault(b, set()).add(hit["at"] + i)
        became = {}
        for a, held in places.items():
            top = max(map(len, held.values()))
            tied = [b for b, own in held.items() if len(own) == top]
            became[a] = tied[0] if len(tied) == 1 else a if a in tied else None
        most = max(most, sum(all(became[a] == b for a, b in zip(hit["mine"], hit["theirs"], strict=True) if a) for hit in near))
        if most == len(by_window):
            break
    return most


_WINDOWS = [("family", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("h", pa.int64()), ("n_words", pa.int32()), ("slots", pa.list_(pa.int64()))]


def _batch(key: str, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *(t for _, t in _WINDOWS)), strict=True)], names=[key, *(n for n, _ in _WINDOWS)])


def template_windows(rows: DataFrame, key: str, sizes: list[list[int]] | None, names: tuple[np.ndarray, np.ndarray], sieve: np.ndarray | None = None) -> DataFrame:
    """key, family, at, size, h, n_words, slots: the windows of every whole text, of PLAIN words and of TYPED ones by the vocabulary `names`.

    `sizes` None: as window_size() says, which is how items are cut. Else of each of these sizes of the two
    families, which is how documents are. With `sieve`, only windows that pass it.
    """
    held = rows.sparkSession.sparkContext.broadcast((sieve, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, known = held.value
        out: list[tuple] = []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for from_, _, data, bounds in slices(texts_of(batch.column(1))):
                w = words_of(data, bounds)
                for family, t in ((PLAIN, plain(w)), (TYPED, typed(w, *known))):
                    firsts = np.searchsorted(t.text, np.arange(len(bounds)))
                    counts = np.diff(firsts)
                    wants, least = window_size(counts, family)
                    for size, at, found, literals in window_hashes(t, sizes[family] if sizes else sorted({int(x) for x in np.unique(wants) if x})):
                        keep = np.ones(len(at), bool) if sizes else (wants[t.text[at]] == size) & (literals >= least[t.text[at]])
                        if few is not None:
                            keep &= _passes(few, found)
                        if sizes and size <= SINGLE:
                            once = np.flatnonzero(keep)
                            once = once[np.lexsort((once, found[once], t.text[at[once]]))]
                            again = np.zeros(len(once), bool)
                            again[1:] = (found[once][1:] == found[once][:-1]) & (t.text[at[once]][1:] == t.text[at[once]][:-1])
                            keep[once[again]] = False
                        for i in np.flatnonzero(keep):
                            own = t.text[at[i]]
                            out.append((int(keys[from_ + own]), family, int(at[i] - firsts[own]), size, int(found[i].view(np.int64)), int(counts[own]), _slots(t, at[i], size)))
                        if len(out) >= OUT_ROWS:
                            yield _batch(key, out)
                            out = []
        if out:
            yield _batch(key, out)

    return rows.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, "text").mapInArrow(run, f"{key} long, family int, at int, size int, h long, n_words int, slots array<long>")


def find_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_found, n_windows: documents that hold at least `share` of an item's windows in one place.

    Windows are counted by their place in the item, wherever they begin in a stretch of the document of up to twice the item's
    length; so words may be put in, dropped or replaced as long as half of the windows are left. Of an item of 11 words or more
    any one word may be another; of a shorter one it may break every window, and then only other slots are found.
    Both texts are taken whole. An item of under LEAST_WORDS words is
    found where its words stand in a row, in any case, even if it is but one common word; numbers, names or units may be all that
    an item has. Null ids or texts and items without words match nothing, and a run of letters without blanks is one word; repeated rows of a
    document or an item give one row; columns other than ids and texts are ignored. Empty tables give an empty one.

    A sieve of bounded size keeps most windows without a partner in their tasks; those that pass it, and all of the benchmark's,
    are joined by hash, so that a larger benchmark costs more but is not handled in another way.
    """
    names = vocabulary(items)
    cut = settle(template_windows(items, "item_id", None, names).distinct())
    met = sorted((r["family"], r["size"]) for r in cut.select("family", "size").distinct().collect())  # at most WINDOW a family
    sizes = [[size for own, size in met if own == family] for family in (PLAIN, TYPED)]
    if not met:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_found long, n_windows long")
    held = template_windows(docs, "doc_id", sizes, names, sieve_of(cut)).select("doc_id", "family", F.col("at").alias("_at"), "size", "h", F.col("slots").alias("_there"))
    counts = cut.groupBy("item_id", "family").agg(F.count_distinct("at").alias("n_windows"))
    reach = (F.col("n_words") + WINDOW).cast("long")  # a copy with a few words more lies in one of two places, each twice as long
    place = F.floor(F.col("_at") / reach)
    hit = F.struct("at", F.col("_at").alias("there"), F.col("slots").alias("mine"), F.col("_there").alias("theirs"))
    places = (
        held.join(cut, ["h", "size", "family"])
        .withColumn("_place", F.explode(F.array(place - 1, place)))
        .groupBy("doc_id", "item_id", "family", "_place")
        .agg(F.count_distinct("at").alias("n_found"), F.collect_list(F.when(F.col("family") == TYPED, hit)).alias("_hits"))
    )
    enough = F.col("n_found") >= F.lit(share) * F.col("n_windows")
    several = places.join(counts, ["item_id", "family"]).where(enough).select("doc_id", "item_id", "family", "n_windows", "n_found", "_hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [agreeing(h.as_py()) if f.as_py() == TYPED else n.as_py() for f, n, h in zip(batch.column(2), batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3)), pa.array(held, pa.int64())], names=["doc_id", "item_id", "n_windows", "n_found"])

    sure = several.mapInArrow(run, "doc_id long, item_id long, n_windows long, n_found long").where(enough)
    best = F.max(F.struct((F.col("n_found") / F.col("n_windows")).alias("_part"), F.col("n_found").cast("long").alias("n_found"), F.col("n_windows").cast("long").alias("n_windows"))).alias("_best")
    return sure.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "_best.n_found", "_best.n_windows")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without the documents that hold an item; rows with a null doc_id stay."""
    found = find_leaks(docs, items).select(F.col("doc_id").alias("_leaky")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_leaky"), "left_anti")
