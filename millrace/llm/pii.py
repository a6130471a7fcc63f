r"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The base spans follow patterns and checks. The model learns from labelled spans: windows of the corpus with the base spans that its documents
hold, rewritten forms of these (separators changed, signs in brackets or spelled out), and numbers that are nothing personal. It reads every
window of a text that holds a digit, an at sign or a bracketed `at`, without one of which a span has no form here. Windows
overlap by half; each is decoded by Viterbi, and the windows' spans are reconciled over the whole text: spans cut by a window's edge are
left to the next one, what fails its kind's check or overlaps a base span goes, and of the rest the non-overlapping set of largest total score stays.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import random
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import texts_of

KINDS = ("email", "ip", "card", "phone")
#: Patterns and bounds that the contract fixes.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Characters of a window, and from one window to the next: any span of up to STRIDE characters lies whole in one.
WIDTH, STRIDE = 80, 40
#: Windows of the corpus and made-up ones to learn from, at most; passes over them; windows of a step.
CORPUS_WINDOWS, MADE_WINDOWS, PASSES, STEP = 1024, 3072, 8, 24
EMBEDDED, HIDDEN = 12, 24
#: Windows that are scored at a time.
SCORED = 512
#: Mean margin per character, over no span at all, from which a span of the model counts.
LEAST_MARGIN = 1.0
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?[aA][tT] ?[)\]}]")

Span = tuple[int, int, str]


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"][::-1]
    return (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def _count(text: str) -> int:
    return sum(c in "0123456789" for c in text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign, so that long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", at + 1)


def shapes(text: str) -> Iterator[tuple[Span, bool]]:
    """All matches of the patterns, each with the answer of its check."""
    for start, end in _emails(text):
        yield (start, end, "email"), True
    for m in IP.finditer(text):
        yield (*m.span(), "ip"), all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))
    for m in CARD.finditer(text):
        yield (*m.span(), "card"), 14 <= _count(m[0]) <= 19 and luhn(m[0])
    for m in PHONE.finditer(text):
        yield (*m.span(), "phone"), 10 <= _count(m[0]) <= 15


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def base_spans(text: str) -> list[Span]:
    return ordered(span for span, good in shapes(text) if good)


AT, DOT = re.compile(r" ?(?:@|[(\[{] ?at ?[)\]}]) ?", re.IGNORECASE), re.compile(r" ?(?:\.|[(\[{] ?(?:dot|\.) ?[)\]}]) ?", re.IGNORECASE)


def plausible(text: str, start: int, end: int, kind: str) -> bool:
    """The check of a span that the model finds: its kind's own, over plain signs, and no letter or digit at its ends' other side."""
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum() or text[start].isspace() or text[end - 1].isspace():
        return False
    said = text[start:end]
    if kind == "email":
        plain = DOT.sub(".", AT.sub("@", said))
        return [*_emails(plain)] == [(0, len(plain))]
    if kind == "ip":
        m = IP.fullmatch(DOT.sub(".", said))
        return bool(m) and all(len(x) < 4 and int(x) < 256 for x in m[0].split("."))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,3}[0-9])+", said)) and 14 <= _count(said) <= 19 and luhn(said)
    return bool(re.fullmatch(r"[+(]?[0-9](?:[ ()./-]{0,2}[0-9])+", said)) and 10 <= _count(said) <= 15 and bool(re.search(r"[0-9][ ()./-]+[0-9]", said))


# ---- characters

PLAIN = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PAD, DIGIT, LETTER, SPACE, OTHER = 0, 1, 2, 3, 4
CODES = 5 + 26 + len(PLAIN)
_ASCII = np.full(128, OTHER, np.uint8)
_ASCII[[9, 10, 11, 12, 13]] = SPACE
_ASCII[48:58] = DIGIT
_ASCII[65:91] = _ASCII[97:123] = np.arange(5, 31)
for _i, _c in enumerate(PLAIN):
    _ASCII[ord(_c)] = 31 + _i


def codes(text: str) -> np.ndarray:
    """A code per character: digits are one, letters a-z are told apart but not by case, letters of other scripts are one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], np.where(points < 0xC0, OTHER, LETTER)).astype(np.uint8)


# ---- the network

HALF = np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), HIDDEN)  # gates, then what goes into the cells
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])


class Tagger:
    """Embedded characters, an LSTM in each direction (both go in one array), a linear layer, and transitions of tags."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.p = {
            "E": normal(CODES, EMBEDDED) * 3,
            "W": normal(2, EMBEDDED, 4 * HIDDEN),
            "U": normal(2, HIDDEN, 4 * HIDDEN),
            "b": np.zeros((2, 1, 4 * HIDDEN), np.float32),
            "V": normal(2 * HIDDEN, TAGS),
            "d": np.array([3] + [0] * (TAGS - 1), np.float32),  # most characters are outside
            "A": np.zeros((TAGS, TAGS), np.float32),
        }
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1  # cells keep what they hold at first

    def emissions(self, x: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Scores (character, window, tag) of windows of codes; `kept` gets what backward() needs."""
        p, at = self.p, x.T
        e = p["E"][at]
        both = np.stack([e, e[::-1]], 1)  # the second direction reads from the end
        z = (both @ p["W"] + p["b"]) * HALF
        u = p["U"] * HALF
        size, n = at.shape
        gates = np.empty_like(z)
        hs, cs, tcs = (np.zeros((size + 1, 2, n, HIDDEN), z.dtype) for _ in range(3))
        for t in range(size):
            a = np.tanh(z[t] + hs[t] @ u)  # of half a gate's sum, which is the logistic function but for a scale
            a[..., : 3 * HIDDEN] += 1
            a[..., : 3 * HIDDEN] *= 0.5
            gates[t] = a
            cs[t + 1] = a[..., HIDDEN : 2 * HIDDEN] * cs[t] + a[..., :HIDDEN] * a[..., 3 * HIDDEN :]
            np.tanh(cs[t + 1], out=tcs[t + 1])
            np.multiply(a[..., 2 * HIDDEN : 3 * HIDDEN], tcs[t + 1], out=hs[t + 1])
        out = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], -1)
        if kept is not None:
            kept |= {"at": at, "both": both, "gates": gates, "hs": hs, "cs": cs, "tcs": tcs, "out": out}
        return out @ p["V"] + p["d"]

    def backward(self, kept: dict, de: np.ndarray) -> dict[str, np.ndarray]:
        p, out, gates = self.p, kept["out"], kept["gates"]
        flat = lambda a: a.swapaxes(0, 1).reshape(2, -1, a.shape[-1])
        grads = {"V": out.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "d": de.sum((0, 1))}
        dout = de @ p["V"].T
        dh_all = np.stack([dout[..., :HIDDEN], dout[::-1, :, HIDDEN:]], 1)
        i, f, o, g = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        tc = kept["tcs"][1:]
        slope = np.concatenate([g * i * (1 - i), kept["cs"][:-1] * f * (1 - f), tc * o * (1 - o), i * (1 - g * g)], -1)
        inner = o * (1 - tc * tc)
        dz = np.empty_like(slope)
        dh = dc = np.zeros_like(dh_all[0])
        back = p["U"].transpose(0, 2, 1)
        for t in range(len(dz) - 1, -1, -1):
            dh = dh + dh_all[t]
            dc = dc + dh * inner[t]
            np.multiply(np.concatenate([dc, dc, dh, dc], -1), slope[t], out=dz[t])
            dh, dc = dz[t] @ back, dc * f[t]
        grads |= {"U": flat(kept["hs"][:-1]).swapaxes(1, 2) @ flat(dz), "W": flat(kept["both"]).swapaxes(1, 2) @ flat(dz), "b": dz.sum((0, 2))[:, None]}
        dboth = dz @ p["W"].transpose(0, 2, 1)
        grads["E"] = np.eye(CODES, dtype=dz.dtype)[kept["at"].ravel()].T @ (dboth[:, 0] + dboth[::-1, 1]).reshape(-1, EMBEDDED)
        return grads

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags `y` of windows `x`, and its gradients, by forward and backward sums over the tags."""
        kept: dict = {}
        e = self.emissions(x, kept)
        n, size = x.shape[0], len(e)
        top = e.max(-1, keepdims=True)
        psi, jump = np.exp(e - top), np.exp(self.p["A"]) * ALLOWED
        alpha, scale = np.empty_like(e), np.empty((size, n, 1), e.dtype)
        for t in range(size):
            a = psi[t] if t == 0 else alpha[t - 1] @ jump * psi[t]
            scale[t] = a.sum(-1, keepdims=True)
            alpha[t] = a / scale[t]
        beta = np.ones_like(e)
        pairs = np.zeros_like(jump)
        for t in range(size - 1, 0, -1):
            ahead = psi[t] * beta[t] / scale[t]
            pairs += alpha[t - 1].T @ ahead * jump
            beta[t - 1] = ahead @ jump.T
        tags = y.T
        true = np.zeros_like(e)
        np.put_along_axis(true, tags[..., None], 1, -1)
        seen = np.zeros_like(jump)
        np.add.at(seen, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        whole = np.log(scale).sum() + top.sum()
        score = np.take_along_axis(e, tags[..., None], -1).sum() + self.p["A"][tags[:-1], tags[1:]].sum()
        grads = self.backward(kept, (alpha * beta - true) / n)
        return float((whole - score) / n), grads | {"A": (pairs - seen) / n * ALLOWED}

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (window, character) by Viterbi, and how much each character's tag scores over none."""
        e = self.emissions(x)
        jump = np.where(ALLOWED, self.p["A"], -1e9).astype(np.float32)
        v, back = e[0], []
        for t in range(1, len(e)):
            both = v[:, :, None] + jump
            best = both.argmax(1)
            back.append(best)
            v = np.take_along_axis(both, best[:, None], 1)[:, 0] + e[t]
        tags = np.empty(x.shape, np.int64)
        tags[:, -1] = v.argmax(1)
        for t in range(len(back) - 1, -1, -1):
            tags[:, t] = np.take_along_axis(back[t], tags[:, t + 1, None], 1)[:, 0]
        return tags, (np.take_along_axis(e, tags.T[..., None], -1)[..., 0] - e[..., 0]).T


def trained(x: np.ndarray, y: np.ndarray, passes: int = PASSES, seed: int = 0) -> Tagger:
    """A tagger fitted by Adam, its rate falling to none."""
    model, rng = Tagger(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    steps, k = passes * max(1, len(x) // STEP), 0
    for _ in range(passes):
        order = rng.permutation(len(x))
        for at in range(0, max(1, len(x) // STEP) * STEP, STEP):
            rows = order[at : at + STEP]
            _, grads = model.loss(x[rows], y[rows])
            k += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1, 5 / (norm + 1e-9))
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                rate = 0.02 * (1 - (k - 1) / steps) / (1 - 0.9**k)
                model.p[name] -= (rate * first[name] / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-7)).astype(np.float32)
    return model


# ---- what it learns from

Labelled = tuple[str, list[Span]]


def labelled_windows(text: str) -> Iterator[Labelled]:
    """Windows of the text around its spans and other digits, with the base spans in them; those with a number that only fails a check are left out.
    A text that has neither gives one window, of its middle."""
    if not TRIGGER.search(text):
        a = max(0, len(text) - WIDTH) // 2
        yield text[a : a + WIDTH], []
        return
    found = [*shapes(text)]
    good = [s for s, ok in found if ok]
    doubtful = [s for s, ok in found if not ok and (s[2] == "ip" or _count(text[s[0] : s[1]]) >= 10)]
    taken = -1
    for m in TRIGGER.finditer(text):
        if m.start() < taken:
            continue
        a = max(0, m.start() - STRIDE + place_number(text, m.start()) % 30)
        b = min(len(text), a + WIDTH)
        taken = b
        if not any(s[0] < b and s[1] > a for s in doubtful):
            yield text[a:b], [(max(0, s[0] - a), min(b, s[1]) - a, s[2]) for s in good if s[0] < b and s[1] > a]


def place_number(text: str, at: int) -> int:
    """A number that depends on the text around `at` alone, so that the same text gives the same windows anywhere."""
    return sum(map(ord, text[max(0, at - 8) : at + 8])) * 31 + at


def tags_of(spans: list[Span]) -> np.ndarray:
    y = np.zeros(WIDTH, np.int64)
    for start, end, kind in spans:
        y[start:end] = 2 + 2 * KINDS.index(kind)
        if start < len(y):
            y[start] = 1 + 2 * KINDS.index(kind)
    return y


def rewritten(said: str, kind: str, rng: random.Random) -> str:
    """Another way to write a span of a kind."""
    pick = rng.choice
    digits = [c for c in said if c.isdigit()]
    if kind == "email":
        name, _, host = said.rpartition("@")
        at = pick(["@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " ( at ) "])
        dot = pick([".", ".", "(dot)", " (dot) ", "[dot]", " [.] ", " . "] if at != "@" else ["[.]", "(dot)", " (dot) "])
        return name + at + dot.join(host.split("."))
    if kind == "ip":
        return pick(["[.]", "(.)", " . ", "{.}", "(dot)", "[dot]"]).join(said.split("."))
    if kind == "card":
        between = pick([".", "/", "  ", " - ", "_", "-", " "])
        return between.join("".join(digits[i : i + 4]) for i in range(0, len(digits), 4))
    body = digits[-10:]
    area, mid, end = "".join(body[:3]), "".join(body[3:6]), "".join(body[6:])
    lead = pick(["", "", "".join(digits[:-10]) or "1", "00" + ("".join(digits[:-10]) or "1")])
    form = pick(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}){}-{}", "{}/{}-{}", "{}/{} {}"])
    return f"{lead}{pick([' ', '-']) if lead else ''}{form.format(area, mid, end)}"


def fresh(kind: str, rng: random.Random) -> str:
    """A made-up span in the patterns' own form."""
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        return f"{word(2, 9)}{rng.choice(['', '.', '_', '-'])}{rng.choice([word(2, 8), number(2)])}@{word(3, 9)}{rng.choice(['', number(1)])}.{rng.choice(['', word(3, 7) + '.'])}{word(2, 3)}"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        body = rng.choice("3456") + number(rng.choice([13, 14, 14, 14, 15]))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        return card if rng.random() < 0.5 else rng.choice(" -").join(card[i : i + 4] for i in range(0, len(card), 4))
    return f"+{rng.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}" if rng.random() < 0.5 else f"+{rng.randint(1, 99)}{rng.choice(' -.')}{number(3)}{rng.choice(' -.')}{number(3)}{rng.choice(' -.')}{number(4)}"


def unrelated(rng: random.Random) -> str:
    """Numbers and signs that are nothing personal."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice(
        [
            lambda: f"{rng.randrange(1900, 2100)}-{number(2)}-{number(2)}",
            lambda: f"{number(2)}.{number(2)}.{number(4)}",
            lambda: f"{number(2)}:{number(2)}:{number(2)}",
            lambda: f"{rng.randrange(10)}.{rng.randrange(30)}" + rng.choice(["", f".{rng.randrange(30)}"]),
            lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"',
            lambda: f"password={''.join(rng.choice('0123456789abcdef') for _ in range(18))}",
            lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(20)),
            lambda: number(rng.randint(1, 9)),
            lambda: f"{number(3)},{number(3)}.{number(2)}",
            lambda: f"({number(1)}) {number(2)} - {number(2)}",
            lambda: f"{number(3)}-{number(4)}",
            lambda: f"[{number(2)}] and (at) the end",
            lambda: f"@{''.join(rng.choice('abcdefgh') for _ in range(6))}",
            lambda: f"{number(4)} {number(4)} {number(2)}",
        ]
    )()


def made_window(ground: str, rng: random.Random, known: dict[str, list[str]]) -> Labelled:
    """A span of the corpus or a made-up one, mostly rewritten, or something unrelated, put into a piece of ground."""
    ground = ground or " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(14))
    cut = rng.randint(0, len(ground))
    left, right = ground[:cut], ground[cut:]
    left = re.sub(r"\S+$", "", left) if rng.random() < 0.8 else left[: -rng.randint(0, 9) or None]
    right = re.sub(r"^\S+", "", right)
    kind = rng.choice([*KINDS, *KINDS, ""])
    if kind:
        said = rng.choice(known[kind]) if known[kind] and rng.random() < 0.5 else fresh(kind, rng)
        said = rewritten(said, kind, rng) if rng.random() < 0.75 else said
    else:
        said = unrelated(rng)
    left = left + " " if left and not left[-1].isspace() else left
    right = rng.choice([".", ",", "", "", ")", ";", ":"]) + (" " if right and not right[0].isspace() else "") + right
    shift = max(0, len(left) - rng.randint(0, max(0, WIDTH - len(said) - 2)))
    text = (left + said + right)[shift : shift + WIDTH]
    start, end = len(left) - shift, min(len(left) - shift + len(said), len(text))
    return text, [(start, end, kind)] if kind and start < end else []


def learn(windows: list[Labelled], seed: int = 12) -> Tagger:
    """The tagger of labelled windows and of MADE_WINDOWS made from these."""
    rng = random.Random(seed)
    known: dict[str, list[str]] = {k: [] for k in KINDS}
    for text, spans in windows:
        for start, end, kind in spans:
            if 0 < start and end < len(text):
                known[kind].append(text[start:end])
    grounds = [text if not spans else text[: spans[0][0]] + text[spans[-1][1] :] for text, spans in windows] or [""]
    every = windows + [made_window(rng.choice(grounds), rng, known) for _ in range(MADE_WINDOWS)]
    x = np.zeros((len(every), WIDTH), np.uint8)
    for i, (text, _) in enumerate(every):
        x[i, : len(text)] = codes(text)
    return trained(x, np.stack([tags_of(spans) for _, spans in every]))


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for v in texts_of(batch.column("text")):
        yield v.as_py()


def _sort(said: str, spans: list[Span]) -> int:
    """0 with spans, 1 with other digits or signs, 2 with neither."""
    return 0 if spans else 1 if TRIGGER.search(said) else 2


def fit(docs: DataFrame, most: int = CORPUS_WINDOWS) -> Tagger:
    """A tagger for `docs`, which has text. It learns from at most `most` windows of WIDTH characters, of each sort a third: those of least hash, each once. All
    texts are searched for them; a task holds no more than twice as many, and the driver no more than `most`. Without any, made-up ones serve."""
    share = most // 3

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: tuple[dict, ...] = ({}, {}, {})
        for batch in batches:
            for text in _texts(batch):
                for said, spans in labelled_windows(text):
                    heaps[_sort(said, spans)][hashlib.blake2b(said.encode("utf-8", "replace"), digest_size=8).hexdigest()] = (said, spans)
                for heap in heaps:
                    if len(heap) >= 2 * share:
                        for key in heapq.nlargest(len(heap) - share, heap):
                            del heap[key]
        rows = [{"sort": k, "key": key, "said": said, "spans": listed(spans)} for k, heap in enumerate(heaps) for key, (said, spans) in sorted(heap.items())[:share]]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("sort", pa.int32()), ("key", pa.string()), ("said", pa.string()), ("spans", pa.string())]))

    got = docs.select("text").mapInArrow(sample, "sort int, key string, said string, spans string")
    first = Window.partitionBy("sort").orderBy("key", "spans")
    kept = got.distinct().withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= share).orderBy("sort", "key", "spans").collect()
    return learn([(r["said"], [(int(a), int(b), k) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]) for r in kept])


# ---- reading texts


def starts_of(text: str) -> list[int]:
    """Where the windows of the text begin that hold a trigger: multiples of STRIDE."""
    out: set[int] = set()
    for m in TRIGGER.finditer(text):
        for p in (m.start(), m.end() - 1):
            out |= {p // STRIDE * STRIDE, max(0, p // STRIDE - 1) * STRIDE}
    return sorted(out)


def spans_in(tags: np.ndarray, margin: np.ndarray) -> Iterator[tuple[int, int, str, float]]:
    """Spans of a decoded window, with their scores over none."""
    t = 0
    while t < len(tags):
        if tags[t] % 2 == 1:
            end = t + 1
            while end < len(tags) and tags[end] == tags[t] + 1:
                end += 1
            yield t, end, KINDS[(tags[t] - 1) // 2], float(margin[t:end].sum())
            t = end
        else:
            t += 1


def reconciled(base: list[Span], found: Iterable[tuple[int, int, str, float]]) -> list[Span]:
    """The base spans and, of those found, the set of largest total score in which none overlaps another or a base span."""
    edges: list[tuple[int, int]] = []  # the base spans as separate stretches
    for a, b, _ in sorted(base):
        if edges and a < edges[-1][1]:
            edges[-1] = (edges[-1][0], max(b, edges[-1][1]))
        else:
            edges.append((a, b))
    best: dict[Span, float] = {}
    for a, b, kind, score in found:
        i = bisect.bisect_right(edges, (a, float("inf")))
        if not (i and edges[i - 1][1] > a) and not (i < len(edges) and edges[i][0] < b):
            best[a, b, kind] = max(score, best.get((a, b, kind), score))
    todo = sorted(best, key=lambda s: (s[1], s))
    ends = [s[1] for s in todo]
    totals, taken = [0.0], []
    for i, s in enumerate(todo):
        j = bisect.bisect_right(ends, s[0], 0, i)
        take = totals[j] + best[s]
        taken.append((take > totals[i], j))
        totals.append(max(take, totals[i]))
    out, i = [*base], len(todo)
    while i:
        yes, j = taken[i - 1]
        if yes:
            out.append(todo[i - 1])
        i = j if yes else i - 1
    return ordered(out)


def tag_texts(model: Tagger, texts: Iterable[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text. Windows of several texts are scored together, SCORED at a time; a long text's in turn."""
    waiting: list[tuple[str, list[Span], list]] = []
    queue: list[tuple[int, int, np.ndarray]] = []  # place in waiting, start, codes

    def score() -> None:
        if not queue:
            return
        x = np.zeros((len(queue), WIDTH), np.uint8)
        for i, (_, _, c) in enumerate(queue):
            x[i, : len(c)] = c
        tags, margins = model.decode(x)
        for i in np.flatnonzero(tags.any(1)):
            k, start, c = queue[i]
            text, _, found = waiting[k]
            for a, b, kind, total in spans_in(tags[i], margins[i]):
                cut = (a == 0 and start > 0) or (b >= len(c) and start + len(c) < len(text))
                if not cut and b <= len(c) and total >= LEAST_MARGIN * (b - a) and plausible(text, start + a, start + b, kind):
                    found.append((start + a, start + b, kind, total))
        queue.clear()

    for text in texts:
        waiting.append((text, base_spans(text), []))
        at = starts_of(text)
        if at:
            c = codes(text)
            for start in at:
                queue.append((len(waiting) - 1, start, c[start : start + WIDTH]))
                if len(queue) == SCORED:
                    score()
        if len(waiting) == 4096 or not queue:
            score()
            yield from ((base, reconciled(base, found)) for _, base, found in waiting)
            waiting.clear()
    score()
    yield from ((base, reconciled(base, found)) for _, base, found in waiting)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_personal(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, base and spans, each a string of kind:start:end in code points, and n_email, n_ip, n_card, n_phone of the base spans.

    A null text is an empty one. Rows that share a doc_id are judged one by one; other columns take no part. An empty table gives no row.
    """
    known = model or fit(docs)
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string())]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[] for _ in fields]
            for base, spans in tag_texts(known, _texts(batch)):
                for k, kind in enumerate(KINDS):
                    made[1 + k].append(sum(s[2] == kind for s in base))
                made[-2].append(listed(base))
                made[-1].append(listed(spans))
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, (_, t) in zip(made[1:], fields[1:], strict=True))], schema=pa.schema(fields))

    return docs.select("doc_id", "text").mapInArrow(rows, ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in fields))


def masked(text: str, spans: list[Span], mark: Callable[[str], str] = lambda kind: f"<{kind}>") -> str:
    """The text with each span replaced by its kind's mark; of overlapping ones the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], mark(kind)]
            at = b
    return "".join([*out, text[at:]])


def personal_digest(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_personal(docs)
    return found.selectExpr("doc_id", *(f"n_{k}" for k in KINDS), "sha2(base, 256) AS base_sha256", "spans")
