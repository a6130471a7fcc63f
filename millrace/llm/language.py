"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of n-grams (n = 1..3, over the letters of any script) that both hold, presence only,
divided by the root of the product of what each shares with itself. N-grams are told apart by a hash of their code points, so
no alphabet is left out. Nyström landmarks are texts of the training sample; one-versus-rest kernel ridge regression is
solved on them, and texts are scored in batches by matrix products.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import OUT_ROWS

#: Bits of an n-gram's hash, and letters of the longest n-gram.
BITS, LONGEST = 18, 3
#: Texts per language in the training sample, landmarks among them, and the ridge.
SAMPLE, LANDMARKS, RIDGE = 256, 48, 1e-2
#: Characters of a text that are learnt from, at most.
SAMPLE_CHARS = 1 << 16
#: Texts scored by one matrix product.
BATCH = 256

_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@dataclass
class Model:
    """Everything that scoring needs; its size is bounded by the parameters above and the number of languages."""

    langs: list[str]
    column: np.ndarray  # n-gram code to landmark column, -1 for none
    landmarks: np.ndarray  # columns x landmarks, presence
    sizes: np.ndarray  # n-grams of each landmark
    weights: np.ndarray  # landmarks x languages


@cache
def letters() -> np.ndarray:
    """Code point to symbol: a letter or a mark on one is its small form, all else 0."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] in "LM":
            small = c.lower()
            out[point] = ord(small) if len(small) == 1 else point
    return out


def gram_codes(text: str) -> np.ndarray:
    """Distinct codes of the n-grams of the whole text; a run of other than letters is one gap."""
    s = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(s) > 1:
        s = s[(s != 0) | np.concatenate([[True], s[:-1] != 0])]
    s = np.concatenate([[0], s, [0]]).astype(np.uint32)
    seen = np.zeros(LONGEST << BITS, bool)
    code = np.zeros(len(s), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(s) < n:
            break
        code = code[: len(s) - n + 1] * _STEP * _SPREAD + s[n - 1 :] + np.uint32(1)
        mixed = (code ^ (code >> np.uint32(15))) * _SPREAD
        seen[((n - 1) << BITS) + (mixed >> np.uint32(32 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def _kernel(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return shared / np.sqrt(np.maximum(1, a)[:, None] * np.maximum(1, b)[None, :])


def _presence(codes: list[np.ndarray], column: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(codes), width), np.float32)
    for i, c in enumerate(codes):
        at = column[c]
        out[i, at[at >= 0]] = 1
    return out


def fit(samples: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression on Nyström features of (lang, text) samples; None without a sample that has letters."""
    samples = [(lang, text) for lang, text in samples if any(map(str.isalpha, text))]
    if not samples:
        return None
    langs = sorted({lang for lang, _ in samples})
    codes = [gram_codes(text) for _, text in samples]
    sizes = np.array([len(c) for c in codes], np.float64)
    chosen = []
    for lang in langs:  # the samples of a language come in a hashed order
        chosen += [i for i, (own, _) in enumerate(samples) if own == lang][:landmarks]
    used = np.unique(np.concatenate([codes[i] for i in chosen]))
    column = np.full(LONGEST << BITS, -1, np.int32)
    column[used] = np.arange(len(used))
    marks = _presence([codes[i] for i in chosen], column, len(used))
    own = _kernel(marks @ marks.T, sizes[chosen], sizes[chosen])
    values, vectors = np.linalg.eigh(own.astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([_kernel(_presence(codes[i : i + BATCH], column, len(used)) @ marks.T, sizes[i : i + BATCH], sizes[chosen]) for i in range(0, len(codes), BATCH)]) @ root
    goal = np.array([[1.0 if lang == own else -1.0 for lang in langs] for own, _ in samples])
    share = np.array([1.0 / sum(own == lang for own, _ in samples) for lang, _ in samples])
    left = features.T @ (features * share[:, None]) + ridge * np.eye(features.shape[1]) / len(samples)
    weights = root @ np.linalg.solve(left, features.T @ (goal * share[:, None]))
    return Model(langs, column, np.ascontiguousarray(marks.T), sizes[chosen], weights)


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and scores; the score is the winner's share after a logistic squash of the one-versus-rest values."""
    codes = [gram_codes(t) for t in texts]
    shared = _presence(codes, model.column, model.landmarks.shape[0]) @ model.landmarks
    values = _kernel(shared, np.array([len(c) for c in codes], np.float64), model.sizes) @ model.weights
    squashed = 1 / (1 + np.exp(-4 * values))
    best = values.argmax(axis=1)
    rows = np.arange(len(texts))
    return [model.langs[i] for i in best], np.clip(squashed[rows, best] / squashed.sum(axis=1), 0, 1)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out, and not learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = SAMPLE, strata: int = 8) -> list[tuple[str, str]]:
    """At most `per_lang` (lang, text) per language, by a hash of id and text, from rows that are not held out; rows alike in both count once. Of a text
    longer than SAMPLE_CHARS the first so many characters are learnt from, so that the driver gets 64 MB a language at most, of letters of four bytes.

    Each language is dealt to `strata` windows, whose tops are taken before the shuffle too, so no task gets a language. The texts are then
    fetched by language, id and text hash, those that were ranked and no others.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("doc_id", "lang", F.xxhash64("text").alias("_t"), F.xxhash64("doc_id", F.lit("sample")).alias("_h"), "text")
    top = Window.partitionBy("lang", F.pmod("_h", F.lit(strata))).orderBy("_h", "doc_id", "_t")
    keys = rows.select("lang", "doc_id", "_t", "_h")
    kept = keys.withColumn("_n", F.dense_rank().over(top)).where(F.col("_n") <= max(1, per_lang // strata)).select("lang", "doc_id", "_t").distinct()
    chosen = kept.collect()  # bounded: per_lang keys a language
    if not chosen:
        return []
    named = docs.sparkSession.createDataFrame(chosen, "lang string, doc_id long, _t long")
    piece = rows.where(F.col("doc_id").isin([r["doc_id"] for r in chosen])).withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    found = piece.join(named, ["lang", "doc_id", "_t"], "left_semi").groupBy("lang", "_h", "doc_id", "_t").agg(F.min("text").alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(found, key=lambda r: (r["lang"], r["_h"], r["doc_id"], r["text"]))]


def train(docs: DataFrame) -> Model | None:
    return fit(training_sample(docs))


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of `docs`, language and score, under `names`. `und` with score 0 where the text is null or has no letter,
    or where there is no model because no row could be learnt from."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # bounded by the parameters, not by the input
    at = len(keep)
    text_at = keep.index("text") if "text" in keep else at + 1  # a text is sent once
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for whole in batches:
            for from_ in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(from_, OUT_ROWS)
                langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                todo = [i for i in range(batch.num_rows) if own and batch.column(at)[i].as_py()]
                for j in range(0, len(todo), BATCH):
                    rows = todo[j : j + BATCH]
                    found, values = predict(own, [batch.column(text_at)[i].as_py() for i in rows])
                    for i, lang, value in zip(rows, found, values, strict=True):
                        langs[i], scores[i] = lang, value
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(langs), pa.array(scores)], names=[*keep, *names])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    more = [] if "text" in keep else [F.when(lettered, F.col("text")).alias("_text")]
    return docs.select(*keep, lettered.alias("_lettered"), *more).mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def language_digest(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, lang_pred, score.

    Only text and non-null lang of rows that are not held out are learnt from, and prediction reads the text alone. A null or
    letterless text is `und` with score 0; rows with a null doc_id are predicted but not learnt from. Texts are taken whole.
    Equal texts get equal results, so repeated rows do; other columns are ignored; an empty table gives an empty one.
    """
    plain = docs.select("doc_id", "text", "lang")
    return identify(plain, train(plain)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """`docs` without the rows whose text is null or has no letter, which is all that identification rejects. That holds too
    where there is no model because no row has a language to learn from."""
    plain = docs.select("doc_id", "text", "lang")
    model = train(plain)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    columns = docs.columns
    told = identify(docs, model, tuple(columns), ("_lang_pred", "_lang_score"))
    return told.where(F.col("_lang_pred") != "und").select(*columns)
