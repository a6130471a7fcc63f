"""Helpers that the training-data operators share: checkpoints and a vectorised word scanner.

The scanner works on the UTF-8 buffer of an Arrow string column, so that hashing the words of a
batch costs a few numpy passes over its bytes instead of a Python step for each word.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contracts: space and \t \n \v \f \r, and nothing else.
BLANKS = b" \t\n\x0b\x0c\r"
#: Text bytes that one numpy pass takes at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 18
#: Rows that a Python task hands back to Spark at a time.
OUT_ROWS = 1 << 16

#: Two primes below 2**31 and a base of large order for each: a word's hash is its polynomial modulo both, so that no
#: pattern of letters makes unlike words equal, as patterns do modulo a power of two.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525)
#: Bytes from which a word is hashed by itself: up to here the sum of its terms stays below 2**64.
LONG_WORD = 1 << 24

_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share.

    Only a local master, as in tests, may leave it unset, and then gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo a prime, and of its inverse."""
    if prime not in _powers or len(_powers[prime][0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for step in (base, pow(base, -1, prime)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:  # the next powers are those so far times the one after them
                more = min(done, size - done)
                out[done : done + more] = out[:more] * np.uint64(pow(step, done, prime)) % np.uint64(prime)
                done += more
            made.append(out)
        _powers[prime] = (made[0], made[1])
    return _powers[prime]


def blank_table(lower: bool) -> np.ndarray:
    """Byte to symbol: 0 parts words, any other byte is itself plus one; with `lower`, A-Z become a-z."""
    symbols = np.arange(1, 257, dtype=np.uint64)
    if lower:
        symbols[65:91] += 32
    symbols[list(BLANKS)] = 0
    return symbols


@dataclass
class Scan:
    """The words of some consecutive texts: byte ranges, number of the text, 64-bit hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of text i the words are first[i] up to first[i + 1]


def texts_of(column: pa.Array) -> pa.Array:
    """The column as one array of strings with 64-bit offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with at most `most` bytes (or one row): from, to, their bytes, offsets of the rows in these."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def span_hashes(value: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of symbols (below 2**9), by prefix sums of two polynomials modulo primes."""
    parts = []
    for prime, base in zip(PRIMES, BASES, strict=True):
        up, down = _power_tables(prime, base, len(value) + 1)
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * up[: len(value)], out=total[1:])
        parts.append((total[ends] - total[starts]) % np.uint64(prime) * down[starts] % np.uint64(prime))
    out = mix((parts[0] << np.uint64(32) | parts[1]) + (ends - starts).astype(np.uint64) * _ODD)
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(value[starts[i] : ends[i]].astype(np.uint16).tobytes(), digest_size=8).digest())
    return out


def scan(data: np.ndarray, bounds: np.ndarray, symbols: np.ndarray) -> Scan:
    """Find and hash the words of the texts that `bounds` parts. No word crosses a bound."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Scan(data, none, none, none, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
    value = symbols[data]
    inside = value != 0
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Scan(data, starts, ends, np.searchsorted(bounds, starts, side="right") - 1, span_hashes(value, starts, ends), np.searchsorted(starts, bounds))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, whatever texts they are of."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n + j]
    return mix(out + np.uint64(k))


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet below the shared folder and read back, so that its lineage ends at files that all executors see."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(rows: DataFrame, part: list[str], order: list[str], name: str) -> DataFrame:
    """`rows`, stored, with idx (from 0 within each value of `part`, by `order`, nulls first) and n (rows of that value).

    The rows are sorted over ranges of all keys, so that one value of `part` spreads over as many tasks as it needs, and rows alike in all keys
    are told apart by their place in the input. Rows of a range are counted per value; only these counts, of which there are no more than ranges and
    values together, meet in a window.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*part, *order)] + [F.col("_salt").asc()]
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    placed = stored(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    runs = placed.groupBy(*part, "_pid").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*part)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = [F.col(c).alias(f"_of_{c}") for c in part]
    runs = runs.select(*named, F.col("_pid").alias("_run"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    same = F.col("_pid") == F.col("_run")
    for c in part:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = placed.join(runs, same)
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")
