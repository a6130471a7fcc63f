"""Vectors: fitting to a dimension, hashed bags of words, exact search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of queries and of rows: two blocks meet in one matrix product.
QUERY_BLOCK, ROW_BLOCK = 512, 4096
#: Queries of a block whose cosines a task holds at once.
AT_ONCE = 128


def fit(vector: Column, dim: int) -> Column:
    """The first `dim` values scaled to length 1, as floats; null if there are too few values or all are zero."""
    head = F.transform(F.slice(vector, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((F.size(vector) >= dim) & (norm > 0), F.transform(head, lambda x: (x / norm).cast("float")))


def of_length(vector: Column, dim: int) -> Column:
    """The vector, or an error where it has another length; null stays null."""
    wrong = F.raise_error(F.concat(F.lit("a vector of length "), F.size(vector).cast("string"), F.lit(f" instead of {dim}")))
    return F.when(vector.isNull() | (F.size(vector) == dim), vector).otherwise(wrong.cast("array<float>"))


def encode(vector: np.ndarray) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def decode(blob: bytes) -> np.ndarray:
    if len(blob) % 4:
        raise ValueError("a vector takes four bytes per value")
    return np.frombuffer(blob, "<f4")


def encoded(vector: Column) -> Column:
    """Vectors as bytes, four a value."""
    return F.pandas_udf(lambda v: v.map(encode, na_action="ignore"), "binary")(vector)  # type: ignore[call-overload]


def decoded(blob: Column) -> Column:
    return F.pandas_udf(lambda b: b.map(decode, na_action="ignore"), "array<float>")(blob)  # type: ignore[call-overload]


def embed_tokens(tokens: Column, dim: int) -> Column:
    """Hashed bag of words of an array of tokens: counts per md5 bucket, not normalised. A batch's distinct tokens are hashed once each."""

    @F.arrow_udf("array<float>")
    def run(batch: pa.Array) -> pa.Array:
        words = batch.flatten().dictionary_encode()
        digests = b"".join(hashlib.md5(term.encode()).digest() for term in words.dictionary.to_pylist())
        bucket = (np.frombuffer(digests, ">u4")[::4] % dim).astype(np.int64)
        row = np.repeat(np.arange(len(batch)), batch.value_lengths().fill_null(0).to_numpy())
        counts = np.bincount(row * dim + bucket[words.indices.to_numpy()], minlength=len(batch) * dim).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * dim, pa.int32()), pa.array(counts))

    return run(tokens)


def _blocks(vectors: DataFrame, key: str, name: str, most: int) -> DataFrame:
    """`name`_ids, `name`_data, `name`_dim: up to `most` vectors of one length as the bytes of a matrix of unit rows. Null and zero
    vectors are left out."""

    def pack(ids: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        matrix = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32())], names=[f"{name}_ids", f"{name}_data", f"{name}_dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        for whole in batches:
            for from_ in range(0, whole.num_rows, most):
                batch = whole.slice(from_, most)
                sizes = np.unique(batch.column(1).value_lengths().to_numpy())
                if len(sizes) > 1 or (rows and sizes[0] != rows[0].shape[1]):
                    raise ValueError(f"vectors of lengths {sorted({*sizes.tolist(), *(r.shape[1] for r in rows)})} in one search")
                block = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(block, axis=1)
                good = norm > 0
                ids.append(batch.column(0).to_numpy()[good])
                rows.append(block[good] / norm[good, None])
                if sum(map(len, ids)) >= most:
                    yield pack(ids, rows)
                    ids, rows = [], []
        if sum(map(len, ids)):
            yield pack(ids, rows)

    return vectors.where("vector is not null").select(F.col(key).cast("long").alias(key), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, f"{name}_ids array<long>, {name}_data binary, {name}_dim int")


def _met(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Each block of queries beside each row of `rows`, which are blocks too, by a join on a part of the rows, of which every one gets all queries.

    A product without a key would make one side's blocks anew for each partition of the other, in Python processes of their own.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(parts)).cast("int").alias("_part")
    asked = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    return asked.join(rows.select("*", place), "_part").drop("_part")


def best_of_rows(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and columns of the k largest of each row of `sim`; of equal ones those of the smallest ids."""
    n = sim.shape[1]
    if n > k:
        edge = np.partition(sim, n - k, axis=1)[:, n - k]  # the k-th largest: all that are no smaller may be among the best
        query, at = np.nonzero(sim >= edge[:, None])
    else:
        query, at = np.divmod(np.arange(sim.size), max(n, 1))
    order = np.lexsort((ids[at], -sim[query, at], query))
    query, at = query[order], at[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], at[place < k]


def _slices(asked: np.ndarray, left: np.ndarray, ids: np.ndarray, right: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, row_id, sim of the k best rows of each query of a pair of blocks, AT_ONCE queries at a time."""
    for i in range(0, len(asked), AT_ONCE):
        sim = np.round(left[i : i + AT_ONCE] @ right.T, 6)
        query, at = best_of_rows(sim, ids, k)
        yield pa.RecordBatch.from_arrays([pa.array(asked[i : i + AT_ONCE][query]), pa.array(ids[at]), pa.array(sim[query, at])], names=["query_id", "row_id", "sim"])


def search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, row_id, sim, rank: for each query (query_id, vector) the k rows (row_id, vector) of largest cosine.

    Exact: queries and rows are packed to blocks, each pair of blocks is one matrix product in a task, which hands on the k best
    of every query, and a window takes the k best of those. So no task holds more than two blocks and their product, and nothing
    passes through the driver. Cosines are taken to six decimals; ties go to the smaller row_id. Null or zero vectors are never
    found. Vectors of unlike lengths are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_data, q_dim, r_ids, r_data, r_dim = (batch.column(j)[i] for j in range(6))
                if q_dim.as_py() != r_dim.as_py():
                    raise ValueError(f"queries have vectors of length {q_dim}, rows of {r_dim}")
                asked, ids = q_ids.values.to_numpy(), r_ids.values.to_numpy()
                left, right = (np.frombuffer(d.as_buffer(), np.float64).reshape(-1, q_dim.as_py()) for d in (q_data, r_data))
                yield from _slices(asked, left, ids, right, k)

    met = _met(_blocks(queries, "query_id", "q", QUERY_BLOCK), _blocks(rows, "row_id", "r", ROW_BLOCK))
    found = met.mapInArrow(run, "query_id long, row_id long, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Stored blocks from which a search looks at their bounds first; fewer are all read. The results are the same.
BOUNDED = 64
#: Rows whose vectors are the seeds of clusters, at most, and rows of a cluster's share.
SEEDS, SEED_ROWS = 256, 1024
STORED = "block long, ids array<long>, data binary, dim int, n int, centroid array<double>, reach double"


def _unit(data: bytes, dim: int) -> np.ndarray:
    """The rows of a stored block, each of length 1."""
    rows = np.frombuffer(data, "<f4").reshape(-1, dim).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def stored_blocks(rows: DataFrame, count: int) -> DataFrame:
    """Blocks of the vectors of `rows` (row_id, vector), of which there are about `count`, to be written once and searched often.

    Rows are dealt to the seed nearest to them, seeds being rows by hash, and packed by cluster into blocks of up to ROW_BLOCK: ids, data (floats),
    centroid (length 1) and reach, the smallest cosine of a row and the centroid. A cluster is packed as its rows come in, in as many tasks as
    it needs. Null and zero vectors are left out; unlike lengths are an error.
    """
    seeds = max(1, min(SEEDS, count // SEED_ROWS))
    plain = rows.where("vector is not null").select(F.col("row_id").cast("long").alias("row_id"), F.col("vector").cast("array<float>").alias("vector"))
    first = [r["vector"] for r in plain.orderBy(F.xxhash64("row_id"), "row_id").limit(seeds).collect()]  # SEEDS rows at most
    heads = np.array(first, np.float64) if len({len(v) for v in first}) == 1 else None
    if heads is not None:
        heads = heads[np.linalg.norm(heads, axis=1) > 0]
        heads = heads / np.linalg.norm(heads, axis=1)[:, None]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.unique(batch.column(1).value_lengths().to_numpy())
            if heads is None or len(sizes) != 1 or (len(heads) and sizes[0] != heads.shape[1]):
                raise ValueError("vectors of unlike lengths in one index")
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            good = np.linalg.norm(flat.astype(np.float64), axis=1) > 0
            near = (flat[good].astype(np.float64) @ heads.T).argmax(1) if len(heads) else np.zeros(int(good.sum()), int)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(batch.column(0).to_numpy()[good], pa.int64()), pa.array([v.astype("<f4").tobytes() for v in flat[good]], pa.binary())], names=["cluster", "row_id", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        cluster = None

        def block() -> pa.RecordBatch:
            dim = len(held[0][1]) // 4
            data = b"".join(v for _, v in held)
            unit = _unit(data, dim)
            centre = unit.mean(0)
            size = np.linalg.norm(centre)
            centre = centre / size if size > 0 else unit[0]
            out = [pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([dim], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float((unit @ centre).min())])]
            return pa.RecordBatch.from_arrays(out, names=["ids", "data", "dim", "n", "centroid", "reach"])

        for batch in batches:
            for c, i, v in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if held and (c != cluster or len(held) == ROW_BLOCK):
                    yield block()
                    held = []
                cluster = c
                held.append((i, v))
        if held:
            yield block()

    spread = max(1, count // (seeds * ROW_BLOCK * 4))
    dealt = plain.mapInArrow(deal, "cluster int, row_id long, data binary").repartition("cluster", F.pmod(F.xxhash64("row_id"), F.lit(spread))).sortWithinPartitions("cluster")
    made = dealt.mapInArrow(pack, "ids array<long>, data binary, dim int, n int, centroid array<double>, reach double")
    return made.select(F.monotonically_increasing_id().alias("block"), "*")


def _products(met: DataFrame, k: int) -> DataFrame:
    """query_id, row_id, sim: of each row of `met`, a block (ids, data, dim) beside queries (q_ids, q_data, q_dim), every query's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_data, q_dim, ids, data, dim = (batch.column(j)[i] for j in range(6))
                if q_dim.as_py() != dim.as_py():
                    raise ValueError(f"queries have vectors of length {q_dim}, rows of {dim}")
                asked, own = q_ids.values.to_numpy(), ids.values.to_numpy()
                yield from _slices(asked, np.frombuffer(q_data.as_buffer(), np.float64).reshape(-1, q_dim.as_py()), own, _unit(data.as_buffer(), dim.as_py()), k)

    return met.select("q_ids", "q_data", "q_dim", "ids", "data", "dim").mapInArrow(run, "query_id long, row_id long, sim double")


def bounds(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, block, n, bound: no row of the block has a larger cosine with the query. By the angles: that of query and centroid, less the widest within the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_data, q_dim, block, n, centres, reach = (batch.column(j)[i] for j in range(7))
                asked, own = q_ids.values.to_numpy(), block.values.to_numpy()
                centre = centres.values.flatten().to_numpy().reshape(len(own), -1)
                if centre.shape[1] != q_dim.as_py():
                    raise ValueError(f"queries have vectors of length {q_dim}, rows of {centre.shape[1]}")
                turn = np.arccos(np.clip(np.frombuffer(q_data.as_buffer(), np.float64).reshape(-1, q_dim.as_py()) @ centre.T, -1, 1))
                bound = np.cos(np.maximum(0, turn - np.arccos(np.clip(reach.values.to_numpy(), -1, 1))))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, len(own))), pa.array(np.tile(own, len(asked))), pa.array(np.tile(n.values.to_numpy(), len(asked)), pa.int32()), pa.array(bound.ravel())], names=["query_id", "block", "n", "bound"])

    several = blocks.groupBy(F.floor(F.col("block") / ROW_BLOCK), F.pmod(F.xxhash64("block"), F.lit(8))).agg(*(F.collect_list(c).alias(c) for c in ("block", "n", "centroid", "reach")))
    met = _met(_blocks(queries, "query_id", "q", QUERY_BLOCK), several.select("block", "n", "centroid", "reach"))  # queries in blocks against centroids in blocks
    return met.mapInArrow(run, "query_id long, block long, n int, bound double")


def search_blocks(queries: DataFrame, blocks: DataFrame, k: int, bounded: bool | None = None) -> DataFrame:
    """What search() finds, among stored blocks. If `bounded`, by default from BOUNDED blocks on, blocks are read in two steps: those of
    largest bounds that hold k rows together, then those whose bound reaches the k-th cosine found there."""
    bounded = blocks.count() >= BOUNDED if bounded is None else bounded
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "row_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not bounded:
        return best(_products(_met(_blocks(queries, "query_id", "q", QUERY_BLOCK), blocks.select("ids", "data", "dim")), k))
    exact, first, rest = _two_steps(queries, blocks, k)
    return best(first.unionByName(exact(rest)))


def _two_steps(queries: DataFrame, blocks: DataFrame, k: int):  # type: ignore[no-untyped-def]
    reach = bounds(queries, blocks.select("block", "n", "centroid", "reach"))
    upto = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = reach.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    vector = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))

    def exact(pairs: DataFrame) -> DataFrame:
        """The k best of each pair of a query and a block; the queries of a block meet it some QUERY_BLOCK at a time."""
        own = pairs.select("query_id", "block").join(vector, "query_id")
        dealt = own.repartition("block", F.pmod(F.xxhash64("query_id"), F.lit(8))).sortWithinPartitions("block")

        def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, rows, block = [], [], None

            def out() -> pa.RecordBatch:
                m = np.array(rows)
                m = m / np.linalg.norm(m, axis=1)[:, None]
                return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], names=["block", "q_ids", "q_data", "q_dim"])

            for batch in batches:
                for q, b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if ids and (b != block or len(ids) == QUERY_BLOCK):
                        yield out()
                        ids, rows = [], []
                    block = b
                    ids.append(q)
                    rows.append(v)
            if ids:
                yield out()

        met = dealt.select("query_id", "block", "vector").mapInArrow(group, "block long, q_ids array<long>, q_data binary, q_dim int")
        return _products(met.join(blocks.select("block", "ids", "data", "dim"), "block"), k)

    first = exact(placed.where(F.col("_before") < k))
    nth = Window.partitionBy("query_id").orderBy(F.desc("sim"))
    least = first.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") == k).select("query_id", F.col("sim").alias("_least"))
    rest = placed.where(F.col("_before") >= k).join(least, "query_id", "left").where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - 1e-6))
    return exact, first, rest


def blocks_read(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, blocks, read: stored blocks, and those that a bounded search for k reads."""
    _, _, rest = _two_steps(queries, blocks, k)
    reach = bounds(queries, blocks.select("block", "n", "centroid", "reach"))
    upto = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    some = reach.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("_before") < k).alias("_first"))
    more = rest.groupBy("query_id").agg(F.count("*").alias("_more"))
    return some.join(more, "query_id", "left").select("query_id", "blocks", (F.col("_first") + F.coalesce("_more", F.lit(0))).alias("read"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """n, least, p10, median, mean of the cosines of two vectors (id, vector) of each id: the vectors of two sets of one text.

    Of n sorted cosines the median is that at place n / 2 and p10 that at n / 10, counted from 0.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    met = left.select("id", F.col("vector").alias("a")).join(right.select("id", F.col("vector").alias("b")), "id")
    sims = met.select(F.round(dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b")), 6).alias("s"))
    counted = sims.groupBy("s").agg(F.count("*").alias("c"))
    upto = counted.withColumn("_to", F.sum("c").over(Window.orderBy("s"))).crossJoin(sims.agg(F.count("*").alias("n")))  # at most 2,000,001 values
    at = lambda part: F.min(F.when(F.col("_to") > F.floor(F.col("n") / part), F.col("s")))
    return upto.agg(F.max("n").alias("n"), F.min("s").alias("least"), at(10).alias("p10"), at(2).alias("median"), F.round(F.sum(F.col("s") * F.col("c")) / F.max("n"), 6).alias("mean"))


def top_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """n, agree: queries of two results of search(), and those whose first hits are the same row."""
    first = lambda hits, name: hits.where("rank = 1").select("query_id", F.col("row_id").alias(name))
    met = first(left, "_a").join(first(right, "_b"), "query_id", "full")
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("_a") == F.col("_b")).alias("agree"))
