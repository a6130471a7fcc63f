"""Vectors of queries that were asked before, beside the index.

Two append-only tables: vectors (space, query, vector), a row for each query that was embedded, and uses (space, query, n, at), a row for each query of
each batch. Nothing is rewritten by a search. fold() sums the uses up, drops what has aged or is used least, and starts both tables anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import exists
from . import versions as VS

VECTORS, USES = "space string, query string, vector array<float>", "space string, query string, n long, at long"


@dataclass(frozen=True)
class QueryCache:
    spark: SparkSession
    root: str

    def _generation(self) -> str:
        """The folder that is in use: the newest one that fold() finished."""
        done = [n for n in VS.folder_names(self.spark, self.root) if exists(self.spark, f"{self.root}/{n}/READY")]
        return f"{self.root}/{max(done)}" if done else f"{self.root}/000000000000"

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = f"{self._generation()}/{name}"
        return self.spark.read.schema(schema).parquet(f"{folder}/*") if VS.folder_names(self.spark, folder) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self._generation()}/{name}/{uuid.uuid4().hex}")

    def embedded(self, asked: DataFrame, space: str, embed: Callable[[DataFrame], DataFrame], now: int, most: int) -> DataFrame:
        """`asked` (query_id, text) with vector. `embed` gets the rows of unknown queries, each query once, and adds vector; it isn't called if all
        are known. Queries are the same if their normal forms are. With `most` 0 nothing is looked up or kept."""
        if most <= 0:
            return embed(asked)
        wanted = asked.withColumn("query", T.normal_query(F.col("text")))
        known = self._read("vectors", VECTORS).where(F.col("space") == space).dropDuplicates(["query"]).select("query", "vector")
        missing = wanted.where("query <> ''").join(known, "query", "left_anti").groupBy("query").agg(F.min("query_id").alias("query_id"), F.min("text").alias("text"))
        if not missing.isEmpty():
            self._append("vectors", embed(missing).select(F.lit(space).alias("space"), "query", "vector"))
            known = self._read("vectors", VECTORS).where(F.col("space") == space).dropDuplicates(["query"]).select("query", "vector")
        self._append("uses", wanted.where("query <> ''").groupBy("query").agg(F.count("*").alias("n")).select(F.lit(space).alias("space"), "query", "n", F.lit(now).cast("long").alias("at")))
        return wanted.join(known, "query", "left").select(*asked.columns, "vector")

    def known(self) -> DataFrame:
        """space, query, vector, hits, last_used."""
        uses = self._read("uses", USES).groupBy("space", "query").agg(F.sum("n").alias("hits"), F.max("at").alias("last_used"))
        return self._read("vectors", VECTORS).dropDuplicates(["space", "query"]).join(uses, ["space", "query"], "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "last_used": F.coalesce("last_used", F.lit(0))})

    def fold(self, most: int, oldest: int) -> int:
        """Keep what was used at `oldest` or later, and of that the `most` used queries, of equally used ones the latest. How many stay.

        The least number of uses that stays comes from a count of queries per number of uses, and of those with just so many the least time from
        a count per time; so no table is sorted as a whole. Where times tie, all of them stay.
        """
        fresh = self.known().where(F.col("last_used") >= oldest)

        def edge(rows: DataFrame, column: str, room: int) -> tuple[int | None, int]:
            """The smallest value of which all rows with it or a larger one fit in `room`, and the room left then; values per count are few."""
            value, left = None, room
            for r in rows.groupBy(column).count().orderBy(F.desc(column)).toLocalIterator():
                if r["count"] > left:
                    break
                value, left = r[column], left - r["count"]
            return value, left

        hits, left = edge(fresh, "hits", most)
        stays = F.col("hits") >= hits if hits is not None else F.lit(False)
        below = fresh.where(F.col("hits") < hits) if hits is not None else fresh
        next_ = below.agg(F.max("hits")).first()[0]
        if left > 0 and next_ is not None:
            at, _ = edge(below.where(F.col("hits") == next_), "last_used", left)
            if at is not None:
                stays = stays | ((F.col("hits") == next_) & (F.col("last_used") >= at))
        kept = fresh.where(stays)
        old = self._generation()
        new = f"{self.root}/{int(old.rsplit('/', 1)[1]) + 1:012d}"
        kept.select("space", "query", "vector").write.mode("overwrite").parquet(f"{new}/vectors/folded")
        kept.select("space", "query", F.col("hits").alias("n"), F.col("last_used").alias("at")).write.mode("overwrite").parquet(f"{new}/uses/folded")
        n = self.spark.read.parquet(f"{new}/vectors/folded").count()
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{new}/READY")
        VS.remove(self.spark, old)
        return n
