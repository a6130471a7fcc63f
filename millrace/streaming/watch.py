"""Continuous maintenance: every trigger compares a fresh listing with what is known, since file streams see no edits."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.errors import Locked
from ..sources.storage import read_text, write_text

T = TypeVar("T")


def watch(spark: SparkSession, rescan: Callable[[int], None], every: str = "2 seconds", checkpoint: str | None = None) -> StreamingQuery:
    """Call `rescan(batch)` at every trigger. `checkpoint` belongs in a folder that outlives the driver."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, batch: rescan(batch)).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


#: Seconds without a change before a rescan, and seconds after which one is made anyway.
QUIET_S, SAFETY_S = 2.0, 600.0


class Debounce:
    """When to rescan: once a listing has stopped changing for a while, or has not been looked into for long.

    `settings` reads the settings anew and `check` tells what is wrong with them; the last good ones stay in use. `known` is what state() gave
    before a restart; `parse` makes settings of what `dump` made of them. Times are seconds of a clock that outlives the process.
    """

    def __init__(self, settings: Callable[[], T], check: Callable[[T], list[str]], quiet: float = QUIET_S, safety: float = SAFETY_S, dump: Callable[[T], object] = lambda s: None, parse: Callable[[object], T | None] = lambda s: None) -> None:
        self.read, self.check, self.quiet, self.safety, self.dump, self.parse = settings, check, quiet, safety, dump, parse
        self.settings: T | None = None
        self.seen: object = None
        self.changed_at: float | None = None
        self.scanned_at: float | None = None
        self.faults: list[str] = []
        self._reload()

    def state(self) -> str:
        return json.dumps({"seen": self.seen, "changed_at": self.changed_at, "scanned_at": self.scanned_at, "settings": self.dump(self.settings)})

    def restore(self, state: str) -> None:
        """Go on from what state() gave: the quiet time runs on, and the settings that were good then stay if those of now are not."""
        told = json.loads(state)
        self.seen, self.changed_at, self.scanned_at = told["seen"], told["changed_at"], told["scanned_at"]
        if self.faults or self.settings is None:
            self.settings = self.parse(told["settings"])

    def due(self, mark: object, now: float) -> bool:
        """Whether a tick at `now` that finds the folders in the state `mark` is one to rescan at."""
        self._reload()
        mark = json.loads(json.dumps(mark))  # as a restart would read it
        if mark != self.seen:
            self.seen, self.changed_at = mark, now
        waited = self.changed_at is not None and now - self.changed_at >= self.quiet
        overdue = self.scanned_at is not None and now - self.scanned_at >= self.safety
        if self.settings is None or not (waited or overdue or self.scanned_at is None):
            return False
        self.changed_at, self.scanned_at = None, now
        return True

    def again(self, now: float) -> None:
        """The rescan that was due did not come off: it is due once more after a quiet time."""
        self.changed_at = now

    def _reload(self) -> None:
        try:
            fresh = self.read()
            self.faults = self.check(fresh)
        except ValueError as e:
            self.faults = [str(e)]
        if not self.faults:
            self.settings = fresh


def listing_mark(files: DataFrame) -> list:
    """The state of a listing (path, size, mtime) in one row: it differs where a file came, went or changed."""
    hashed = F.xxhash64("path", "size", "mtime")
    row = files.agg(F.count("*"), F.sum(hashed.cast("decimal(38,0)")).cast("string"), F.bit_xor(hashed)).first()
    return list(row)


def watch_folder(spark: SparkSession, listing: Callable[[], DataFrame], rescan: Callable[[T], None], debounce: Debounce, every: str = "1 second", checkpoint: str | None = None) -> StreamingQuery:
    """Call `rescan` with the settings whenever the listing has changed and then been quiet, and at least every SAFETY_S.

    With a `checkpoint`, what the debounce knows is kept beside it after each tick, and a watch that starts there goes on from it: a change that was seen
    but not yet scanned, or whose scan was cut off, is scanned then. A rescan that another writer locks out is due again.
    """
    memory = f"{checkpoint}/debounce.json" if checkpoint else None
    if memory and (known := read_text(spark, memory)):
        debounce.restore(known)
    kept = [debounce.state()]

    def tick(_: int) -> None:
        now = time.time()
        if debounce.due(listing_mark(listing()), now):
            try:
                rescan(debounce.settings)
            except Locked:
                debounce.again(now)
        if memory and debounce.state() != kept[0]:
            kept[0] = debounce.state()
            write_text(spark, memory, kept[0])

    return watch(spark, tick, every, f"{checkpoint}/ticks" if checkpoint else None)


def quiet_bursts(events: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of change events per key, each ended by a quiet gap: key, from, to, events. For streams and tables alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("key", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "events")
