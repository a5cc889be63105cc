"""Structured Streaming forms of the append-only logs (STM-1 to 4, 7)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.operators import rank
from corvane.operators.labels import new_labels


def seen_once(items: DataFrame) -> DataFrame:
    """STM-1: each (source, id) once ever.

    The ids are a state without time-out.  With the RocksDB state store, which session.build sets, it lives on disk, a
    shard a shuffle partition, and what memory holds is its cache and the Bloom filters of its files.
    """
    return items.dropDuplicates(["source", "id"])


def label_sink(spark: SparkSession, path: str, read_ledger):
    """STM-2: a foreachBatch writer that adds labels the ledger lacks; a batch written twice adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        new_labels(batch, read_ledger()).write.mode("append").parquet(path)

    return write


def week_windows(runs: DataFrame, watermark: str = "1 day") -> DataFrame:
    """STM-4: counts over seven days, a new window each day."""
    return runs.withWatermark("ts", watermark).groupBy(F.window("ts", "7 days", "1 day")).agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("paper").alias("papers"))


class _Unsaved(StatefulProcessor):
    """Of one paper: when it was posted, the notes that hold its timer, and the timer."""

    def __init__(self, wait_ms: int) -> None:
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.posted = handle.getValueState("posted", "at long, done boolean")
        self.notes = handle.getMapState("notes", "note string", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, done = self.posted.get() if self.posted.exists() else (-1, False)
        saved = False
        for pdf in rows:
            for ts, kind, note in sorted(zip(pdf["ts"], pdf["kind"], pdf["note"].fillna(""), strict=True)):
                now = int(ts.value // 1_000_000)
                if kind == "posted" and at < 0:
                    at = now
                elif kind == "staged":
                    self.notes.updateValue((note,), (now,))
                elif kind == "unstaged" and self.notes.containsKey((note,)):
                    self.notes.removeKey((note,))
                saved = saved or kind == "saved"
        if saved and not done:
            done = True
            yield pd.DataFrame({"paper": [key[0]], "label_type": ["saved-implicit"]})
        self.posted.update((at, done))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if at >= 0 and not done and not any(True for _ in self.notes.keys()):
            self.handle.registerTimer(max(at + self.wait, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, done = self.posted.get()
        if not done:
            self.posted.update((at, True))
            yield pd.DataFrame({"paper": [key[0]], "label_type": ["unsaved-weak-negative"]})

    def close(self) -> None:
        pass


def unsaved_timer(events: DataFrame, days: int = 30) -> DataFrame:
    """STM-3: paper and label, once a paper: saved-implicit, or a weak negative so many days after its posting.

    events: paper, ts, kind in (posted, staged, unstaged, saved) and note, with a watermark on ts.  While a staged note of
    the paper is there its timer is deleted; when the last one has gone it is registered again, for the same day, or for
    at once where that has passed.  Needs the RocksDB state store (session.build sets it).
    """
    return events.groupBy("paper").transformWithStateInPandas(_Unsaved(days * 86_400_000), "paper long, label_type string", "Append", "EventTime")


def scored_stream(items: DataFrame, terms: DataFrame) -> DataFrame:
    """A stream's items with score and matched terms, as rank.scored has them; all of it inside the row, so append mode does.

    The profile is read once, when the stream starts, and holds at most rank.FEW_TERMS terms.
    """
    return rank.scored_rows(items, terms)
