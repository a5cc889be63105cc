"""Writers as Python data sources: a file a note, and chat posts with receipts (SNK-6, 9 to 11)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row

from . import shared


@dataclass
class Written(WriterCommitMessage):
    """Finished files of a task under the names they wait under, and the names they are to get."""

    files: list[tuple[str, str]] = field(default_factory=list)


class NoteWriter(DataSourceWriter):
    """A file a row (file, value): tasks write under waiting names, commit gives the names out, abort removes what waits."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        done = Written()
        for row in iterator:
            waiting = f"{self.path}/.waiting-{uuid.uuid4().hex}"
            shared.write(waiting, row["value"].encode())
            done.files.append((waiting, row["file"]))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        for waiting, name in sorted((f for m in messages if m for f in m.files), key=lambda f: f[1]):
            stem, dot, ending = name.rpartition(".")
            k = 1
            while not shared.claim(waiting, f"{self.path}/{name if k == 1 else f'{stem}-{k}{dot}{ending}'}"):
                k += 1

    def abort(self, messages: list[Written | None]) -> None:
        for waiting, _ in (f for m in messages if m for f in m.files):
            shared.remove(waiting)


class Notes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corvane_notes"

    def writer(self, schema, overwrite: bool) -> NoteWriter:
        return NoteWriter(self.options["path"])


def write_notes(notes: DataFrame, path: str) -> None:
    """SNK-9 to 11: notes (file, value) as files; a name that is there already stays as it is, the new file gets a number."""
    notes.sparkSession.dataSource.register(Notes)
    notes.select("file", "value").write.format("corvane_notes").option("path", path).mode("append").save()


#: post(channel, text, key) sends a message and returns its ts; a service that knows the key sends it once.
Post = Callable[[str, str, str], str]


@dataclass
class Posted(WriterCommitMessage):
    """Receipts (run, place, id, ts) of a task's messages."""

    receipts: list[tuple[str, int, str, str]] = field(default_factory=list)


class PostWriter(DataSourceWriter):
    """Messages (run, place, id, text) to a channel, in order; each leaves a receipt (run, place), and one with a receipt isn't sent again."""

    def __init__(self, post: Post, channel: str, receipts: str) -> None:
        self.post, self.channel, self.receipts = post, channel, receipts.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Posted:
        done = Posted()
        for row in iterator:
            at = f"{self.receipts}/{row['run']}-{row['place']}.json"
            if (known := shared.read(at)) is None:
                ts = self.post(self.channel, row["text"], f"{row['run']}-{row['place']}")
                known = json.dumps({"run": row["run"], "place": row["place"], "id": row["id"], "slack_channel": self.channel, "slack_ts": ts}).encode()
                shared.write(at, known)
            r = json.loads(known)
            done.receipts.append((r["run"], r["place"], r["id"], r["slack_ts"]))
        return done

    def commit(self, messages: list[Posted | None]) -> None:
        """The receipts of the whole post as one file, which tells that it is complete."""
        rows = sorted(r for m in messages if m for r in m.receipts)
        if rows:
            shared.write(f"{self.receipts}/complete-{rows[0][0]}", json.dumps(rows).encode())

    def abort(self, messages: list[Posted | None]) -> None:
        """Receipts stay: what was sent was sent, and the next attempt goes on behind it."""


def post(messages: DataFrame, send: Post, channel: str, receipts: str) -> DataFrame:
    """SNK-6: sends messages (run, place, id, text: a digest's picks) and returns their receipts: run, place, id, slack_channel, slack_ts."""

    class Chat(DataSource):
        @classmethod
        def name(cls) -> str:
            return "corvane_chat"

        def writer(self, schema, overwrite: bool) -> PostWriter:
            return PostWriter(send, channel, receipts)

    spark = messages.sparkSession
    spark.dataSource.register(Chat)
    one = messages.select(F.col("run").cast("string").alias("run"), F.col("place").cast("int").alias("place"), F.col("id").cast("string").alias("id"), "text")
    one.coalesce(1).sortWithinPartitions("place").write.format("corvane_chat").mode("append").save()  # a top-k report
    return receipts_of(spark, receipts)


def receipts_of(spark: SparkSession, receipts: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.json").schema("run string, place int, id string, slack_channel string, slack_ts string").json(receipts)


def with_ts(journal: DataFrame, receipts: DataFrame) -> DataFrame:
    """SNK-6: journal rows (run_id, candidates) whose candidates have the ts of their posts, and the channel."""
    said = receipts.groupBy(F.col("run").alias("run_id")).agg(F.map_from_entries(F.collect_list(F.struct("id", "slack_ts"))).alias("_ts"), F.first("slack_channel").alias("_channel"))
    marked = F.transform("candidates", lambda c: c.withField("slack_ts", F.coalesce(F.try_element_at("_ts", c["arxiv"]), c["slack_ts"])))
    got = journal.join(said, "run_id", "left").withColumn("candidates", F.when(F.col("_ts").isNull(), F.col("candidates")).otherwise(marked))
    return got.withColumn("slack_channel", F.coalesce("_channel", "slack_channel")).select(*journal.columns)
