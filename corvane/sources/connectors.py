"""Remote services as Python data sources with an injectable transport (SRC-2, 18 to 21, STM-8).

A transport maps a request (a URL or a method with arguments) to a decoded answer.  It is pickled to the reader's tasks, so
tests pass a function over fixtures and deployments one that calls the service.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import pacing

Transport = Callable[[str], str]

#: Seconds between two calls of a service.
PACE = {"chat": 1.0, "citations": 1.1, "pdf": 3.0, "model": 0.05}


class Requests(InputPartition):
    def __init__(self, urls: list[str], lane: int, lanes: int) -> None:
        self.urls, self.lane, self.lanes = urls, lane, lanes


class PagedReader(DataSourceReader):
    """Start requests dealt to a few lanes; follows "next" offsets; a failed request ends its own pages only.

    STM-8: the plan of slots is made on the driver, and all lanes keep it, so the service is called once a slot at most.
    """

    def __init__(self, urls: list[str], transport: Transport, pace: float, next_of: Callable[[str, dict], str | None]) -> None:
        self.urls, self.transport, self.next_of = urls, transport, next_of
        self.plan = pacing.Plan.now(pace)

    def partitions(self) -> list[InputPartition]:
        lanes = min(len(self.urls), pacing.LANES) if self.plan.pace else len(self.urls)
        return [Requests(self.urls[k::lanes], k, lanes) for k in range(lanes)]

    def read(self, partition: Requests) -> Iterator[tuple]:
        turns = self.plan.turns(partition.lane, partition.lanes)
        for start in partition.urls:
            url: str | None = start
            page = 0
            while url is not None:
                next(turns)
                try:
                    body = self.transport(url)
                except Exception as e:  # noqa: BLE001  an outage is a row, not a failure of the query
                    yield start, page, None, type(e).__name__
                    break
                yield start, page, body, None
                url, page = self.next_of(start, json.loads(body)) if body.lstrip().startswith("{") else None, page + 1


def source(name: str, transport: Transport, pace: float = 0.0, next_of: Callable[[str, dict], str | None] = lambda start, page: None) -> type[DataSource]:
    """A data source class over a transport; option "requests" is a JSON list of start requests."""

    class Remote(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "request string, page int, body string, error string"

        def reader(self, schema) -> PagedReader:
            return PagedReader(json.loads(self.options["requests"]), transport, pace, next_of)

    return Remote


def fetch(spark: SparkSession, remote: type[DataSource], requests: list[str]) -> DataFrame:
    """request, page, body, error of every request and page."""
    spark.dataSource.register(remote)
    return spark.read.format(remote.name()).option("requests", json.dumps(requests)).load()


def feed_url(feed: str) -> str:
    """SRC-2."""
    return f"https://rss.arxiv.org/rss/{feed}"


def chunked_ids(ids: list[str], size: int = 50) -> list[str]:
    """SRC-20: metadata requests for so many ids each."""
    return [f"https://export.arxiv.org/api/query?id_list={','.join(ids[k : k + size])}&max_results={size}" for k in range(0, len(ids), size)]


def reference_pages(start: str, page: dict) -> str | None:
    """SRC-21: the request for the next page of references."""
    return f"{start.split('&offset=')[0]}&offset={page['next']}" if page.get("next") is not None else None


def _parsed(pages: DataFrame, schema: str) -> DataFrame:
    """request and the parsed body of every page that came; one that isn't JSON has no rows."""
    return pages.where("error IS NULL").select("request", F.from_json("body", schema).alias("b")).where("b IS NOT NULL")


_MESSAGE = "struct<ts: string, thread_ts: string, user: string, bot_id: string, subtype: string, text: string>"


def messages(pages: DataFrame) -> DataFrame:
    """SRC-18: request, ts, thread_ts, user, bot_id, subtype, text of every message of a channel's history."""
    return _parsed(pages, f"messages array<{_MESSAGE}>").select("request", F.explode("b.messages").alias("m")).select("request", "m.*")


class Stretch(InputPartition):
    """Of a channel, the messages after one ts up to another."""

    def __init__(self, channel: str, after: str, upto: str, lane: int, lanes: int) -> None:
        self.channel, self.after, self.upto, self.lane, self.lanes = channel, after, upto, lane, lanes


def history_request(channel: str, oldest: str = "0", latest: str | None = None, cursor: str | None = None, limit: int = 200) -> str:
    """SRC-18: a request for a channel's messages after oldest, up to latest, a page at a time."""
    parts = [("channel", channel), ("oldest", oldest), ("latest", latest), ("cursor", cursor), ("limit", str(limit))]
    return "conversations.history?" + "&".join(f"{k}={v}" for k, v in parts if v is not None)


def _ts(x: str) -> tuple[int, str]:
    """Order of the service's ts: seconds, then the digits behind the point."""
    seconds, _, rest = x.partition(".")
    return int(seconds or 0), rest


class HistoryReader(DataSourceStreamReader):
    """SRC-18: channels' history as a stream; the offset is the ts of each channel's newest message.

    A batch is what lies between two offsets, so a batch that runs again reads the same messages, and a restart goes on
    where the checkpoint is.  Pages are followed by the service's cursor; a failed page fails the batch, which then
    runs again.
    """

    def __init__(self, channels: list[str], transport: Transport, pace: float) -> None:
        self.channels, self.transport, self.plan = channels, transport, pacing.Plan.now(pace)

    def initialOffset(self) -> dict:
        return {c: "0" for c in self.channels}

    def latestOffset(self) -> dict:
        """The newest ts of each channel (a request a channel); an empty channel stays at the beginning."""
        turns, out = self.plan.turns(0, 1), {}
        for c in self.channels:
            next(turns)
            found = json.loads(self.transport(history_request(c, limit=1))).get("messages") or []
            out[c] = max((m["ts"] for m in found), key=_ts, default="0")
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [(c, start.get(c, "0"), upto) for c, upto in sorted(end.items()) if _ts(upto) > _ts(start.get(c, "0"))]
        return [Stretch(c, after, upto, k % pacing.LANES, min(len(new), pacing.LANES)) for k, (c, after, upto) in enumerate(new)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        turns, cursor = self.plan.turns(partition.lane, partition.lanes), None
        while cursor != "":
            next(turns)
            page = json.loads(self.transport(history_request(partition.channel, partition.after, partition.upto, cursor)))
            for m in page.get("messages") or []:
                if _ts(partition.after) < _ts(m["ts"]) <= _ts(partition.upto):
                    yield tuple([partition.channel, *(m.get(k) for k in ("ts", "thread_ts", "user", "bot_id", "subtype", "text"))])
            cursor = (page.get("response_metadata") or {}).get("next_cursor") or ""

    def commit(self, end: dict) -> None:
        """Nothing to do: the service keeps its messages."""


def history(spark: SparkSession, channels: list[str], transport: Transport, pace: float = PACE["chat"]) -> DataFrame:
    """SRC-18: a stream of channel, ts, thread_ts, user, bot_id, subtype, text."""

    class History(DataSource):
        @classmethod
        def name(cls) -> str:
            return "corvane_history"

        def schema(self) -> str:
            return "channel string, ts string, thread_ts string, user string, bot_id string, subtype string, text string"

        def streamReader(self, schema) -> HistoryReader:
            return HistoryReader(channels, transport, pace)

    spark.dataSource.register(History)
    return spark.readStream.format("corvane_history").load()


def replies(pages: DataFrame, parent: Column) -> DataFrame:
    """SRC-19: the messages of threads without the parent; parent: its ts, from the request."""
    return messages(pages).withColumn("parent", parent).where("ts <> parent")


def reactions(pages: DataFrame) -> DataFrame:
    """SRC-19: request and the array of (name, users) of a message's reactions."""
    return _parsed(pages, "message struct<reactions: array<struct<name: string, users: array<string>>>>").select("request", F.coalesce("b.message.reactions", F.array().cast("array<struct<name:string,users:array<string>>>")).alias("reactions"))


_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("arxiv", "title", "abstract")])


@F.pandas_udf(T.ArrayType(_ENTRY))
def _entries(bodies: pd.Series) -> pd.Series:
    ns = "{http://www.w3.org/2005/Atom}"

    def one(body: str | None) -> list[dict]:
        try:
            root = ElementTree.fromstring(body or "")
        except ElementTree.ParseError:
            return []
        text = lambda e, tag: " ".join((e.findtext(ns + tag) or "").split())
        return [{"arxiv": re.sub(r"v.*", "", text(e, "id").rpartition("abs/")[2]), "title": text(e, "title"), "abstract": text(e, "summary") or None} for e in root.iter(ns + "entry")]

    return bodies.map(one)


def metadata(pages: DataFrame) -> DataFrame:
    """SRC-20: arxiv, title, abstract of the entries of Atom pages; entries without id or title, and pages that don't parse, give none."""
    return pages.where("error IS NULL").select(F.explode(_entries("body")).alias("e")).select("e.*").where("arxiv <> '' AND title <> ''")


def works(pages: DataFrame) -> DataFrame:
    """SRC-21: request, title, arxiv, doi, authors of every work that pages of references cite."""
    paper = "struct<title: string, externalIds: struct<ArXiv: string, DOI: string>, authors: array<struct<name: string>>>"
    got = _parsed(pages, f"data array<struct<citedPaper: {paper}>>").select("request", F.explode("b.data.citedPaper").alias("w")).where("w IS NOT NULL")
    return got.select("request", "w.title", F.col("w.externalIds.ArXiv").alias("arxiv"), F.col("w.externalIds.DOI").alias("doi"), F.array_compact(F.col("w.authors.name")).alias("authors"))
