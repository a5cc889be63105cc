"""Readers of feeds, notes, logs, bibliographies and libraries (SRC-1, 3 to 17, 22 to 25)."""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import dataclass, field, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import numbers, parsers, text

from . import sequence


def rss(spark: SparkSession, path: str, feed: str, feed_pos: int = 0) -> DataFrame:
    """SRC-1: a feed's items; malformed XML gives no rows."""
    raw = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").option("ignoreNamespace", "true").schema("title string, link string, description string, creator string").load(path)
    clean = lambda c: text.collapse(text.strip_tags(parsers.unescape(F.col(c))))
    rows = raw.select(F.lit("arxiv").alias("source"), text.arxiv_in(F.col("link")).alias("id"), clean("title").alias("title"), F.substring(clean("description"), 1, 2000).alias("abstract"),
                      text.split_names(F.coalesce("creator", F.lit(""))).alias("authors"), F.lit(feed).alias("feed"), F.lit(feed_pos).alias("feed_pos"), F.monotonically_increasing_id().alias("item_pos"))
    return rows.where("id IS NOT NULL")


def feeds(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """SRC-3, 4: all feeds' items (name: path); no feed is an error, a feed that isn't there has no items."""
    if not sources:
        raise ValueError("no feed is configured")
    out = spark.createDataFrame([], schemas.FEED_ITEM.replace("item_pos int", "item_pos bigint"))
    for k, (name, path) in enumerate(sources.items()):
        try:
            out = out.unionByName(rss(spark, path, name, k))
        except AnalysisException as e:
            warnings.warn(f"feed {name}: {e.getCondition()}", stacklevel=2)
    return out


def feed_health(items: DataFrame, names: list[str]) -> DataFrame:
    """SRC-4: feed and its items' number for every configured feed; 0 signals an outage."""
    asked = items.sparkSession.createDataFrame([(n,) for n in names], "feed string")
    return asked.join(items.groupBy("feed").agg(F.count(F.lit(1)).alias("n")), "feed", "left").select("feed", F.coalesce("n", F.lit(0)).alias("items"))


def notes(spark: SparkSession, *roots: str, glob: str = "*.md") -> DataFrame:
    """SRC-5, 6, SRT-9: Markdown notes under roots, with the root's place; a root that isn't there is warned of.

    Readers that need an order sort by (root_pos, file).
    """
    out = spark.createDataFrame([], "file string, basename string, mtime timestamp, fields string, body string, root_pos int")
    for k, root in enumerate(roots):
        try:
            raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        except AnalysisException as e:
            warnings.warn(f"root {root}: {e.getCondition()}", stacklevel=2)
            continue
        out = out.unionByName(parsed_notes(raw).withColumn("root_pos", F.lit(k)))
    return out


def parsed_notes(raw: DataFrame) -> DataFrame:
    """SRC-6: file, basename, mtime, fields (JSON or null) and body of files with path, modificationTime and content."""
    parsed = raw.select(F.col("path").alias("file"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("basename"), F.col("modificationTime").alias("mtime"), parsers.parse_frontmatter(F.decode("content", "UTF-8")).alias("p"))
    return parsed.select("file", "basename", "mtime", F.col("p.fields").alias("fields"), F.col("p.body").alias("body"))


def note_field(name: str) -> Column:
    """A frontmatter field as text, null where it is missing or of another shape."""
    return F.get_json_object("fields", f"$.{name}")


def directives(spark: SparkSession, *paths: str, glob: str = "*.md") -> DataFrame:
    """SRC-7: the directives note as lists and a body, from the first path that has one; an unrelated note gives no row."""
    rows = notes(spark, *paths, glob=glob)
    lists = [F.coalesce(F.from_json(note_field(c), "array<string>"), F.array().cast("array<string>")).alias(c) for c in ("labs", "companies", "topics", "authors")]
    mine = rows.where(F.coalesce(note_field("type"), F.lit("directives")) == "directives")
    return mine.orderBy("root_pos", "file").limit(1).select(F.trim("body").alias("body"), *lists)


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log's rows with line_no, their place: (epoch, line) in a log of sequence.append; in other files, which come before, (file, line).

    Lines that don't parse, and epochs that aren't done, are left out.
    """
    raw = spark.read.text(path)
    # a log that a folder a lane holds has the lane in its path
    lane = [F.col("lane").cast("string").alias("folder")] if "lane" in raw.columns else [F.lit(None).cast("string").alias("folder")]
    epoch = F.col("epoch").cast("long") if "epoch" in raw.columns else F.lit(None).cast("long")
    place = F.struct(F.coalesce(epoch, F.lit(-1)).alias("epoch"), F.coalesce(F.get_json_object("value", "$._line").cast("long"), F.lit(-1)).alias("line"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    rows = raw.select("value", *lane, place.alias("line_no")).where("get_json_object(value, '$') IS NOT NULL")
    if open_ := sequence.unfinished(spark, path):  # few: appends at work or lost
        rows = rows.where(~F.col("line_no.epoch").isin(open_))
    return rows.select(F.from_json("value", schema).alias("r"), "folder", "line_no").select("r.*", "folder", "line_no").withColumn("lane", F.coalesce("lane", "folder")).drop("folder")


def journal(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8."""
    return _lines(spark, path, schemas.JOURNAL)


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """STM-5: attempts at steps of a day; a log that nobody has written yet has none."""
    if not any(n.startswith("epoch=") for n in sequence.names(spark, path)):
        return spark.createDataFrame([], schemas.ATTEMPT)
    return _lines(spark, path, schemas.ATTEMPT).drop("line_no")


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: distributions as a map of numbers; an error's text in one leaves the map empty."""
    raw = _lines(spark, path, schemas.RECEIPT)
    loose = F.from_json("distribution", "map<string,string>")
    number = F.map_filter(F.transform_values(loose, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
    return raw.withColumn("distribution", F.coalesce(number, F.create_map().cast("map<string,double>")))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: an unknown label type or source ends the query."""
    raw = _lines(spark, path, schemas.LEDGER)
    ok = F.col("label_type").isin(*schemas.LABEL_TYPES) & F.col("source").isin(*schemas.LABEL_SOURCES)
    return raw.withColumn("label_type", F.when(ok, F.col("label_type")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("unknown label:"), "label_type", "source"))))


def posted(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: id and pos of the posted state: of a file, or of the newest version that sinks.write_posted has left."""
    raw = spark.read.option("multiLine", "true").schema(schemas.POSTED).json(path)
    if "v" in raw.columns:
        raw = raw.agg(F.max_by(F.struct("posted", "updated"), "v").alias("s")).select("s.*")
    return raw.select(F.posexplode("posted").alias("pos", "id"), "updated")


def sections(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12."""
    return spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").schema(schemas.SECTIONS).json(path).where("arxiv IS NOT NULL")


def library(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: texts by id, from files named arxiv-<id>.txt (an id's slash stands as %2F in the name)."""
    raw = spark.read.option("pathGlobFilter", "arxiv-*.txt").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"arxiv-(.+)\.txt$", 1)
    return raw.select(F.url_decode(F.url_decode(name)).alias("arxiv"), F.col("value").alias("text"))


def pdfs(spark: SparkSession, path: str, extract) -> DataFrame:
    """SRC-14, 17: id (from the name, else from the first 60 000 bytes) and text of PDFs; extract(bytes) may fail."""

    @F.pandas_udf("string")
    def read(content):
        def one(b):
            try:
                return extract(b)
            except Exception:  # noqa: BLE001  an unreadable file has no text
                return None

        return content.map(one)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    head = F.decode(F.substring("content", 1, 60_000), "ISO-8859-1")
    name = F.regexp_extract("path", r"([0-9]{4}\.[0-9]{4,5})", 1)
    return raw.select(F.coalesce(F.nullif(name, F.lit("")), text.arxiv_in(head)).alias("arxiv"), "path", read("content").alias("text"))


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15, 16, STR-18: kind, title, authors, arxiv and doi of every titled entry."""
    whole = spark.read.text(path, wholetext=True)
    return bibtex_entries(whole)


def bibtex_entries(whole: DataFrame) -> DataFrame:
    entry = whole.select(F.explode(F.split("value", r"(?m)^[ \t]*@")).alias("e")).where(F.col("e").rlike(r"^\w+\s*\{"))

    def value(name: str) -> Column:
        got = F.regexp_extract("e", rf"(?is)\b{name}\s*=\s*(?:\{{([^{{}}]*+(?:\{{[^{{}}]*+\}}[^{{}}]*+)*+)\}}|\"([^\"]*)\"|([0-9]+))", 0)
        return F.nullif(text.collapse(F.regexp_replace(F.regexp_replace(got, rf"(?is)^{name}\s*=\s*", ""), r'^[{"]|["}]$|[{}]', "")), F.lit(""))

    doi = text.normalize_doi(value("doi"))
    bare = F.nullif(F.lower(F.regexp_extract(value("eprint"), text.ARXIV_FORM, 1)), F.lit(""))
    rows = entry.select(F.lower(F.regexp_extract("e", r"^(\w+)", 1)).alias("kind"), value("title").alias("title"), F.array_remove(F.split(F.coalesce(value("author"), F.lit("")), r"\s+and\s+|;\s*"), "").alias("authors"),
                        F.coalesce(bare, text.arxiv_in(F.col("e")), text.arxiv_of_doi(doi)).alias("arxiv"), F.when(text.arxiv_of_doi(doi).isNull(), doi).alias("doi"))
    return rows.where("title IS NOT NULL")


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """SRC-23."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", schemas.PROPOSALS)).alias("arxiv", "p")).select("arxiv", "p.*")


def users(spark: SparkSession, path: str) -> DataFrame:
    """SRC-25: user and name."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("user", "name"))


def candidates(journal_rows: DataFrame) -> DataFrame:
    """SRC-24: of each id, the newest journal row that has a title."""
    rows = journal_rows.select("line_no", F.posexplode("candidates").alias("k", "c")).where("c.arxiv IS NOT NULL AND c.title IS NOT NULL")
    return rows.groupBy("c.arxiv").agg(F.max_by("c", F.struct("line_no", "k")).alias("c")).select("c.*")


def candidate(journal_rows: DataFrame, arxiv: str) -> DataFrame:
    """SRC-24: the newest journal row of an id that has a title."""
    return candidates(journal_rows.withColumn("candidates", F.filter("candidates", lambda c: c["arxiv"] == arxiv)))


@dataclass(frozen=True)
class Config:
    """SRC-22: knobs that change a query, with their defaults (fixed values)."""

    feeds: tuple[str, ...] = ()
    roots: tuple[str, ...] = ()
    top: int = 5
    screen: int = 40
    probe_k: int = 20
    half_life_days: float = 180.0
    min_confidence: float = 0.6
    ranking: str = "model-first"
    state_policy: str = "fixed-15"
    taste_budget_bytes: int = 2500
    candidate_content: bool = False
    why_style: str = "terms"
    who_style: str = "authors"
    fields: dict[str, str] = field(default_factory=dict)
    emoji_map: dict[str, str] = field(default_factory=lambda: {"thumbsup": "keep", "eyes": "read-later", "x": "skip"})
    lanes: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def load(cls, content: str) -> Config:
        """From TOML; a knob may stand at the top or in a table of its own."""
        raw = tomllib.loads(content)
        flat = {k: v for t in raw.values() if isinstance(t, dict) for k, v in t.items()} | {k: v for k, v in raw.items()}
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in known})

    def lane(self, name: str) -> Config:
        """A lane has its own feeds and roots; only ranking knobs are inherited."""
        own = self.lanes[name]
        inherited = {k: getattr(self, k) for k in ("top", "screen", "probe_k", "half_life_days", "min_confidence", "ranking", "state_policy", "taste_budget_bytes")}
        return Config(**(inherited | {k: tuple(v) if isinstance(v, list) else v for k, v in own.items()}))

    def problems(self) -> list[str]:
        """What keeps a run from starting."""
        return [m for m, bad in (("no feeds", not self.feeds), ("no roots", not self.roots)) if bad]


def read_date(mtime: Column) -> Column:
    """DT-2, PRJ-3."""
    return F.coalesce(numbers.tolerant_date(note_field("date_read")), numbers.tolerant_date(note_field("date")), F.to_date(mtime))
