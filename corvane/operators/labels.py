"""Labels from all channels and the ledger (JOIN-10, 11, 25, FLT-9 to 12, SNK-3, WIN-2, 7, 10, SET-3, 5, 9, PRJ-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.schemas import CLASS_NEGATIVE, CLASS_POSITIVE, LABEL_TYPES

from .rank import first_by


def outcome(types: Column) -> Column:
    """PRJ-12, SET-5: 1 with a positive label, else 0 with a negative one, else null; types is an array."""
    has = lambda names: F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))
    return F.when(has(CLASS_POSITIVE), 1).when(has(CLASS_NEGATIVE), 0)


def by_paper(ledger: DataFrame) -> DataFrame:
    """AGG-17: the label types and the outcome of each paper."""
    return ledger.groupBy("paper").agg(F.sort_array(F.collect_set("label_type")).alias("types")).withColumn("outcome", outcome(F.col("types")))


def first_labels(rows: DataFrame) -> DataFrame:
    """WIN-2: the first row of each (paper, label_type)."""
    return first_by(rows, ["paper", "label_type"], F.col("pos"))


def new_labels(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """SNK-3: what an idempotent append would write."""
    return first_labels(rows).join(ledger.select("paper", "label_type"), ["paper", "label_type"], "left_anti")


def validated(rows: DataFrame, vocabulary: tuple[str, ...] = LABEL_TYPES) -> DataFrame:
    """SRC-10: an unknown label type ends the query."""
    bad = F.raise_error(F.concat(F.lit("unknown label type: "), F.coalesce("label_type", F.lit("null"))))
    return rows.withColumn("label_type", F.when(F.col("label_type").isin(*vocabulary), F.col("label_type")).otherwise(bad))


def first_posting(journal: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """WIN-7: when each paper was first posted; ids that only the older state knows have its time."""
    first = journal.where("posted").groupBy("paper").agg(F.min_by("ts", "pos").alias("ts"))
    if fallback is None:
        return first
    return first.unionByName(fallback.select("paper", "ts").join(first.select("paper"), "paper", "left_anti"))


def arrival(postings: DataFrame, vault: DataFrame, ledger: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """JOIN-11: distilled notes give saved-implicit, staged ones nothing yet, others a weak negative after so many days.

    vault: paper, status.  Papers with an explicit positive label, distilled or not, or that have the label already, get none.
    """
    v = vault.groupBy("paper").agg(F.max(F.col("status") != "staged").alias("distilled"))
    said = ledger.groupBy("paper").agg(F.collect_set("label_type").alias("types"))
    got = postings.join(v, "paper", "left").join(said, "paper", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    old = now >= F.col("ts") + F.make_dt_interval(F.lit(days))
    explicit = F.arrays_overlap("types", F.array(F.lit("keep"), F.lit("read-later"), F.lit("discussed")))
    label = F.when(F.col("distilled") & ~explicit, "saved-implicit").when(F.col("distilled").isNull() & old & ~explicit, "unsaved-weak-negative")
    return got.withColumn("label_type", label).where(F.col("label_type").isNotNull() & ~F.array_contains("types", F.col("label_type"))).select("paper", "label_type")


#: The mark of a digest note, a ticked line's start, how such a line names its paper.
DIGEST_MARK, TICKED, LINE_ID = "type: digest", "- [x]", r"\[arXiv:([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})\]"


def checked_boxes(notes: DataFrame) -> DataFrame:
    """FLT-12: ids in link brackets on ticked lines, which aren't indented, of digest notes (content); other notes have none."""
    lines = notes.where(F.contains("content", F.lit(DIGEST_MARK))).select(F.explode(F.split("content", r"\r?\n")).alias("line")).where(F.startswith("line", F.lit(TICKED)))
    return lines.select(F.regexp_extract("line", LINE_ID, 1).alias("paper")).where("paper <> ''").distinct().withColumn("label_type", F.lit("keep"))


def human(messages: DataFrame) -> DataFrame:
    """FLT-9."""
    return messages.where("bot_id IS NULL AND subtype IS NULL")


def reaction_labels(posted: DataFrame, reactions: DataFrame, keepers: DataFrame, emoji: DataFrame) -> DataFrame:
    """JOIN-25, FLT-10, 11: labels of allowed users' mapped reactions to posts (channel, ts)."""
    each = reactions.select("channel", "ts", F.explode("reactions").alias("r")).select("channel", "ts", F.col("r.name").alias("name"), F.explode("r.users").alias("user"))
    got = posted.join(each, ["channel", "ts"]).join(keepers, "user", "left_semi").join(emoji, "name")
    return got.select("paper", "label_type").distinct()


def reply_labels(posted: DataFrame, replies: DataFrame) -> DataFrame:
    """JOIN-25: a post with a reply (a row of the thread that isn't its parent) is discussed."""
    real = replies.where("ts <> parent").select("channel", F.col("parent").alias("ts")).distinct()
    return posted.join(real, ["channel", "ts"], "left_semi").select("paper", F.lit("discussed").alias("label_type")).distinct()


def all_labels(*parts: DataFrame) -> DataFrame:
    """SET-9."""
    out = parts[0].select("paper", "label_type")
    for p in parts[1:]:
        out = out.unionByName(p.select("paper", "label_type"))
    return out.distinct()


def posted_append(state: DataFrame, new: DataFrame, keep: int = 2000) -> DataFrame:
    """SNK-4, SET-3, WIN-10, ARR-3: the ordered union of ids, newest kept; both have id and pos, new ones follow."""
    rows = state.select("id", F.lit(0).alias("turn"), "pos").unionByName(new.select("id", F.lit(1).alias("turn"), "pos"))
    first = rows.groupBy("id").agg(F.min(F.struct("turn", "pos")).alias("at"))
    return first.orderBy(F.desc("at")).limit(keep).select("id", F.col("at.turn").alias("turn"), F.col("at.pos").alias("pos"))


def display_names(messages: DataFrame, users: DataFrame) -> DataFrame:
    """JOIN-20."""
    return messages.join(users.select("user", F.col("name").alias("_n")), "user", "left").withColumn("name", F.coalesce("_n", "user")).drop("_n")


def message_ids(messages: DataFrame) -> DataFrame:
    """SRC-18: ids that messages mention."""
    found = F.regexp_extract_all("text", F.lit(text.ARXIV_TEXT), F.lit(1))
    return messages.select("*", F.explode(F.array_distinct(F.transform(found, lambda x: F.lower(x)))).alias("arxiv"))
