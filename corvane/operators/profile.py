"""The term profile of a corpus: frequencies, decayed weights, cap, cards (AGG-1 to 3, 6, 20, 22, 23, PRJ-1 to 5, 16 to 19, FLT-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import numbers, text

#: Fixed values.
TAG_WEIGHT, DIRECTIVE_WEIGHT, BODY_WEIGHT = 3.0, 5.0, 1.0
CAP_SHARE, CAP_NOTES, DEGRADED_NOTES = 0.8, 3, 5


def identity(arxiv: Column, doi: Column) -> Column:
    """PRJ-1: the first field that is present, as prefix and value."""
    return F.coalesce(F.concat(F.lit("arxiv:"), text.normalize_arxiv(F.nullif(F.trim(arxiv), F.lit("")))), F.concat(F.lit("doi:"), F.nullif(F.trim(doi), F.lit(""))))


def split_identity(pair: Column) -> tuple[Column, Column]:
    """PRJ-6: source and id of "source:id" (the id may hold colons); a bare id is arXiv's."""
    has = F.contains(pair, F.lit(":"))
    return F.when(has, F.substring_index(pair, ":", 1)).otherwise("arxiv"), F.when(has, F.regexp_replace(pair, "^[^:]*:", "")).otherwise(pair)


def built_notes(raw: DataFrame, ratings: tuple[str, ...] = ("core", "useful", "marginal")) -> DataFrame:
    """PRJ-2 to 4: rating and why with the legacy field read as either, the date ladder, status, touched, contributes.

    raw: rating, why, relevance, read_date, date (strings), mtime (timestamp), status.
    """
    legal = lambda c: F.when(F.col(c).isin(*ratings), F.col(c))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    old = F.when(~F.col("relevance").isin(*ratings), filled(F.col("relevance")))
    out = raw.withColumn("rating", F.coalesce(legal("rating"), legal("relevance"))).withColumn("why", F.coalesce(filled(F.col("why")), old))
    out = out.withColumn("read", F.coalesce(numbers.tolerant_date(F.col("read_date")), numbers.tolerant_date(F.col("date")), F.to_date("mtime")))
    out = out.withColumn("status", F.coalesce("status", F.lit(""))).withColumn("touched", F.col("why").isNotNull() | F.col("rating").isNotNull())
    return out.withColumn("contributes", ~((F.col("status") == "staged") & ~F.col("touched")))


def remap(notes: DataFrame, names: dict[str, str]) -> DataFrame:
    """PRJ-5: columns renamed from the vault's field names to ours."""
    return notes.withColumnsRenamed({theirs: ours for ours, theirs in names.items()})


def contributing(notes: DataFrame) -> DataFrame:
    """FLT-1: notes whose taste counts."""
    return notes.where("contributes")


def inlinks(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """AGG-6, JOIN-8: distinct sources (src) that link to each note (target = basename)."""
    pairs = edges.select("src", "target").distinct()
    counts = pairs.groupBy("target").agg(F.count(F.lit(1)).alias("inlinks"))
    return notes.join(counts, notes["basename"] == counts["target"], "left").drop("target").withColumn("inlinks", F.coalesce("inlinks", F.lit(0)).cast("long"))


def wikilink_edges(notes: DataFrame) -> DataFrame:
    """JOIN-8: src, target of every link in the bodies of notes (id, body); a target counts once a note."""
    return notes.select(F.col("id").alias("src"), F.explode(text.wikilinks(F.col("body"))).alias("target"))


def note_content(title: Column, body: Column) -> Column:
    """SET-6: what a note's tokens come from: its title and its body without citation and scaffold lines."""
    return F.concat_ws("\n", title, text.clean_body(F.coalesce(body, F.lit(""))))


def token_set(title: Column, body: Column, stop: tuple[str, ...] = text.STOPWORDS) -> Column:
    """SET-6: the distinct tokens of title and cleaned body together."""
    return F.array_union(text.tokens(F.coalesce(title, F.lit("")), stop), text.tokens(text.clean_body(F.coalesce(body, F.lit(""))), stop))


def token_counts(notes: DataFrame, content: Column, stop: tuple[str, ...] = text.STOPWORDS) -> DataFrame:
    """id, term, n of every token of a note; counted per note before anything is joined."""
    return notes.select("id", F.explode(text.tokens(content, stop)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """AGG-1."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def profile(notes: DataFrame, content: Column, directives: DataFrame | None = None, half_life: float = 180.0, stop: tuple[str, ...] = text.STOPWORDS) -> DataFrame:
    """AGG-2, AGG-3: term, body_w, tag_w, directive_w, df, weight.

    notes: id, age_days, rating, inlinks, tags.  Body weights are decimals so that no order of summing shows.  The
    document frequency is summed with the weights, in one shuffle; the cap takes body weight only.
    """
    factor = numbers.decay(F.col("age_days"), half_life) * numbers.rating_factor(F.col("rating")) * numbers.inlink_factor(F.col("inlinks"))
    base = notes.select("id", "tags", content.alias("content"), factor.alias("factor"))
    total = base.agg(F.count(F.lit(1)).alias("notes"))  # one row
    words = base.select("id", "factor", F.explode(text.tokens(F.col("content"), stop)).alias("term")).groupBy("id", "factor", "term").agg(F.count(F.lit(1)).alias("n"))  # a note's factor goes along, so notes are read once
    exact = lambda c: c.cast("decimal(38,12)")
    body = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(exact(F.col("n") * F.col("factor"))).alias("m"))
    body = body.join(F.broadcast(total)).withColumn("w", F.col("m").cast("double") * BODY_WEIGHT * numbers.idf(F.col("notes"), F.col("df")))
    capped = (F.col("df") >= CAP_SHARE * F.col("notes")) & (F.col("notes") >= CAP_NOTES)
    parts = body.select("term", F.when(capped, 0.0).otherwise(F.col("w")).alias("body_w"), F.lit(0.0).alias("tag_w"), F.lit(0.0).alias("directive_w"), "df")
    tags = base.select("factor", F.explode("tags").alias("term")).groupBy("term").agg(F.sum(exact(F.col("factor"))).alias("m"))
    parts = parts.unionByName(tags.select(F.lower("term").alias("term"), F.lit(0.0).alias("body_w"), (TAG_WEIGHT * F.col("m").cast("double")).alias("tag_w"), F.lit(0.0).alias("directive_w"), F.lit(0).cast("long").alias("df")))
    if directives is not None:
        parts = parts.unionByName(directives.select(F.lower("term").alias("term"), F.lit(0.0).alias("body_w"), F.lit(0.0).alias("tag_w"), F.lit(DIRECTIVE_WEIGHT).alias("directive_w"), F.lit(0).cast("long").alias("df")).distinct())
    out = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("body_w", "tag_w", "directive_w", "df")])
    return out.withColumn("weight", F.col("body_w") + F.col("tag_w") + F.col("directive_w"))


def top_terms(terms: DataFrame, k: int) -> DataFrame:
    """SRT-5: the k heaviest terms; rounding keeps ties apart from noise."""
    return terms.where("weight > 0").orderBy(F.round("weight", 6).desc(), "term").limit(k)


def cards(notes: DataFrame, content: DataFrame) -> DataFrame:
    """PRJ-17, SRT-7, JOIN-6: a card a note with its paper's sections; the heaviest first."""
    got = notes.join(content, "arxiv", "left").select("title", "why", "abstract", "conclusions", "weight", "read")
    return got.orderBy(F.desc("weight"), "title")


def recent(notes: DataFrame, k: int = 3) -> DataFrame:
    """WIN-11: the k latest read, unknown dates last."""
    return notes.orderBy(F.desc_nulls_last("read"), "ord").limit(k)


def flag(notes: DataFrame) -> DataFrame:
    """PRJ-16: degraded with too few contributing notes or without any why."""
    own = contributing(notes).agg(F.count(F.lit(1)).alias("n"), F.count("why").alias("w"))
    return own.select(F.when((F.col("n") < DEGRADED_NOTES) | (F.col("w") == 0), "degraded").otherwise("full").alias("flag"))


def fold_summary(notes: DataFrame) -> DataFrame:
    """AGG-20: one row of counts."""
    one = lambda c, name: F.count_if(c).alias(name)
    return notes.agg(F.count(F.lit(1)).alias("scanned"), one(F.col("identity").isNotNull(), "with_identity"), one(F.col("status") == "staged", "staged"), one(F.col("seed").isNotNull(), "seeded"), one(F.col("why").isNotNull(), "with_why"))


def staged_audit(notes: DataFrame, content: Column, **how: object) -> DataFrame:
    """AGG-23, FLT-1: terms whose weight differs between the profile of all notes and that of contributing ones: all_w, gated_w.

    notes as profile has them, with contributes.
    """
    a, b = (profile(n, content, **how).select("term", F.col("weight").alias(w)) for n, w in ((notes, "all_w"), (contributing(notes), "gated_w")))
    both = a.join(b, "term", "full").withColumn("all_w", F.coalesce("all_w", F.lit(0.0))).withColumn("gated_w", F.coalesce("gated_w", F.lit(0.0)))
    return both.where(F.abs(F.col("all_w") - F.col("gated_w")) > 1e-9)


def worklist(staged: DataFrame, provenance: DataFrame) -> DataFrame:
    """PRJ-19, JOIN-16: a line a staged note: id, title, when, by whom."""
    got = staged.join(provenance, "identity", "left")
    return got.select("identity", F.concat_ws(" | ", "identity", "title", F.coalesce(F.col("ts").cast("string"), F.lit("-")), F.coalesce("src", F.lit("-"))).alias("line"))


def merged_content(cache: DataFrame, library: DataFrame) -> DataFrame:
    """JOIN-7: sections from cache and library, the cache's abstract and the library's conclusions first."""
    got = cache.alias("c").join(library.alias("l"), "arxiv", "full")
    return got.select("arxiv", F.coalesce("c.abstract", "l.abstract").alias("abstract"), F.coalesce("l.conclusions", "c.conclusions").alias("conclusions"))


def backfill(ids: DataFrame, cache: DataFrame, texts: DataFrame) -> DataFrame:
    """SNK-18, JOIN-19: ids without a cached abstract, and ids without a library text."""
    no_abstract = ids.join(cache.where("abstract IS NOT NULL").select("arxiv"), "arxiv", "left_anti").withColumn("missing", F.lit("abstract"))
    return no_abstract.unionByName(ids.join(texts.select("arxiv"), "arxiv", "left_anti").withColumn("missing", F.lit("text")))
