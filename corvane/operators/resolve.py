"""Entity resolution of cited works (ER-1, ER-2, AGG-18, JOIN-17, 18, 21, SET-7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.storage import saved


def _keys(works: DataFrame) -> Column:
    """Every identifier of a work; an arXiv DOI counts as the arXiv id."""
    doi = text.normalize_doi(F.col("doi"))
    arxiv = F.coalesce(text.normalize_arxiv(F.col("arxiv")), text.arxiv_of_doi(doi))
    return F.array_compact(F.array(F.concat(F.lit("arxiv:"), arxiv), F.when(text.arxiv_of_doi(doi).isNull(), F.concat(F.lit("doi:"), doi))))


def work_keys(works: DataFrame) -> DataFrame:
    """row, key of every identifier of a work."""
    return works.select("row", F.explode(_keys(works)).alias("key"))


def _least(links: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root of every node of a link (a, b): the least node of its component.

    Each round a node and its parent take the least grandparent of the node's neighbours, and each node its own; until
    nothing changes, so a chain of any length is whole in about the logarithm of its length.
    """
    both = save(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("top"))
        top = save(now.join(jump, "root").select("node", "root", "top"))
        near = both.join(top.select(F.col("node").alias("b"), F.col("top").alias("low")), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        got = top.join(near, "node").select("node", "root", F.least("top", "low").alias("low"))
        hooked = got.select("node", "low").unionByName(got.select(F.col("root").alias("node"), "low"))
        nxt = save(hooked.groupBy("node").agg(F.min("low").alias("low")).join(now, "node").select("node", F.least("low", "root").alias("root"), F.col("root").alias("was")))
        if not nxt.where("root <> was").limit(1).count():
            return nxt.select("node", "root")
        now = nxt.select("node", "root")


def components(keys: DataFrame) -> DataFrame:
    """ER-1: row, root: rows that share a key, or a chain of keys, get the least key of all.

    A row links its keys with its least one; only linked keys take part in the rounds, each of which is checkpointed, so
    neither plan nor lineage grows.
    """
    pairs = keys.distinct()
    first = pairs.groupBy("row").agg(F.min("key").alias("first"))
    links = pairs.join(first, "row").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    roots = _least(links, saved).select(F.col("node").alias("first"), "root")
    return first.join(roots, "first", "left").select("row", F.coalesce("root", "first").alias("root"))


def resolved(works: DataFrame) -> DataFrame:
    """ER-1, AGG-18: a row a work: root, title, citers in the order of first mention.

    Works are gathered by their least key first (row: a number of its own for each); what is saved, linked and gathered
    again are these groups, so works themselves are shuffled once.
    """
    keyed = works.select("row", "title", "citer", _keys(works).alias("keys")).withColumn("first", F.array_min("keys")).where("first IS NOT NULL AND row IS NOT NULL")
    rest = F.array_except("keys", F.array("first"))
    groups = saved(keyed.groupBy("first").agg(F.min_by("title", "row").alias("title"), F.min("row").alias("low"), F.collect_set(F.struct("row", "citer")).alias("c"), F.array_distinct(F.flatten(F.collect_set(rest))).alias("rest")))
    links = groups.select(F.col("first").alias("a"), F.explode("rest").alias("b"))
    if links.limit(1).count():
        roots = _least(links, saved).select(F.col("node").alias("first"), "root")
        groups = groups.join(roots, "first", "left").withColumn("root", F.coalesce("root", "first"))
        groups = groups.groupBy("root").agg(F.min_by("title", "low").alias("title"), F.flatten(F.collect_list("c")).alias("c"))
    else:
        groups = groups.withColumnRenamed("first", "root")
    return groups.select("root", "title", F.array_distinct(F.transform(F.array_sort("c"), lambda x: x["citer"])).alias("citers"))


def new_works(works: DataFrame, known: DataFrame) -> DataFrame:
    """JOIN-18: works none of whose keys is known (key); an anti-join a key, so no OR is joined on."""
    out = works.withColumn("_keys", _keys(works))
    for k in (0, 1):
        out = out.withColumn("_key", F.get("_keys", F.lit(k))).join(known.select(F.col("key").alias("_key")), "_key", "left_anti").select(*works.columns, "_keys")
    return out.drop("_keys")


def new_hits(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """JOIN-17."""
    return hits.join(notes.select("arxiv"), "arxiv", "left_anti")


def titled(hits: DataFrame, titles: DataFrame) -> DataFrame:
    """JOIN-21: fetched titles, a placeholder where none came."""
    return hits.join(titles.select("arxiv", F.col("title").alias("_t")), "arxiv", "left").withColumn("title", F.coalesce("_t", F.concat(F.lit("arXiv:"), "arxiv"))).drop("_t")


def cited_by(own: DataFrame, references: DataFrame, known: DataFrame) -> DataFrame:
    """ER-2: own papers' references (citer, title, arxiv, doi, row) resolved, without what the vault has."""
    mine = references.join(own.select(F.col("title").alias("citer")).distinct(), "citer", "left_semi")
    return resolved(new_works(mine, known))


def buckets(authored: DataFrame, cited: DataFrame) -> DataFrame:
    """SET-7: both buckets of works as one, each row with its kind."""
    return authored.withColumn("kind", F.lit("authored")).unionByName(cited.withColumn("kind", F.lit("cited")))
