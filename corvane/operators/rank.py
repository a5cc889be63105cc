"""Scoring, pools and picks (JOIN-1 to 5, 12, AGG-4, 5, SRT-1 to 4, FLT-4, 5, SET-1 to 4, PRJ-7, 13, 14)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from corvane.functions import numbers, text
from corvane.storage import saved

#: Weight of a title match against one in the abstract, of a followed author; sizes of the pools.
TITLE, AUTHOR, SCREEN, PROBE, TOP = 3, 3, 40, 20, 5


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """WIN-2: the first row of each key in a stated order (dropDuplicates would keep any); an aggregate, so hot keys are summed map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """SET-1: all feeds' items, the first occurrence by feed and item position."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return first_by(out, ["source", "id"], F.col("feed_pos"), F.col("item_pos"))


def dead_feeds(configured: DataFrame, parsed: DataFrame) -> DataFrame:
    """SRC-4, JOIN-12: configured feeds that parsed to no rows."""
    return configured.join(parsed.select("feed").distinct(), "feed", "left_anti")


#: Terms up to which a profile travels as literals; a larger one is joined.
FEW_TERMS = 10_000
#: Terms up to which scoring looks them up inside the row; of a larger profile, matches are joined and summed.
ROW_TERMS = 1000
#: A run of a-z, 0-9 and "-" that is repeated after a single other sign.
_TWICE = r"(?<![a-z0-9-])([a-z0-9-]++)[^a-z0-9-]\1(?![a-z0-9-])"


def keys_of(items: DataFrame) -> list[str]:
    """An item's identity: (source, id), or the id where a frame has no source."""
    return [c for c in ("source", "id") if c in items.columns]


def _hits(text_: Column, wanted: list[str]) -> Column:
    """The wanted runs of a text, as often as they count: a match uses up the sign after it, so of a chain of equal runs every other one does."""
    return F.filter(F.split(F.regexp_replace(text_, _TWICE, "$1"), "[^a-z0-9-]+"), lambda x: x.isin(wanted))


def _tallied(rows: DataFrame, name: str) -> DataFrame:
    """rows with array column name turned into (term, n) of its distinct elements: in sorted order, each starts where the one before ends."""
    rows = rows.withColumn(name, F.sort_array(name))
    rows = rows.withColumn("_one", F.array_distinct(name)).withColumn("_at", F.transform(F.array_distinct(name), lambda x: F.array_position(F.col(name), x)))
    upto = lambda i: F.coalesce(F.get("_at", i + 1), F.size(name) + 1)
    return rows.withColumn(name, F.transform("_one", lambda x, i: F.struct(x.alias("term"), (upto(i) - F.get("_at", i)).cast("int").alias("n")))).drop("_one", "_at")


def matches(items: DataFrame, terms: DataFrame) -> DataFrame:
    """JOIN-1: identity, term, weight, in_title, in_abstract of every term that an item contains.

    Terms that are one run of letters are counted inside the row, from its runs; others (several words, other scripts) are
    looked for in the row and counted by their expression only where they stand.  Nothing is shuffled or gathered.  Both
    hold for a profile of at most FEW_TERMS terms, which is counted first; a larger one is joined by runs.
    """
    keys = keys_of(items)
    low = items.select(*keys, F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower(F.coalesce("abstract", F.lit(""))).alias("a"))
    few = terms.select("term", "weight").limit(FEW_TERMS + 1).collect()
    if len(few) > FEW_TERMS:
        return _joined_matches(low, terms, keys)
    plain, others = _kinds(few)
    none = F.array().cast("array<struct<term:string,in_title:int,in_abstract:int>>")
    rows = low
    if plain:
        rows = _tallied(_tallied(low.withColumn("_in_t", _hits(F.col("t"), plain)).withColumn("_in_a", _hits(F.col("a"), plain)), "_in_t"), "_in_a")
        titled = lambda x: F.coalesce(F.get(F.filter("_in_t", lambda y: y["term"] == x["term"]), F.lit(0))["n"], F.lit(0))  # noqa: E731  titles are short
        held_too = F.transform("_in_a", lambda x: F.struct(x["term"].alias("term"), titled(x).alias("in_title"), x["n"].alias("in_abstract")))
        alone = F.filter("_in_t", lambda x: ~F.array_contains(F.col("_in_a.term"), x["term"]))
        rows = rows.withColumn("_plain", F.concat(held_too, F.transform(alone, lambda x: F.struct(x["term"].alias("term"), x["n"].alias("in_title"), F.lit(0).alias("in_abstract")))))
    held = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<string>"), lambda x: F.contains("t", x) | F.contains("a", x))
    more = F.transform(held, lambda x: F.struct(x.alias("term"), text.count_matches(F.col("t"), x).alias("in_title"), text.count_matches(F.col("a"), x).alias("in_abstract")))
    found = rows.select(*keys, F.explode(F.concat(none, *([F.col("_plain")] if plain else []), *([more] if others else []))).alias("x")).select(*keys, "x.*")
    weights = items.sparkSession.createDataFrame([tuple(r) for r in few], terms.select("term", "weight").schema)
    return found.where("in_title + in_abstract > 0").join(F.broadcast(weights), "term").select(*keys, "term", "weight", "in_title", "in_abstract")  # at most FEW_TERMS rows


def _kinds(few: list[Row]) -> tuple[list[str], list[str]]:
    """Terms that are one run of letters, and the others."""
    plain = [r["term"] for r in few if re.fullmatch("[a-z0-9-]+", r["term"])]
    return plain, [r["term"] for r in few if r["term"] not in set(plain)]


def scored_rows(items: DataFrame, terms: DataFrame) -> DataFrame:
    """scored without a shuffle or an aggregate, so that it runs on streams: the row's own runs are counted against a map of weights.

    For a profile of at most FEW_TERMS terms; a larger one raises.
    """
    few = terms.select("term", "weight").limit(FEW_TERMS + 1).collect()
    if len(few) > FEW_TERMS:
        raise ValueError(f"a profile of more than {FEW_TERMS} terms can't be held in every task")
    return _scored_rows(items, few)


def _scored_rows(items: DataFrame, few: list[Row]) -> DataFrame:
    plain, others = _kinds(few)
    low = items.withColumn("_t", F.lower(F.coalesce("title", F.lit("")))).withColumn("_a", F.lower(F.coalesce("abstract", F.lit(""))))
    none, hits = F.array().cast("array<struct<term:string,n:int>>"), []
    if plain:  # a run of a title counts TITLE times
        low = _tallied(low.withColumn("_hits", F.concat(F.flatten(F.array_repeat(_hits(F.col("_t"), plain), TITLE)), _hits(F.col("_a"), plain))), "_hits")
        hits.append(F.col("_hits"))
    if others:
        held = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<string>"), lambda x: F.contains("_t", x) | F.contains("_a", x))
        more = F.transform(held, lambda x: F.struct(x.alias("term"), (TITLE * text.count_matches(F.col("_t"), x) + text.count_matches(F.col("_a"), x)).cast("int").alias("n")))
        hits.append(F.filter(more, lambda x: x["n"] > 0))
    weights = F.map_from_entries(F.array(*[F.struct(F.lit(r["term"]).alias("k"), F.lit(float(r["weight"])).alias("v")) for r in few])) if few else F.create_map().cast("map<string,double>")
    weighed = F.transform(F.concat(none, *hits), lambda x: F.struct((-F.element_at(weights, x["term"])).alias("w"), x["term"].alias("term"), x["n"].alias("n")))
    low = low.withColumn("_hits", F.sort_array(weighed))
    part = lambda x: (-x["w"] * numbers.specificity(x["term"]) * x["n"]).cast("decimal(38,10)")
    total = F.aggregate("_hits", F.lit(0).cast("decimal(38,10)"), lambda a, x: (a + part(x)).cast("decimal(38,10)"))
    both = F.struct(numbers.half_even(total.cast("double"), 2).alias("score"), F.transform("_hits", lambda x: x["term"]).alias("terms"))
    low = low.withColumn("_both", F.explode(F.array(both)))  # one row; a filter on score or terms stays above it, whereas it takes every step of a projection in, once for each place that names it
    return low.withColumn("score", F.col("_both.score")).withColumn("terms", F.col("_both.terms")).drop("_t", "_a", "_hits", "_both")


def _joined_matches(low: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """matches for any number of terms: an equi-join of the items' distinct runs with each term's first run gives candidates, the exact count decides.

    Terms without such a run (other scripts) meet texts by their first character.
    """
    both = F.concat_ws(" ", "t", "a")
    keyed = terms.select("term", "weight", F.coalesce(F.get(text.runs(F.col("term")), 0), F.concat(F.lit(" "), F.substring("term", 1, 1))).alias("run"))
    signs = F.transform(F.array_distinct(F.regexp_extract_all(both, F.lit("[^a-z0-9-]"), F.lit(0))), lambda x: F.concat(F.lit(" "), x))
    hits = low.select(*keys, F.explode(F.concat(text.runs(both), signs)).alias("run")).join(keyed, "run").select(*keys, "term", "weight").join(low, keys)
    counted = hits.select(*keys, "term", "weight", text.count_matches(F.col("t"), F.col("term")).alias("in_title"), text.count_matches(F.col("a"), F.col("term")).alias("in_abstract"))
    return counted.where("in_title + in_abstract > 0")


def author_matches(items: DataFrame, roster: DataFrame) -> DataFrame:
    """JOIN-2: id, name, group, weight of followed authors: same surname, and same initial where the roster has a first name."""
    name, group = text.split_group(F.col("entry"))
    r = roster.select(name.alias("name"), group.alias("group"), "weight", text.name_parts(text.fold_accents(name)).alias("p")).where(F.size("p") > 0)
    r = r.select("name", "group", "weight", F.element_at("p", -1).alias("surname"), F.when(F.size("p") > 1, F.substring(F.get("p", 0), 1, 1)).alias("initial"))
    a = items.select("id", F.explode("authors").alias("author")).withColumn("p", text.name_parts(text.fold_accents(F.col("author")))).where(F.size("p") > 0)
    a = a.select("id", F.element_at("p", -1).alias("surname"), F.substring(F.get("p", 0), 1, 1).alias("first"))
    return a.join(r, "surname").where("initial IS NULL OR initial = first").select("id", "name", "group", "weight").distinct()


def scored(items: DataFrame, terms: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """AGG-4, AGG-5: id, score (cents, half even) and matched terms, the heaviest first; items without a match score 0."""
    keys = keys_of(items)
    if authors is None and len(few := terms.select("term", "weight").limit(ROW_TERMS + 1).collect()) <= ROW_TERMS:
        return _scored_rows(items, few)
    m = matches(items, terms).select(*keys, "term", "weight", (F.col("weight") * numbers.specificity(F.col("term")) * (TITLE * F.col("in_title") + F.col("in_abstract"))).alias("s"))
    if authors is not None:
        m = m.unionByName((authors if set(keys) <= set(authors.columns) else authors.join(items.select(*keys), "id")).select(*keys, F.col("name").alias("term"), "weight", (AUTHOR * F.col("weight")).alias("s")))
    got = m.groupBy(*keys).agg(F.sum(F.col("s").cast("decimal(38,10)")).cast("double").alias("raw"), F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))).alias("ts"))
    got = got.select(*keys, numbers.half_even(F.col("raw"), 2).alias("score"), F.transform("ts", lambda x: x["term"]).alias("terms"))
    return items.join(got, keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def unseen(items: DataFrame, corpus: DataFrame, posted: DataFrame) -> DataFrame:
    """JOIN-3, 4, SET-2: items that neither the corpus nor earlier posts hold, by (source, id)."""
    skip = corpus.select("source", "id").unionByName(posted.select("source", "id")).distinct()
    return items.join(skip, ["source", "id"], "left_anti")


def skipped(items: DataFrame, corpus: DataFrame, posted: DataFrame) -> DataFrame:
    """JOIN-5: why items are skipped: in the corpus first, then posted."""
    c = corpus.select("source", "id").distinct().withColumn("c", F.lit(True))
    p = posted.select("source", "id").distinct().withColumn("p", F.lit(True))
    got = items.select("source", "id").join(c, ["source", "id"], "left").join(p, ["source", "id"], "left")
    return got.withColumn("reason", F.when(F.col("c"), "corpus").when(F.col("p"), "posted")).where("reason IS NOT NULL").select("source", "id", "reason")


def survivors(items: DataFrame, screen: int = SCREEN) -> DataFrame:
    """SRT-1."""
    return items.where("score > 0").orderBy(F.desc("score"), *keys_of(items)).limit(screen)


def probe(items: DataFrame, seed: str, k: int = PROBE) -> DataFrame:
    """SRT-3: a sample of items without score, by a hash of seed and id: the same on every engine and run."""
    return items.where("score <= 0").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), *keys_of(items)).limit(k)


def pools(items: DataFrame, seed: str, screen: int = SCREEN, k: int = PROBE) -> DataFrame:
    """SRT-1 to 3, FLT-4, 5, SET-4: items with their pool: survivor, near-miss, probe or none (disjoint).

    Two top-k selections mark survivors and probes (which have no score, so the two can't meet); no window ranks all items.
    Items are saved first, since they are read three times.
    """
    items, keys = saved(items), keys_of(items)
    marks = survivors(items, screen).select(*keys, F.lit("survivor").alias("pool")).unionByName(probe(items, seed, k).select(*keys, F.lit("probe").alias("pool")))
    near = F.when((F.col("score") > 0) & (F.size("terms") == 1), "near-miss").otherwise("none")
    return items.join(F.broadcast(marks), keys, "left").withColumn("pool", F.coalesce("pool", near))  # marks: screen + k rows


def pool_lexical(score: Column, terms: Column) -> Column:
    """PRJ-13."""
    return F.when((score > 0) & (F.size(terms) > 1), "survivor").when(score > 0, "near-miss").otherwise("probe")


def picks(ranked: DataFrame, top: int = TOP) -> DataFrame:
    """SRT-4: by model mass, then score, then id."""
    return ranked.orderBy(F.desc("mass"), F.desc("score"), "id").limit(top)


def finalists(ranked: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """WIN-9: the k best of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("mass"), F.desc("score"), F.col("id"))
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def rescored(first: DataFrame, second: DataFrame) -> DataFrame:
    """MDL-7: masses of a second pass supersede those of the first."""
    return first.join(second.select("id", F.col("mass").alias("new_mass")), "id", "left").withColumn("mass", F.coalesce("new_mass", "mass")).drop("new_mass")


def canonical(picked: DataFrame) -> DataFrame:
    """PRJ-7."""
    return picked.select(F.col("id").alias("arxiv"), "score", "terms", "rescued").orderBy("arxiv")


def fingerprint(picked: DataFrame) -> DataFrame:
    """PRJ-14: 16 hex digits over the picks (a report of at most TOP rows), whatever the date."""
    line = F.concat_ws("|", F.col("id").cast("string"), F.col("score").cast("string"), F.array_join("terms", ","), F.coalesce("rescued", F.lit("")))
    return picked.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("all")).select(F.substring(F.sha2("all", 256), 1, 16).alias("fingerprint"))


def run_id(*parts: Column) -> Column:
    """PRJ-14: six hex digits of a run's parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 6)


def with_authors(picked: DataFrame, items: DataFrame) -> DataFrame:
    """JOIN-14: picks with their items' authors, by identity; none where the item is gone."""
    return picked.join(items.select(*keys_of(items), "authors"), keys_of(items), "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def mode_line(primary: Column, flag: Column, content: Column, warnings: Column) -> Column:
    """PRJ-15: how a digest was made; content (null: not enriched) and warnings (an array) follow where there are any."""
    return F.concat(F.lit("mode: "), primary, F.lit(", "), flag, F.coalesce(F.concat(F.lit(" · content: "), content), F.lit("")), F.when(F.size(warnings) > 0, F.concat(F.lit(" · fetch-warning: "), F.array_join(warnings, "; "))).otherwise(""))


def seed(given: Column, feed: Column, day: Column) -> Column:
    """PRJ-15: the probe's seed: the given one, or the feed's slot ("feeds" where none is named) and the day."""
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(F.coalesce(F.nullif(feed, F.lit("")), F.lit("feeds")), F.lit(":"), day.cast("string")))
