"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are laid on a line of words in a reproducible shuffled order and cut into blocks of equal
length.  A schedule of slots is drawn from a golden-ratio sequence: slot s has the point (s * c mod N) / N with c the
integer next to N / phi that is coprime to N, so that any stretch of slots is spread evenly and all N points together are
the grid j / N.  Points are mapped through the sources' cumulative slot weights; a slot's rank among its source's slots
names the pass over the source and the block.  A document's words are taken as often as its blocks are drawn.

Scale: texts are read once and reduced to (id, source, size).  Everything ordered is done at two levels (buckets of the
shuffle, runs of slots), so that no window holds more than a small part of a source, however much of the rows it has.
The schedule has about ``slots`` slots (a parameter), besides MIN_BLOCKS for each source; blocks grow with the input, and
documents of one block are taken equally often.  Places in blocks are reckoned in decimals, whose products don't overflow.

Edge cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 are returned
with taken 0; equal rows count one by one; an empty table gives no rows; rows without a doc_id are told apart by their
text.  Other columns are ignored by ``mix`` and passed on by ``mixed``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Steps, materialize, partitions, table, word_array

#: Slots of a schedule (resolution of the mix), words of a block at least, blocks of a source at least.
SLOTS, MIN_BLOCK, MIN_BLOCKS = 1 << 20, 16, 64
#: Times that a word is taken at most.
MAX_PASSES = 3
#: Slots ranked together; slots looked up together; units of slot weight.
RUN, CELL, UNIT = 1024, 1024, 1 << 8
#: Weights by order of source, repeated: fixed values.
WEIGHTS = (1, 2, 3)

_PHI = (1 + 5**0.5) / 2


def word_count(text: Column) -> Column:
    """Number of words: gaps of white space plus one, less the empty ends."""
    return F.size(word_array(text)).cast("long")


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key (the id or, without one, a hash of the text), source, size and the place in the shuffle (order, bucket) of every row; sk is the source as a key without nulls."""
    sk = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("sk")
    got = docs.select("doc_id", _key().alias("key"), "source", sk, word_count(F.col("text")).alias("size")).withColumn("order", F.md5(F.concat(F.lit("mix:"), "key")))
    return got.withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))


def _coprime_near(n: int) -> int:
    c = max(1, round(n / _PHI))
    return next(x for d in range(n + 1) for x in (c + d, c - d) if 0 < x and math.gcd(x, n) == 1)


def _ordered(df: DataFrame, by: list[Column], step: Steps, **sums: Column) -> DataFrame:
    """df with ``row_rank`` (from 0) in the order of by, and a column for each of sums: its sum over all earlier rows.

    Rows are dealt by range and summed range by range; only one row a range is ordered as a whole.  df must be stable.
    """
    dealt = step(df.repartitionByRange(partitions(df.sparkSession), *by).withColumn("part", F.spark_partition_id()), "ranges")
    values = {"row_rank": F.lit(1), **sums}
    inner = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("part").agg(*[F.sum(v).alias(k) for k, v in values.items()])
    over = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranges.select("part", *[F.coalesce(F.sum(k).over(over), F.lit(0)).alias(f"{k}_0") for k in values])
    got = dealt.withColumns({f"{k}_1": F.coalesce(F.sum(v).over(inner), F.lit(0)) for k, v in values.items()}).join(starts, "part")
    return got.withColumns({k: F.col(f"{k}_0") + F.col(f"{k}_1") for k in values}).drop("part", *[f"{k}_{i}" for k in values for i in (0, 1)])


def targets(sizes: DataFrame, step: Steps, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, int]:
    """A row a source (sk, source, source_size, weight, target) and the sum of all sizes.

    Water-filling in one pass: in the order of the level at which each source is full, the first one that the level of
    those before it doesn't fill gives the level.
    """
    ranked = _ordered(sizes.groupBy("sk", "source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], step)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("row_rank") % len(weights) + 1).cast("int"))
    sources = step(ranked.select("sk", "source", "source_size", weight.cast("long").alias("weight")), "sources")
    total, wsum = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    most = F.lit(MAX_PASSES) * F.col("source_size")
    filling = _ordered(sources.withColumn("full_at", most / F.col("weight")), [F.col("full_at"), F.col("source").asc_nulls_last()], step, full=most, taken=F.col("weight"))
    level = (F.lit(total) - F.col("full")) / (F.lit(wsum) - F.col("taken"))
    at = filling.select(level.alias("level"), "full_at", "row_rank").where("full_at >= level").agg(F.min_by("level", "row_rank")).first()[0] or 0.0
    return sources.withColumn("target", F.least(F.lit(float(at)) * F.col("weight"), most.cast("double"))), total


def _planned(sources: DataFrame, total: int, slots: int = SLOTS) -> DataFrame:
    """sources with blocks (their number) and units: slot weight as an integer, slots times UNIT."""
    block = max(float(MIN_BLOCK), total / slots)
    s = F.col("source_size")
    blocks = F.greatest(F.least(s, F.lit(MIN_BLOCKS)), F.round(s / F.lit(block)).cast("long"))
    return sources.withColumn("blocks", blocks).withColumn("units", F.when(s > 0, F.round(F.col("target") * F.col("blocks") / s * UNIT).cast("long")).otherwise(F.lit(0)))


def schedule(planned: DataFrame, step: Steps) -> DataFrame:
    """A row a slot: slot, sk, rank among its source's slots, pass_no and block.  planned must be stable (materialised)."""
    spark = planned.sparkSession
    units = planned.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
    n = max(1, round(units / UNIT))
    c = _coprime_near(n)
    each = F.lit(n / units if units else 0.0)
    at = _ordered(planned.where("units > 0").select("sk", "blocks", "units", F.col("source")), [F.col("source").asc_nulls_last()], step, before=F.col("units"))
    spans = at.select("sk", "blocks", F.ceil(F.col("before") * each).alias("low"), F.ceil((F.col("before") + F.col("units")) * each).alias("high")).where("low < high")
    cells = spans.withColumn("cell", F.explode(F.expr(f"sequence(low div {CELL}, (high - 1) div {CELL})")))
    points = spark.range(n if units else 0).select(F.col("id").alias("slot"), (F.col("id") * F.lit(c) % F.lit(n)).alias("point")).withColumn("cell", F.expr(f"point div {CELL}"))
    drawn = points.join(cells, (points["cell"] == cells["cell"]) & (points["point"] >= cells["low"]) & (points["point"] < cells["high"])).select("slot", "sk", "blocks", F.expr(f"slot div {RUN}").alias("run"))
    counts = drawn.groupBy("sk", "run").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("sk", "run", F.coalesce(F.sum("n").over(Window.partitionBy("sk").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    inner = Window.partitionBy("sk", "run").orderBy("slot")
    ranked = drawn.withColumn("r", F.row_number().over(inner) - 1).join(before, ["sk", "run"]).withColumn("rank", F.col("r") + F.col("n0"))
    # a source at its limit may draw a slot too many; a word taken four times is what the limit rules out
    return ranked.where(F.col("rank") < MAX_PASSES * F.col("blocks")).select("slot", "sk", "rank", F.expr("rank div blocks").alias("pass_no"), F.expr("rank % blocks").alias("block"))


#: Places of a source's words in its blocks: the products of words and blocks are decimals, since they outgrow 64 bits.
_PRODUCT = "(CAST({} AS DECIMAL(20, 0)) * CAST({} AS DECIMAL(18, 0)))"


def pieces(placed: DataFrame) -> DataFrame:
    """A row for each block that a document (first, end: its words' places in the source) reaches into, with the words in it."""
    low, high = (_PRODUCT.format(x, "blocks") for x in ("first + 1", "end"))
    block = F.expr(f"CASE WHEN size > 0 THEN sequence(({low} - 1) div source_size, ({high} - 1) div source_size) END")
    edge = lambda k: f"{_PRODUCT.format('source_size', k)} div blocks"
    words = F.expr(f"least(end, {edge('block + 1')}) - greatest(first, {edge('block')})")
    return placed.withColumn("block", F.explode_outer(block)).withColumn("words", F.when(F.col("size") > 0, words).otherwise(F.lit(0)))


def _mix(docs: DataFrame, slots: int) -> DataFrame:
    with Steps(docs.sparkSession) as step:
        sizes = step(sized(docs), "sizes")
        sources, total = targets(sizes, step)
        planned = step(_planned(sources, total, slots), "planned")
        drawn = schedule(planned, step).groupBy("sk", "block").agg(F.count(F.lit(1)).alias("times"))
        buckets = sizes.groupBy("sk", "bucket").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        starts = buckets.select("sk", "bucket", F.coalesce(upto, F.lit(0)).alias("b0")).join(planned.select("sk", "source_size", "target", "blocks"), "sk")
        inner = Window.partitionBy("sk", "bucket").orderBy("order", "size")
        rows = sizes.withColumn("row", F.row_number().over(inner)).withColumn("v", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        placed = rows.join(starts, ["sk", "bucket"]).withColumn("first", F.col("v") + F.col("b0")).withColumn("end", F.col("first") + F.col("size"))
        cut = pieces(placed).select("doc_id", "key", "source", "sk", "bucket", "row", "size", "source_size", "target", "block", "words")
        got = (cut.join(drawn, ["sk", "block"], "left").groupBy("sk", "bucket", "row", "doc_id", "key", "source", "size", "source_size", "target")
               .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken")).drop("sk", "bucket", "row"))
        return materialize(got, "mix")


def mix(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Every row's doc_id, source, size, source_size, target and taken."""
    return _mix(docs, slots).drop("key")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def mixed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs in the mix: each row as often as its words are taken, the fraction rounded by a hash of its id; all columns as they were.

    Rows with one id are taken equally often; documents without words, and those that the mix takes no words of, go.
    """
    taken = _mix(docs, slots).groupBy("key").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("times")).where("times > 0")
    chance = F.pmod(F.xxhash64(F.lit("copies"), "key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor("times").cast("int") + (chance < F.col("times") - F.floor("times")).cast("int")
    often = taken.select("key", copies.alias("copies")).where("copies > 0")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _key().alias("key"))
    return held.join(often, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


__all__ = ["SPACE", "mix", "mixed", "op1_mix", "pieces", "schedule", "sized", "targets", "word_count"]
