"""Week in review (FLT-8, 13, WIN-3 to 5, AGG-14 to 16, 19, 21, PRJ-11, SRT-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.schemas import RELEVANCE

BURIED, DIVERGENT = 10, 5


def relevance(top: Column, confidence: Column) -> Column:
    """PRJ-11: (5 - place) + confidence for a relevant label, + 1 - confidence for others; null if label or confidence is unknown."""
    place = F.array_position(F.array(*[F.lit(x) for x in RELEVANCE]), top) - 1
    sure = F.when(is_relevant(top), confidence).otherwise(1 - confidence)
    return F.when(place >= 0, (5 - place).cast("double") + sure)


def is_relevant(top: Column) -> Column:
    """FLT-13."""
    return top.isin(*RELEVANCE[:2])


def in_window(runs: DataFrame, now: Column, days: int) -> DataFrame:
    """FLT-8: runs since midnight so many days ago; a plain comparison, so that it prunes and is pushed down."""
    return runs.where(F.col("ts") >= F.date_trunc("day", now) - F.make_dt_interval(F.lit(days)))


def candidates(journal: DataFrame) -> DataFrame:
    """ARR-1: a row a candidate with its place in the run."""
    return journal.select("lane", "run_id", "ts", F.posexplode("candidates").alias("place", "c")).select("lane", "run_id", "ts", "place", "c.*")


def buried(rows: DataFrame, k: int = BURIED) -> DataFrame:
    """WIN-5: relevant rows that weren't posted, the best of each paper (earliest on ties), the k best (by paper on ties).

    max_by keeps this a partial aggregate: no paper's rows are sorted.
    """
    order = F.struct(F.col("rel").alias("r"), (-F.col("pos")).alias("p"))
    best = rows.where("NOT posted AND relevant").groupBy("paper").agg(F.max(order).alias("o"))
    return best.select("paper", F.col("o.r").alias("rel"), (-F.col("o.p")).alias("pos")).orderBy(F.desc("rel"), "paper").limit(k)


def buried_total(rows: DataFrame) -> DataFrame:
    """AGG-15."""
    return rows.agg(F.count_distinct(F.when(~F.col("posted") & F.col("relevant"), F.col("paper"))).alias("buried_total"))


def ranked(rows: DataFrame) -> DataFrame:
    """WIN-3: places in the run by model relevance and by lexical score, ties by paper; a run is a day's screened list.

    Rows that the model gave no answer for (rel is null) have no place and go.
    """
    model = Window.partitionBy("run").orderBy(F.desc("rel"), "paper", "pos")
    lexical = Window.partitionBy("run").orderBy(F.desc("lexical"), "paper", "pos")
    return rows.where("rel IS NOT NULL").withColumn("model_rank", F.row_number().over(model)).withColumn("lexical_rank", F.row_number().over(lexical)).withColumn("gap", F.col("lexical_rank") - F.col("model_rank"))


def divergences(rows: DataFrame, hot: bool = True, k: int = DIVERGENT) -> DataFrame:
    """WIN-4: papers that the model ranks far above the words (hot) or below, the widest gap of each (earliest on ties)."""
    sign = 1 if hot else -1
    best = ranked(rows).groupBy("paper").agg(F.max(F.struct((sign * F.col("gap")).alias("g"), (-F.col("pos")).alias("p"))).alias("o"))
    return best.where("o.g > 0").select("paper", (sign * F.col("o.g")).alias("gap"), (-F.col("o.p")).alias("pos")).orderBy(F.desc(sign * F.col("gap")), "paper").limit(k)


def seen(rows: DataFrame) -> DataFrame:
    """AGG-16: papers with the first row that names them and whether any was posted."""
    return rows.groupBy("paper").agg(F.bool_or("posted").alias("posted"), F.min("pos").alias("first_pos"))


def week_counts(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """AGG-14: posted rows, distinct kept and skipped papers among them, and labelled: the sum of these two (other labels don't count)."""
    posted = rows.where("posted").select("paper")
    total = posted.agg(F.count(F.lit(1)).alias("posted"))
    own = ledger.join(posted.distinct(), "paper", "left_semi")
    d = lambda c, name: F.count_distinct(F.when(c, F.col("paper"))).alias(name)
    counts = own.agg(d(F.col("label_type").isin("keep", "read-later"), "kept"), d(F.col("label_type") == "skip", "skipped"))
    return total.join(counts.withColumn("labelled", F.col("kept") + F.col("skipped")))


def by_rating(proposals: DataFrame) -> DataFrame:
    """AGG-19."""
    return proposals.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def roster_hits(picks: DataFrame) -> DataFrame:
    """AGG-21."""
    return picks.agg(F.count_if(F.size("hits") > 0).alias("hits"))


def posted(rows: DataFrame, yes: bool = True) -> DataFrame:
    """FLT-14: candidates that were posted, or weren't; a null counts as not posted."""
    return rows.where(F.coalesce("posted", F.lit(False)) == yes)


def rescued(rows: DataFrame) -> DataFrame:
    """FLT-14: posted candidates that the model lifted from another pool."""
    return posted(rows).where("rescued IS NOT NULL")
