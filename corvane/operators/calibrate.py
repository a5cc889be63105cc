"""Calibration (AGG-7 to 13, WIN-1, 6, 8, JOIN-9, 10, 13, 22, 23, PRJ-8 to 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import numbers

from . import pack, scorer
from .scorer import Scorer


def p_positive(primitive: Column, distribution: Column) -> Column:
    """PRJ-8: probability mass on the relevant side."""
    return F.when(primitive == "noul", numbers.get_or(distribution, "true")).otherwise(numbers.get_or(distribution, "must-read") + numbers.get_or(distribution, "worth-reading"))


def confidence(distribution: Column) -> Column:
    """PRJ-10."""
    return F.array_max(F.map_values(distribution))


def noul_distribution(p: Column) -> Column:
    """PRJ-9."""
    return F.create_map(F.lit("true"), p, F.lit("false"), 1 - p)


def latest(receipts: DataFrame) -> DataFrame:
    """WIN-1: the last receipt of each (run, paper) in file order, as one aggregate."""
    rest = [c for c in receipts.columns if c not in ("run", "paper")]
    return receipts.groupBy("run", "paper").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("run", "paper", "r.*")


def graded(receipts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """JOIN-9: receipts of papers with an outcome."""
    return receipts.join(outcomes.where("outcome IS NOT NULL").select("paper", "outcome"), "paper")


def _mean(x: Column) -> Column:
    """A mean from an exact decimal sum: no order of summing shows."""
    return F.sum(x.cast("decimal(28,12)")).cast("double") / F.count(F.lit(1))


def brier(rows: DataFrame) -> DataFrame:
    """AGG-7: mean squared error and n of each primitive; one without rows has null and 0."""
    kinds = rows.sparkSession.createDataFrame([("noul",), ("score",)], "primitive string")
    got = rows.groupBy("primitive").agg(F.round(_mean((F.col("p") - F.col("outcome")) ** 2), 6).alias("brier"), F.count(F.lit(1)).alias("n"))
    return kinds.join(got, "primitive", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def reliability(rows: DataFrame) -> DataFrame:
    """AGG-8: ten bins of p, those with rows."""
    return rows.groupBy("primitive", numbers.tenth(F.col("p")).alias("bin")).agg(F.round(_mean(F.col("p")), 6).alias("mean_p"), F.round(_mean(F.col("outcome")), 6).alias("observed"), F.count(F.lit(1)).alias("n"))


def first_posted(journal: DataFrame, k: int = 5) -> DataFrame:
    """WIN-6: the first k posted of each run."""
    w = Window.partitionBy("run").orderBy("pos")
    return journal.where("posted").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def precision_at_5(journal: DataFrame, ledger: DataFrame) -> DataFrame:
    """AGG-9, JOIN-10: share of the first five posts of each run with a positive label (or a discussion)."""
    good = ledger.where(F.col("label_type").isin("keep", "read-later", "discussed")).select("paper").distinct().withColumn("hit", F.lit(1))
    got = first_posted(journal).join(good, "paper", "left")
    return got.agg(F.round(_mean(F.coalesce("hit", F.lit(0))), 6).alias("precision"), F.count(F.lit(1)).alias("n"))


def probe_lift(journal: DataFrame, ledger: DataFrame, k: int = 5) -> DataFrame:
    """AGG-10: share with a positive label of posted probe rescues, and of the first k posted survivors of the window.

    journal: posted, pos, paper, pool, rescued, ranking.  A window with a run that ranked by model first has no band to
    lift from: its rates are null (n/a).  An arm without rows has n 0 and a null rate.
    """
    kept = ledger.where(F.col("label_type").isin("keep", "read-later")).select("paper").distinct().withColumn("kept", F.lit(1))
    posted = journal.where("posted")
    first = posted.where("rescued IS NULL AND pool = 'survivor'").orderBy("pos").limit(k).select(F.lit("survivor").alias("arm"), "paper")
    rows = posted.where("rescued = 'probe'").select(F.lit("rescue").alias("arm"), "paper").unionByName(first).join(kept, "paper", "left")
    got = rows.groupBy("arm").agg(F.round(_mean(F.coalesce("kept", F.lit(0))), 4).alias("rate"), F.count(F.lit(1)).alias("n"))
    mode = journal.agg(F.coalesce(F.bool_or(F.col("ranking") == "model-first"), F.lit(False)).alias("model"))  # one row
    arms = journal.sparkSession.createDataFrame([("rescue",), ("survivor",)], "arm string").join(got, "arm", "left").join(F.broadcast(mode))
    return arms.select("arm", F.when(~F.col("model"), F.col("rate")).alias("keep_rate"), F.when(F.col("model"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"))


def label_counts(ledger: DataFrame) -> DataFrame:
    """AGG-11."""
    distinct = lambda c, name: F.count_distinct(F.when(c, F.col("paper"))).alias(name)
    return ledger.agg(distinct(F.col("label_type").isin("keep", "read-later"), "positives"), distinct(F.col("label_type") == "skip", "skips"), distinct(F.col("label_type") == "unsaved-weak-negative", "weak_negatives"))


def recommendation(counts: DataFrame, least: int = 20) -> DataFrame:
    """AGG-12: too few labels to act on."""
    n = F.col("positives") + F.col("skips")
    return counts.select(n.alias("n"), F.when(n < least, "collect more labels").otherwise("enough labels").alias("advice"))


def last_runs(journal_runs: DataFrame, n: int) -> DataFrame:
    """SRC-8, WIN-8."""
    return journal_runs.orderBy(F.desc("line_no")).limit(n)


def in_runs(receipts: DataFrame, runs: DataFrame) -> DataFrame:
    """JOIN-13."""
    return receipts.join(runs.select("run").distinct(), "run", "left_semi")


#: Fixed values (PCK-3): name, policy, taste budget, hard cap, with the candidate's conclusions.
ARMS = (
    ("fixed-15/4KB", "fixed-15", 2500, 4096, False), ("fixed-15/4KB+content", "fixed-15", 2500, 4096, True),
    ("greedy/4KB", "budget-greedy", 2500, 6596, False), ("greedy/4KB+content", "budget-greedy", 2500, 6596, True),
    ("greedy/8KB", "budget-greedy", 8000, 12096, False), ("greedy/8KB+content", "budget-greedy", 8000, 12096, True),
    ("greedy/12KB", "budget-greedy", 12000, 16096, False), ("greedy/12KB+content", "budget-greedy", 12000, 16096, True),
)


def arms(spark) -> DataFrame:
    """PCK-3."""
    return spark.createDataFrame(ARMS, "arm string, policy string, taste_budget int, hard_cap int, content boolean")


def replay(labelled: DataFrame, taste: pack.Taste, ask: Scorer | None, arms: tuple = ARMS, least: float = 0.6) -> DataFrame:
    """JOIN-22, 23, MDL-10: every labelled candidate, assembled and scored anew under every arm.

    labelled: id, title, authors, abstract, conclusions and outcome, a row an id.  Returns arm, id, outcome, state_bytes
    (null where the state doesn't fit), p (relevant mass), ok and fail_reason, a receipt of each call; nothing is kept by
    the arms but the profile, so they need no join.
    """
    states = pack.assembled(labelled, taste, arms).select(F.to_json(F.struct("arm", "id")).alias("id"), "state", F.when(F.col("state").isNotNull(), F.col("bytes")).alias("state_bytes"))
    answers = scorer.ask(states, "score", ask, least, keep="state_bytes int")
    key = F.from_json("id", "arm string, id string")
    rows = answers.select(key["arm"].alias("arm"), key["id"].alias("id"), "state_bytes", p_positive(F.col("primitive"), F.col("distribution")).alias("p"), "ok", "fail_reason")
    return rows.join(labelled.select(F.col("id").cast("string").alias("id"), "outcome"), "id")


def arm_metrics(rows: DataFrame) -> DataFrame:
    """AGG-13: Brier score and number of the answers that count, mean bytes of all states that were assembled."""
    error = F.when(F.col("ok"), (F.col("p") - F.col("outcome")) ** 2).cast("decimal(28,12)")
    n = F.count_if("ok")
    return rows.groupBy("arm").agg(F.round(F.sum(error).cast("double") / F.nullif(n, F.lit(0)), 6).alias("brier"), n.alias("n"), F.round(F.sum("state_bytes") / F.nullif(F.count("state_bytes"), F.lit(0)), 4).alias("mean_bytes"))
