"""The steps of a day from the log of their attempts (STM-5, STM-6).

Nothing here starts or waits: a timer asks which steps are due, runs them and adds a line an attempt to a log (see
streaming/daily.py).  All state is in that log, so whoever asks next goes on where it ends.

Edge cases: attempts of a step that isn't planned count nowhere; a null ok is a failure; a null ts counts as an attempt
but sets no time to wait for; attempts after a success change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A day's steps in their order, those of the shared lane alone, those of Sundays, and the one that is tried again.
STEPS = ("digest", "ingest", "sync", "calibrate", "review")
SHARED, SUNDAY, RETRIED = ("ingest",), ("calibrate", "review"), "digest"
#: Attempts at the digest on a weekday, and minutes between two.
RETRIES, BACKOFF_MIN = 5, 10


def _weekend() -> Column:
    """No listings are published on Saturdays and Sundays (UTC)."""
    return F.weekday("day") >= 5


def plan(lanes: DataFrame) -> DataFrame:
    """STM-6: lane, shared, day, place, step: the steps that each lane (lane, shared, day) has on its day."""
    steps = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(s).alias("step")) for k, s in enumerate(STEPS)])
    rows = lanes.select("lane", "shared", "day", F.inline(steps)).distinct()
    return rows.where((F.col("shared") | ~F.col("step").isin(*SHARED)) & ((F.weekday("day") == 6) | ~F.col("step").isin(*SUNDAY)))


def states(planned: DataFrame, attempts: DataFrame, retries: int = RETRIES, backoff_min: int = BACKOFF_MIN) -> DataFrame:
    """STM-5: planned with attempts, next_try, status and turn (the first step of its lane and day that isn't settled).

    A step is done, failed, quiet (a weekend's digest that found nothing: one attempt, no failure) or open.  A settled step,
    failed ones too, makes room for the next of its own lane; no lane waits for another.  Attempts are summed before they
    meet the plan, and the window holds the few steps of one lane and day.
    """
    tried = attempts.groupBy("lane", "day", "step").agg(F.count(F.lit(1)).alias("attempts"), F.bool_or(F.coalesce("ok", F.lit(False))).alias("_ok"), F.max("ts").alias("_last"))
    rows = planned.join(tried, ["lane", "day", "step"], "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    again = F.col("step") == RETRIED
    allowed = F.when(again & ~_weekend(), F.lit(max(1, retries))).otherwise(F.lit(1))
    over = F.when(again & _weekend(), "quiet").otherwise("failed")
    status = F.when(F.coalesce("_ok", F.lit(False)), "done").when(F.col("attempts") >= allowed, over).otherwise("open")
    rows = rows.withColumn("status", status).withColumn("next_try", F.when(F.col("status") == "open", F.col("_last") + F.make_dt_interval(mins=F.lit(backoff_min))))
    first = F.min(F.when(F.col("status") == "open", F.col("place"))).over(Window.partitionBy("lane", "day"))
    return rows.withColumn("turn", F.coalesce(F.col("place") == first, F.lit(False))).drop("_ok", "_last")


def due(rows: DataFrame, now: Column) -> DataFrame:
    """STM-5, STM-6: the steps whose turn it is and that needn't wait any more, one a lane and day."""
    return rows.where(F.col("turn") & (F.col("day") <= now.cast("date")) & (F.coalesce("next_try", now) <= now))


def reports(rows: DataFrame) -> DataFrame:
    """STM-6: lane, day, open (steps left) and line: what a lane's day came to, failures in the order of the steps."""
    failed = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.struct("place", "step"))))
    got = rows.groupBy("lane", "day").agg(failed.alias("f"), F.count_if(F.col("status") == "open").alias("open"))
    names = F.array_join(F.transform("f", lambda x: x["step"]), ", ")
    return got.select("lane", "day", "open", F.when(F.size("f") > 0, F.concat(F.lit("done with failures: "), names)).otherwise("done").alias("line"))
