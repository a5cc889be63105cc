"""A day that goes on where its log ends (STM-5, STM-6)."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import daily
from corvane.sources import files, sequence


def run_due(lanes: DataFrame, path: str, run: Callable[[str, str, str], bool | None], now: Callable[[], datetime], **knobs: int) -> DataFrame:
    """Runs every step that is due, and those that become due by it; returns the lanes' reports.

    lanes: lane, shared, day.  run(lane, step, day) does one step as Spark jobs of its own; false or an exception is a
    failure of that step alone.  Each attempt is in the log before the next one starts; a step that was cut off has no
    line and is run again, so steps have to bear that (the ledger, the journal and the posted state do).  Steps that wait for
    their back-off are left to the next call.  One caller at a time.
    """
    spark, planned = lanes.sparkSession, daily.plan(lanes)
    while True:
        at = F.lit(now().isoformat(sep=" ")).cast("timestamp_ntz")
        rows = daily.states(planned, files.attempts(spark, path), **knobs)
        turn = daily.due(rows, at).select("lane", "step", "day").orderBy("day", "lane").collect()  # one a lane
        if not turn:
            return daily.reports(rows)
        for lane, step, day in turn:
            try:
                ok = run(lane, step, str(day)) is not False
            except Exception as e:  # noqa: BLE001 - a step's failure is a line of the log, and stays in its lane
                warnings.warn(f"{lane} {step} {day}: {type(e).__name__}: {e}", stacklevel=2)
                ok = False
            line = spark.range(1).select(F.lit(lane).alias("lane"), F.lit(step).alias("step"), F.lit(str(day)).alias("day"), F.lit(now().isoformat(sep=" ")).alias("ts"), F.lit(ok).alias("ok"))
            sequence.append(line, path)
