"""A day's steps: retries, quiet weekends, lanes that don't stop each other, and a run that was cut off."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from corvane.operators import daily
from corvane.sources import files
from corvane.streaming.daily import run_due

LANES = "lane string, shared boolean, day date"
ATTEMPTS = "lane string, day date, step string, ts timestamp_ntz, ok boolean"
MONDAY, SATURDAY, SUNDAY = (datetime(2024, 1, d) for d in (22, 20, 21))


def lanes(spark, day, personal=("ann",)):
    return spark.createDataFrame([("main", True, day.date()), *[(x, False, day.date()) for x in personal]], LANES)


class Clock:
    def __init__(self, day):
        self.at = day + timedelta(hours=6)

    def __call__(self):
        return self.at


def test_steps_of_a_day(spark):
    steps = lambda day: {(r["lane"], r["step"]) for r in daily.plan(lanes(spark, day)).collect()}
    assert steps(MONDAY) == {("main", "digest"), ("main", "ingest"), ("main", "sync"), ("ann", "digest"), ("ann", "sync")}
    assert steps(SUNDAY) - steps(MONDAY) == {(x, s) for x in ("main", "ann") for s in ("calibrate", "review")}


def test_retries_wait_and_fail_in_their_lane(spark, tmp_path):
    path, clock, ran = f"file://{tmp_path}/log", Clock(MONDAY), []

    def run(lane, step, day):
        ran.append((lane, step))
        if (lane, step) == ("main", "ingest"):
            raise ValueError("no channel")
        return not (lane == "main" and step == "digest")

    with pytest.warns(UserWarning, match="no channel"):
        for _ in range(3):
            got = run_due(lanes(spark, MONDAY), path, run, clock, retries=3)
            clock.at += timedelta(minutes=5)
            assert run_due(lanes(spark, MONDAY), path, run, clock, retries=3).count() == 2  # five minutes on nothing is due
            clock.at += timedelta(minutes=5)
    assert ran == [("ann", "digest"), ("main", "digest"), ("ann", "sync"), ("main", "digest"), ("main", "digest"), ("main", "ingest"), ("main", "sync")]
    assert {r["lane"]: (r["open"], r["line"]) for r in got.collect()} == {"main": (0, "done with failures: digest, ingest"), "ann": (0, "done")}


def test_a_quiet_weekend_is_no_failure(spark, tmp_path):
    path, ran = f"file://{tmp_path}/log", []
    got = run_due(lanes(spark, SATURDAY), path, lambda lane, step, day: ran.append((lane, step)) or step != "digest", Clock(SATURDAY))
    assert sorted(ran) == [("ann", "digest"), ("ann", "sync"), ("main", "digest"), ("main", "ingest"), ("main", "sync")]
    assert {r["line"] for r in got.collect()} == {"done"}


def test_a_killed_run_goes_on_after_its_last_step(spark, tmp_path):
    path, clock, ran = f"file://{tmp_path}/log", Clock(SUNDAY), []

    def run(lane, step, day, lost=("main", "sync")):
        if (lane, step) == lost:
            raise KeyboardInterrupt
        ran.append((lane, step))

    with pytest.raises(KeyboardInterrupt):
        run_due(lanes(spark, SUNDAY, ()), path, run, clock)
    assert ran == [("main", "digest"), ("main", "ingest")]
    for _ in range(2):  # the second call has nothing left: Sunday's extras ran once
        run_due(lanes(spark, SUNDAY, ()), path, lambda *a: run(*a, lost=None), clock)
    assert ran == [("main", s) for s in ("digest", "ingest", "sync", "calibrate", "review")]
    assert files.attempts(spark, path).count() == 5


def test_odd_attempts(spark):
    plan = daily.plan(lanes(spark, MONDAY, ()))
    at = MONDAY + timedelta(hours=7)
    rows = [("main", MONDAY.date(), "digest", None, None), ("main", MONDAY.date(), "review", at, False), (None, None, None, None, True), ("main", MONDAY.date(), "sync", at, True), ("main", MONDAY.date(), "sync", at, False)]
    got = {r["step"]: r for r in daily.states(plan, spark.createDataFrame(rows, ATTEMPTS)).collect()}
    assert {k: (r["attempts"], r["status"], r["turn"]) for k, r in got.items()} == {"digest": (1, "open", True), "ingest": (0, "open", False), "sync": (2, "done", False)}
    assert got["digest"]["next_try"] is None
    none = daily.states(plan, spark.createDataFrame([], ATTEMPTS))
    assert [r["step"] for r in daily.due(none, daily.F.lit(at)).collect()] == ["digest"]
    assert daily.reports(daily.states(daily.plan(spark.createDataFrame([], LANES)), spark.createDataFrame([], ATTEMPTS))).count() == 0
