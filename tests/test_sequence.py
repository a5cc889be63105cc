"""The order of a log's appends, whatever its files are called."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from corvane.functions import parsers
from corvane.operators import calibrate
from corvane.sources import files, sequence, sinks

RUN = "lane string, run_id string, candidates array<struct<arxiv:string,title:string>>"


def test_the_newest_append_counts(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for k in range(8):
        sinks.append_log(spark.createDataFrame([("main", f"run{k}", [("1", f"title {k}"), ("1", f"again {k}"), ("2", f"two {k}" if k < 5 else None)])], RUN), path)
    log = files.journal(spark, path)
    assert [r["title"] for r in files.candidate(log, "1").collect()] == ["again 7"] and [r["title"] for r in files.candidate(log, "2").collect()] == ["two 4"]
    assert [r["run_id"] for r in calibrate.last_runs(log, 3).collect()] == ["run7", "run6", "run5"]
    assert files.candidate(log, "3").count() == 0


def test_lines_of_one_append_keep_their_order(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lane"), F.col("id").cast("string").alias("run_id")).orderBy(F.desc(F.col("run_id").cast("int"))).repartitionByRange(7, F.desc(F.col("run_id").cast("int")))
    sinks.append_log(rows.sortWithinPartitions(F.desc(F.col("run_id").cast("int"))), path)
    got = [int(r["run_id"]) for r in files.journal(spark, path).orderBy("line_no").collect()]
    assert got == list(range(999, -1, -1))


def test_lost_writers_and_races(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    sinks.append_log(spark.createDataFrame([("main", "old", None)], RUN), path)
    lost = sequence.claim(spark, path)
    spark.createDataFrame([("main", "lost", None)], RUN).write.partitionBy("lane").json(f"{path}/epoch={lost}")
    assert sinks.append_log(spark.createDataFrame([("main", "new", None)], RUN), path) == lost + 1
    assert sequence.unfinished(spark, path) == [lost]
    assert sorted(r["run_id"] for r in files.journal(spark, path).collect()) == ["new", "old"]
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: sequence.claim(spark, path), range(40)))
    assert sorted(got) == list(range(lost + 2, lost + 42))


def test_claims_through_the_file_system_of_hadoop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sequence, "urlparse", lambda path: type("Url", (), {"scheme": "hdfs", "path": path})())
    at = f"file://{tmp_path}/x/claim"
    assert sequence.create_if_absent(spark, at) and not sequence.create_if_absent(spark, at)


@pytest.mark.parametrize(("heading", "found"), [(20, True), (26, True), (40, True), (41, False)])
def test_affiliations_stand_above_the_heading(spark, heading, found):
    page = "\n".join([f"by {k}" for k in range(heading - 2)] + ["University of the Line Above", "Abstract", "words of the Institute"])
    got = spark.range(1).select(parsers.affiliations(F.lit(page)).alias("a")).first()["a"]
    assert got == (["University of the Line Above"] if found else [])
