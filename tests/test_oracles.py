"""Registered queries against DuckDB on the bundled tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.operators import rank
from corvane.plans import queries as q
from corvane.plans import views


def rows(frame):
    c = sorted(frame.columns)
    return sorted(map(str, frame[c].astype(object).where(frame[c].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(q.QUERIES[name](spark, data).toPandas()) == rows(con.sql(q.ORACLES[name]).df())


def test_items_keep_what_stands_late(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 3000 + " latecomer", "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    terms = spark.createDataFrame([("latecomer", 1.0)], "term string, weight double")
    assert [(r["id"], r["in_abstract"]) for r in rank.matches(views.items(spark, str(tmp_path)), terms).collect()] == [(1, 1)]


def test_equal_titles_meet_across_languages(spark, tmp_path):
    rows = [(5, "A: Title " + "t" * 90, "de"), (2, "a title " + "T" * 90, "en"), (7, "A title " + "t" * 89 + "u", "en"), (9, None, "fr"), (8, "", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, q.QUERIES["flt_16_exact_title"](spark, str(tmp_path)).collect())) == [(2, 2), (5, 2), (7, 7), (8, 8), (9, 8)]


def test_section_queries_read_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 70 + "\nReferences\nx", "src"), (2, "word " * 70 + "and an end", "src")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: {r[0]: r[1] for r in q.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("str_15_abstract_section", "str_16_conclusions_section")}
    assert got["str_15_abstract_section"] == {1: "word " * 70 + "References x", 2: "word " * 70 + "and an end"}
    assert got["str_16_conclusions_section"] == {1: ("word " * 70).strip(), 2: "word " * 70 + "and an end"}


@pytest.mark.parametrize("name", ["agg_05_terms", "rank_01_digest", "srt_01_survivors"])
def test_a_filter_does_not_repeat_scoring(spark, data, name):
    plan = q.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2 and "Filter" in plan  # a title's and an abstract's, once each


def test_filters_on_scores_keep_the_rows(spark):
    rows = [("a", 1, "Magnon magnon", "a phonon, größe"), ("a", 2, None, None), ("b", 1, "x", "größe " * 50 + "phonon " * 200), ("b", 3, "", "none")]
    items = spark.createDataFrame(rows, "source string, id long, title string, abstract string").withColumn("score", F.lit(-1.0))
    got = rank.scored(items, spark.createDataFrame([("magnon", 2.0), ("phonon", 1.0), ("größe", 0.5)], "term string, weight double"))
    assert got.columns == ["source", "id", "title", "abstract", "score", "terms"]
    every = sorted((tuple(r) for r in got.select("source", "id", "score", "terms").collect()))
    assert [(r[:2], r[3]) for r in every] == [(("a", 1), ["magnon", "phonon", "größe"]), (("a", 2), []), (("b", 1), ["phonon", "größe"]), (("b", 3), [])]
    for cut, keep in (("score > 0", lambda r: r[2] > 0), ("size(terms) > 0", lambda r: r[3]), ("score <= 0 AND id > 1", lambda r: r[2] <= 0 and r[1] > 1)):
        assert sorted(tuple(r) for r in got.where(cut).select("source", "id", "score", "terms").collect()) == [r for r in every if keep(r)]
