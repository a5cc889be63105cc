"""Streams whose time goes on: batches arrive as files, each run goes on from the checkpoint."""

from __future__ import annotations

import datetime as dt

import pytest

from corvane.operators import rank
from corvane.plans import queries as q
from corvane.plans import views
from corvane.session import STATE_STORE
from corvane.streaming import logs

START = dt.datetime(2026, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """run(rows) adds a file of rows, runs the query up to it and gives all that it has written."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def build(schema, operator, out):
        def run(rows):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            got = operator(spark.readStream.schema(schema).json(str(tmp_path / "in")))
            job = got.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            job.awaitTermination()
            return sorted(map(tuple, spark.read.schema(out).json(str(tmp_path / "out")).collect()))

        return run

    yield build
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_staged_note_holds_the_timer_and_its_removal_lets_it_go_on(stream):
    run = stream("paper long, ts timestamp, kind string, note string", lambda s: logs.unsaved_timer(s.withWatermark("ts", "0 seconds")), "paper long, label_type string")
    put = lambda *rows: run([(p, START + dt.timedelta(days=t), kind, note) for p, t, kind, note in rows])
    tick = lambda t: put((99, t, "other", None))
    weak, saved = "unsaved-weak-negative", "saved-implicit"
    assert put(*[(p, 0, "posted", None) for p in (1, 2, 3, 4, 5)]) == []
    assert put((2, 5, "staged", "a"), (4, 6, "staged", "a"), (4, 6, "staged", "b"), (5, 7, "staged", "a"), (5, 8, "unstaged", "a"), (3, 6, "saved", None)) == [(3, saved)]
    assert tick(29) == [(3, saved)]
    assert tick(31) == [(1, weak), (3, saved), (5, weak)]  # 5: its note has gone before the day, so the day stays
    assert tick(60) == [(1, weak), (3, saved), (5, weak)]  # 2 and 4 are held
    put((2, 61, "unstaged", "a"), (4, 61, "unstaged", "a"))
    tick(62)
    assert tick(63) == [(1, weak), (2, weak), (3, saved), (5, weak)]  # 4 has a second note
    put((4, 64, "unstaged", "b"))
    tick(65)
    assert tick(66) == [(1, weak), (2, weak), (3, saved), (4, weak), (5, weak)]
    put((1, 67, "posted", None), (2, 67, "unstaged", "a"))
    assert tick(120) == [(1, weak), (2, weak), (3, saved), (4, weak), (5, weak)]  # once a paper


def test_once_is_once_ever(stream):
    run = stream("source string, id string, ts timestamp", lambda s: logs.seen_once(s.withWatermark("ts", "1 day")), "source string, id string")
    row = lambda i, t: ("arxiv", i, START + dt.timedelta(days=t))
    assert run([row("1", 0), row("1", 0), row("2", 1)]) == [("arxiv", "1"), ("arxiv", "2")]
    assert run([row("3", 31), row("1", 31)]) == [("arxiv", "1"), ("arxiv", "2"), ("arxiv", "3")]
    assert run([row("1", 400), ("other", "1", START + dt.timedelta(days=400))]) == [("arxiv", "1"), ("arxiv", "2"), ("arxiv", "3"), ("other", "1")]


def test_scores_of_a_stream_are_those_of_a_table(spark, stream):
    words = [("quantum", 2.0), ("error", 1.5), ("quantum error", 1.0), ("fehler", 0.7), ("größe", 0.4)]
    terms = spark.createDataFrame(words, "term string, weight double")
    rows = [("a", "1", "Quantum error correction", "quantum quantum error fehler größe"), ("a", "2", None, "nothing"), ("b", "1", "", None), ("b", "3", "ERROR error error-prone", "größe größe")]
    schema = "source string, id string, title string, abstract string"
    run = stream(schema, lambda s: logs.scored_stream(s, terms).selectExpr("source", "id", "score", "array_join(terms, ',') AS terms"), "source string, id string, score double, terms string")
    want = rank.scored(spark.createDataFrame(rows, schema), terms).selectExpr("source", "id", "score", "array_join(terms, ',') AS terms").collect()
    assert run(rows) == sorted(map(tuple, want)) and any(r["score"] > 0 for r in want)


def test_scored_rows_are_scored(spark, data):
    items, terms = views.items(spark, data), q._terms(spark, data)
    rows = lambda df: sorted(map(str, df.select("source", "id", "score", "terms").collect()))
    assert rows(rank.scored_rows(items, terms)) == rows(rank.scored(items, terms))


def test_scored_rows_refuse_a_profile_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(rank, "FEW_TERMS", 1)
    with pytest.raises(ValueError, match="more than 1"):
        rank.scored_rows(spark.createDataFrame([("1", "t", "a")], "id string, title string, abstract string"), spark.createDataFrame([("a", 1.0), ("b", 1.0)], "term string, weight double"))
