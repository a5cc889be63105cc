"""Services behind recorded transports: pace, history, posts, notes as files, a library that fills itself."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from corvane.functions import parsers
from corvane.operators import rank, resolve
from corvane.sources import connectors, files, library, pacing, shared, sinks, writers


def times_of(log):
    return sorted(float(x) for x in log.read_text().split())


def test_a_service_is_called_once_a_slot(spark, tmp_path):
    log, pace = tmp_path / "calls", 0.25
    log.write_text("")

    def transport(url):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        if url.endswith("7"):
            raise OSError("down")
        return json.dumps({"next": 1} if "offset" not in url and url.endswith("3") else {})

    remote = connectors.source("paced_test", transport, pace, connectors.reference_pages)
    rows = connectors.fetch(spark, remote, [f"u?x={k}" for k in range(20)]).collect()
    calls = times_of(log)
    assert len(rows) == len(calls) == 22 and sum(r["error"] is not None for r in rows) == 2 and sum(r["page"] == 1 for r in rows) == 2
    assert min(b - a for a, b in zip(calls, calls[1:])) > 0.6 * pace  # slots are a pace apart, but for what starting a call takes
    assert calls[-1] - calls[0] < 22 * pace * 4


def test_lanes_share_no_slot():
    plan = pacing.Plan(0.001, time.time())
    slots = []
    for lane in range(4):
        turns = plan.turns(lane, 4)
        own = [next(turns) for _ in range(20)]
        assert own == sorted(set(own)) and all(s % 4 == lane for s in own)
        slots += own
    assert len(slots) == len(set(slots))
    free = pacing.Plan(0.0, 0.0).turns(2, 4)
    assert [next(free) for _ in range(3)] == [0, 1, 2]


def test_history_reads_each_message_once(spark, tmp_path):
    said, log = tmp_path / "said.json", tmp_path / "asked"
    log.write_text("")

    def transport(url):
        args = dict(x.split("=", 1) for x in url.partition("?")[2].split("&"))
        with open(log, "a") as f:
            f.write(url + "\n")
        key = lambda m: tuple(map(int, m["ts"].split(".")))
        low, high = (tuple(map(int, args.get(k, d).split("."))) for k, d in (("oldest", "0.0"), ("latest", "99999.0")))
        rows = sorted((m for m in json.loads(said.read_text())[args["channel"]] if low < key(m) <= high), key=key, reverse=True)
        if args["limit"] == "1":
            return json.dumps({"ok": True, "messages": rows[:1]})
        at = int(args.get("cursor", 0))
        return json.dumps({"ok": True, "messages": rows[at : at + 2], "response_metadata": {"next_cursor": str(at + 2) if at + 2 < len(rows) else ""}})

    def run():
        job = connectors.history(spark, ["C1", "C2"], transport, 0.0).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        job.awaitTermination()
        return sorted((r["channel"], r["ts"], r["text"]) for r in spark.read.schema("channel string, ts string, text string").json(str(tmp_path / "out")).collect())

    first = {"C1": [{"ts": f"{t}.5", "text": f"m{t}"} for t in (1, 2, 9, 10, 11)], "C2": []}
    said.write_text(json.dumps(first))
    want = [("C1", m["ts"], m["text"]) for m in first["C1"]]
    assert run() == sorted(want)
    pages = len(log.read_text().split())
    assert run() == sorted(want) and not [u for u in log.read_text().split()[pages:] if "limit=200" in u]
    first["C1"].append({"ts": "100.1", "text": "late"})
    first["C2"].append({"ts": "3.1", "text": "other"})
    said.write_text(json.dumps(first))
    assert run() == sorted([*want, ("C1", "100.1", "late"), ("C2", "3.1", "other")])


def test_posts_leave_receipts_and_a_retry_sends_nothing_twice(spark, tmp_path):
    sent, at = tmp_path / "sent", f"file://{tmp_path}/receipts"

    def send(channel, text, key):
        before = sent.read_text().splitlines() if sent.exists() else []
        if text == "m2" and not any(x == "broken" for x in before):
            sent.write_text("\n".join([*before, "broken"]))
            raise OSError("down")
        sent.write_text("\n".join([*before, f"{channel} {text} {key}"]))
        return f"17.{len(before)}"

    rows = spark.createDataFrame([("r1", k, f"2601.0000{k}", f"m{k}") for k in (3, 1, 2)], "run string, place int, id string, text string")
    with pytest.raises(Exception, match="down"):
        writers.post(rows, send, "C1", at)
    got = writers.post(rows, send, "C1", at)
    assert [x.split()[1] for x in sent.read_text().splitlines() if x != "broken"] == ["m1", "m2", "m3"]
    assert {r["id"] for r in got.collect()} == {"2601.00001", "2601.00002", "2601.00003"}
    again = writers.post(rows, send, "C1", at).count()
    assert again == 3 and len(sent.read_text().splitlines()) == 4
    path = f"file://{tmp_path}/journal"
    candidate = lambda k: {"arxiv": f"2601.0000{k}", "title": f"T{k}"}
    sinks.append_log(spark.createDataFrame([("main", "r1", [candidate(1), candidate(9)]), ("main", "r0", [candidate(1)])], "lane string, run_id string, candidates array<struct<arxiv:string,title:string>>"), path)
    seen = {r["run_id"]: r for r in writers.with_ts(files.journal(spark, path), got).collect()}
    assert seen["r1"]["slack_channel"] == "C1" and [c["slack_ts"] for c in seen["r1"]["candidates"]] == ["17.0", None]
    assert seen["r0"]["slack_channel"] is None and seen["r0"]["candidates"][0]["slack_ts"] is None


def test_notes_are_files_and_taken_names_stay(spark, tmp_path):
    path = f"file://{tmp_path}/papers"
    hits = [("2601.00001", "A Title", "why"), ("2601.00002", "A  title!", "why"), ("2601.00003", 'Quote "x"', None), ("2601.00001", "A Title", "why"), ("2601.00009", "owned", "why")]
    frame = spark.createDataFrame([(a, t, ["N"], w) for a, t, w in hits], "arxiv string, title string, authors array<string>, why string")
    taken = tmp_path / "papers" / "paper-20261001-a-title.md"
    taken.parent.mkdir()
    taken.write_text("mine")
    writers.write_notes(sinks.staged_notes(frame, spark.createDataFrame([("2601.00009",)], "arxiv string"), "2026-10-01").repartition(3), path)
    assert taken.read_text() == "mine"
    assert sorted(os.listdir(tmp_path / "papers")) == ["paper-20261001-a-title-2.md", "paper-20261001-a-title-3.md", "paper-20261001-a-title.md", "paper-20261001-quote-x.md"]
    read = {str(f["arxiv"]): f for r in files.notes(spark, path).collect() if r["fields"] for f in [json.loads(r["fields"])]}
    assert {f["title"] for f in read.values()} == {"A Title", "A title!", "Quote 'x'"}
    assert len(read) == 3 and [f["why"] for f in read.values() if f["title"].startswith("Quote")] == [""]
    assert all(f["status"] == "staged" and str(f["date"]) == "2026-10-01" for f in read.values())


def test_an_aborted_write_leaves_no_note(spark, tmp_path):
    from pyspark.sql import functions as F

    path = f"file://{tmp_path}/papers"
    rows = spark.range(6).select(F.concat(F.lit("n"), "id", F.lit(".md")).alias("file"), F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise("text").alias("value")).repartitionByRange(3, "file")
    with pytest.raises(Exception, match="lost"):
        writers.write_notes(rows, path)
    assert not [x for x in (os.listdir(tmp_path / "papers") if (tmp_path / "papers").exists() else []) if not x.startswith(".")]


def test_a_library_fetches_what_it_lacks_once(spark, tmp_path):
    asked, path = tmp_path / "asked", f"file://{tmp_path}/library"
    asked.write_text("")

    def page(key):
        with open(asked, "a") as f:
            f.write(f"page:{key}\n")
        if key == "2601.00002":
            raise OSError("down")
        return f"text of {key}" if key == "2601.00001" else None

    def pdf(key):
        with open(asked, "a") as f:
            f.write(f"pdf:{key}\n")
        return None if key == "2601.00004" else f"pages of {key}\nand more"

    ids = spark.createDataFrame([("2601.00001",), ("2601.00001",), ("2601.00002",), ("quant-ph/0001001",), ("2601.00004",), (None,)], "arxiv string")
    texts, fetched = library.read_through(ids, path, [("page", page), ("pdf", pdf)])
    assert {tuple(r) for r in fetched.collect()} == {("2601.00001", "page", None), ("2601.00002", "pdf", None), ("quant-ph/0001001", "pdf", None), ("2601.00004", None, "no text")}
    assert {r["arxiv"]: r["text"] for r in texts.collect()} == {"2601.00001": "text of 2601.00001", "2601.00002": "pages of 2601.00002\nand more", "quant-ph/0001001": "pages of quant-ph/0001001\nand more"}
    assert sorted(asked.read_text().split()) == sorted(["page:2601.00001", "page:2601.00002", "pdf:2601.00002", "page:quant-ph/0001001", "pdf:quant-ph/0001001", "page:2601.00004", "pdf:2601.00004"])
    assert len(os.listdir(tmp_path / "library")) == 3
    before = asked.read_text()
    texts, fetched = library.read_through(ids.where("arxiv <> '2601.00004'"), path, [("page", page), ("pdf", pdf)])
    assert fetched.count() == 0 and texts.count() == 3 and asked.read_text() == before


def test_shared_files(tmp_path):
    at = f"file://{tmp_path}/a/b"
    assert shared.read(at) is None
    shared.write(at, b"x")
    shared.write(f"{at}.waiting", b"y")
    assert not shared.claim(f"{at}.waiting", at) and shared.read(at) == b"x"
    assert shared.claim(f"{at}.waiting", f"{at}2") and shared.read(f"{at}2") == b"y" and shared.read(f"{at}.waiting") is None
    shared.remove(at)
    assert shared.read(at) is None


def test_works_without_links_run_no_rounds(spark, monkeypatch):
    """Works with one key each are gathered once; linked ones still meet, whatever the length of their chain."""
    shape = "row long, title string, citer string, arxiv string, doi string"
    works = spark.createDataFrame([(1, "A", "x", None, "10.1/a"), (2, "B", "y", None, "10.1/a"), (3, "C", "x", None, None), (4, "D", "z", "2601.00001", None)], shape)
    linked = works.unionByName(spark.createDataFrame([(0, "Z", "w", "2601.00001", "10.1/a")], shape))
    got = {r["root"]: (r["title"], r["citers"]) for r in resolve.resolved(linked).collect()}
    assert got == {"arxiv:2601.00001": ("Z", ["w", "x", "y", "z"])}
    assert {r["row"] for r in resolve.new_works(linked, spark.createDataFrame([("doi:10.1/a",)], "key string")).collect()} == {3, 4}

    def rounds(*_):
        raise AssertionError("no link, no round")

    monkeypatch.setattr(resolve, "_least", rounds)
    got = {r["root"]: (r["title"], r["citers"]) for r in resolve.resolved(works).collect()}
    assert got == {"doi:10.1/a": ("A", ["x", "y"]), "arxiv:2601.00001": ("D", ["z"])}


def test_steps_on_pages_and_items_stay_in_their_rows(spark):
    """Lines of a page are split once, and of its first ones only; matches and scores need no shuffle."""
    page = spark.createDataFrame([("T\nInstitute of X\n" + "y\n" * 60 + "Institute of Y",)], "p string").select(parsers.affiliations(F.col("p")).alias("a"))
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(coalesce(p") + plan.count("split(p") <= 2 and page.first()["a"] == ["Institute of X"]
    items = spark.createDataFrame([("a", 1, "spin spin spin", "spin wave x spin"), ("a", 2, None, "a c++ b")], "source string, id long, title string, abstract string")
    terms = spark.createDataFrame([("spin", 2.0), ("c++", 1.0), ("wave", 1.0)], "term string, weight double")
    got = rank.matches(items, terms)
    assert {(r["id"], r["term"], r["in_title"], r["in_abstract"]) for r in got.collect()} == {(1, "spin", 2, 2), (1, "wave", 0, 1), (2, "c++", 0, 1)}
    for df in (got, rank.scored(items, terms)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "HashAggregate" not in plan
