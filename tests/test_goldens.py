"""Small golden cases for the engine's operators."""

from __future__ import annotations

import datetime as dt
import json
import os
import pathlib
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from corvane.functions import numbers, parsers, text
from corvane.operators import calibrate, labels, pack, profile, rank, resolve, review, scorer
from corvane.plans import queries
from corvane.sources import connectors, files, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_decay_and_idf(spark):
    assert one(spark, numbers.decay(F.lit(6))) == pytest.approx(0.97716, abs=1e-5)
    assert one(spark, numbers.decay(F.lit(None).cast("int"))) == 1.0
    assert one(spark, numbers.idf(F.lit(60), F.lit(50))) <= 1.2
    assert one(spark, numbers.idf(F.lit(60), F.lit(2))) >= 2.0


def test_names_and_ids(spark):
    assert one(spark, text.split_names(F.lit("A, B, and C"))) == ["A", "B", "C"]
    assert one(spark, text.split_names(F.lit(""))) == []
    assert one(spark, text.normalize_arxiv(F.lit("arXiv:2601.01011V3"))) == "2601.01011"
    assert one(spark, text.arxiv_in(F.lit("http://arxiv.org/abs/2601.01011v2"))) == "2601.01011"
    assert one(spark, numbers.tolerant_date(F.lit("2026-10-01T08:00"))) == dt.date(2026, 10, 1)


def test_boundary_counts(spark):
    for s, n in (("foo foo", 1), ("foo foo foo", 2), ("foo, foo", 2), ("cafoé foo-bar", 0), ("a\\Eb foo", 1)):
        assert one(spark, text.count_matches(F.lit(s), F.lit("foo"))) == n
    assert one(spark, text.count_matches(F.lit("x c++ y"), F.lit("c++"))) == 1


def test_match_join_equals_nested_loop(spark):
    items = spark.createDataFrame([(1, "Magnon modes", "a two-word term and café"), (2, "none", "пример"), (3, None, None)], "id long, title string, abstract string")
    terms = spark.createDataFrame([("magnon", 2.0), ("two-word term", 1.0), ("пример", 1.0), ("caf", 1.0), ("mode", 1.0)], "term string, weight double")
    assert {(r["id"], r["term"]) for r in rank.matches(items, terms).collect()} == {(1, "magnon"), (1, "two-word term"), (1, "caf"), (2, "пример")}


def test_counts_in_the_row_equal_the_expression(spark):
    rng = random.Random(4)
    texts = [(k, "s", "".join(rng.choice(["foo", "foo-bar", " ", " ", ", ", "é", "FOO", "x"]) for _ in range(rng.randint(0, 25))), "".join(rng.choice(["foo", " ", "  ", "bar"]) for _ in range(12))) for k in range(400)]
    items = spark.createDataFrame(texts, "id long, source string, title string, abstract string")
    terms = spark.createDataFrame([("foo", 1.0), ("foo-bar", 2.0), ("foo foo", 1.0), ("é", 1.0), ("xé", 1.0)], "term string, weight double")
    low = items.crossJoin(terms).select("id", "term", text.count_matches(F.lower("title"), F.col("term")).alias("t"), text.count_matches(F.lower("abstract"), F.col("term")).alias("a")).where("t + a > 0")
    want = {tuple(r) for r in low.collect()}
    assert {(r["id"], r["term"], r["in_title"], r["in_abstract"]) for r in rank.matches(items, terms).collect()} == want
    joined = rank._joined_matches(items.select("source", "id", F.lower("title").alias("t"), F.lower("abstract").alias("a")), terms, ["source", "id"])
    assert {(r["id"], r["term"], r["in_title"], r["in_abstract"]) for r in joined.collect()} == want


def test_one_id_in_two_sources_stays_two_items(spark):
    items = spark.createDataFrame([(1, "b", "magnon magnon", ""), (1, "a", "magnon", "x"), (2, "a", "none", "")], "id long, source string, title string, abstract string")
    got = rank.scored(items, spark.createDataFrame([("magnon", 2.0)], "term string, weight double"))
    assert got.count() == 3 and len({r["score"] for r in got.where("id = 1").collect()}) == 1
    assert [(r["source"], r["id"]) for r in rank.survivors(got).collect()] == [("a", 1), ("b", 1)]
    assert {(r["source"], r["id"]): r["pool"] for r in rank.pools(got, "s", 1, 5).collect()} == {("a", 1): "survivor", ("b", 1): "near-miss", ("a", 2): "probe"}


def test_ranks_leave_unanswered_rows_out_and_break_ties_by_paper(spark):
    rows = spark.createDataFrame([("r", 2, 1, 4.0, 9.0), ("r", 1, 2, 4.0, 9.0), ("r", 3, 3, None, 99.0)], "run string, paper int, pos int, rel double, lexical double")
    assert {(r["paper"], r["model_rank"], r["lexical_rank"]) for r in review.ranked(rows).collect()} == {(1, 1, 1), (2, 2, 2)}
    tied = spark.createDataFrame([(2, 4.0, 1, False, True), (1, 4.0, 2, False, True)], "paper int, rel double, pos int, posted boolean, relevant boolean")
    assert [r["paper"] for r in review.buried(tied, 1).collect()] == [1]
    posted = spark.createDataFrame([(1, True), (2, True), (3, True)], "paper int, posted boolean")
    said = spark.createDataFrame([(1, "keep"), (2, "discussed"), (3, "skip")], "paper int, label_type string")
    assert review.week_counts(posted, said).first().asDict() == {"posted": 3, "kept": 1, "skipped": 1, "labelled": 2}


def test_saturation_cap(spark):
    rows = [(k, "quantum magnon" if k < 2 else "quantum", 0, "useful", 0, []) for k in range(5)]
    notes = spark.createDataFrame(rows, "id int, content string, age_days int, rating string, inlinks int, tags array<string>")
    got = {r["term"]: r["weight"] for r in profile.profile(notes, F.col("content")).collect()}
    assert got["quantum"] == 0 and got["magnon"] > 0


def test_calibration_goldens(spark):
    dist = spark.createDataFrame([("score", {"must-read": 0.6, "worth-reading": 0.2, "irrelevant": 0.2}, 1), ("noul", {"true": 0.9}, 1), ("noul", {"true": 0.9}, 0)], "primitive string, d map<string,double>, outcome int")
    rows = dist.withColumn("p", calibrate.p_positive(F.col("primitive"), F.col("d")))
    assert {r["primitive"]: (round(r["brier"], 4), r["n"]) for r in calibrate.brier(rows).collect()} == {"score": (0.04, 1), "noul": (0.41, 2)}
    bins = spark.createDataFrame([("noul", 0.05, 0), ("noul", 0.15, 1), ("noul", 0.55, 1)], "primitive string, p double, outcome int")
    assert {(r["bin"], r["observed"]) for r in calibrate.reliability(bins).collect()} == {(0, 0.0), (1, 1.0), (5, 1.0)}


def test_precision_and_lift(spark):
    j = spark.createDataFrame([("r", k, k, True, "probe" if k > 3 else None, "near-miss" if k == 2 else "survivor", "lexical-first") for k in range(1, 6)], "run string, paper int, pos int, posted boolean, rescued string, pool string, ranking string")
    l = spark.createDataFrame([(1, "read-later"), (2, "discussed"), (4, "keep")], "paper int, label_type string")
    assert tuple(calibrate.precision_at_5(j, l).first()) == (0.6, 5)
    assert {r["arm"]: (r["keep_rate"], r["n"]) for r in calibrate.probe_lift(j, l).collect()} == {"rescue": (0.5, 2), "survivor": (0.5, 2)}
    assert {r["keep_rate"] for r in calibrate.probe_lift(j.withColumn("ranking", F.lit("model-first")), l).collect()} == {None}


def test_buried_and_relevance(spark):
    rows = spark.createDataFrame([(1, 4.9, 1, False, True), (2, 4.5, 2, False, True), (3, 4.99, 3, True, True)], "paper int, rel double, pos int, posted boolean, relevant boolean")
    assert [r["paper"] for r in review.buried(rows).orderBy(F.desc("rel")).collect()] == [1, 2]
    order = {t: one(spark, review.relevance(F.lit(t), F.lit(c))) for t, c in (("irrelevant", 1.0), ("worth-reading", 0.44), ("must-read", 0.8))}
    assert sorted(order, key=order.get, reverse=True) == ["must-read", "worth-reading", "irrelevant"]
    assert one(spark, review.relevance(F.lit("other"), F.lit(0.5))) is None


def test_arrival_states(spark):
    now = dt.datetime(2026, 10, 1)
    p = spark.createDataFrame([(k, now - dt.timedelta(days=d)) for k, d in ((1, 40), (2, 40), (3, 40), (4, 11), (5, 40), (6, 40))], "paper int, ts timestamp")
    vault = spark.createDataFrame([(1, "read"), (2, "staged"), (6, "read")], "paper int, status string")
    ledger = spark.createDataFrame([(5, "keep"), (6, "discussed")], "paper int, label_type string")
    got = {r["paper"]: r["label_type"] for r in labels.arrival(p, vault, ledger, F.lit(now)).collect()}
    assert got == {1: "saved-implicit", 3: "unsaved-weak-negative"}


def test_checkbox_and_ledger_are_idempotent(spark):
    lines = "- [x] T — [arXiv:2601.01011](u)\n- [ ] U — [arXiv:2601.01012](u)\n  - [x] V — [arXiv:2601.01013](u)\n- [x] W — arXiv:2601.01014"
    n = spark.createDataFrame([("---\ntype: digest\n---\n" + lines,), ("- [x] X — [arXiv:2601.01015](u)",)], "content string")
    got = labels.checked_boxes(n).withColumn("pos", F.lit(1))
    assert [r["paper"] for r in got.collect()] == ["2601.01011"]
    assert labels.new_labels(got, got).count() == 0


def test_identity_of_other_source_never_joins(spark):
    items = spark.createDataFrame([("a", "1"), ("b", "1")], "source string, id string")
    assert [tuple(r) for r in rank.unseen(items, items.where("source = 'a'"), items.limit(0)).select("source", "id").collect()] == [("b", "1")]


def test_packing(spark):
    items = spark.createDataFrame([("k", "card", 1.0, 1200), ("k", "small", 0.5, 20)], "k string, id string, priority double, bytes int")
    assert pack.packed(items, ["k"], 30).first()["kept"] == ["small"]
    state, size, terms, whys = pack.fixed_state([(f"t{k}", 9.0 - k) for k in range(9)], ["w" * 900] * 30, [], None, {"abstract": "a" * 2500})
    assert size <= 4096 and terms == 9 and whys > 0 and state is not None
    rng = random.Random(1)
    for _ in range(300):
        terms = [(f"t{k}é" * rng.randint(1, 40), rng.random() * 9) for k in range(rng.randint(0, 20))]
        whys, titles, taste = ["w" * rng.randint(0, 300) for _ in range(rng.randint(0, 30))], ["T" * rng.randint(0, 300)] * 4, "d" * rng.randint(0, 900)
        candidate = {"abstract": "a" * rng.randint(0, 4500)}
        state, size, gone, lost = pack.fixed_state(terms, whys, titles, taste, candidate)
        best, many = sorted(terms, key=lambda x: (-x[1], x[0]))[:15], len(terms[:15])
        full = lambda m, r: {"researcher_taste": {"directives": taste[:800] or None, "terms": {t: round(w, 2) for t, w in best[:m]}, "why_lines": [w[:200] for w in whys][:r], "recent_titles": titles[:3]}, "candidate": candidate}  # noqa: B023, E731
        bytes_of = lambda m, r: len(json.dumps(full(m, r), sort_keys=True).encode())  # noqa: B023, E731
        while many > 3 and bytes_of(many, len(whys)) > 2500 + 750 + 128:
            many = max(0, many - 5)
        reasons = max((r for r in range(len(whys) + 1) if bytes_of(many, r) <= 4096), default=-1)
        assert (gone, lost, size) == (len(best) - many, len(whys) - max(reasons, 0), bytes_of(many, max(reasons, 0)))
        assert (state is None) == (reasons < 0) and (state is None or json.loads(state) == json.loads(json.dumps(full(many, reasons))))
    ranked = pack.priorities([("a", 2.0), ("b", 1.0)], [(4.0, {"title": "C", "why": "w" * 900, "abstract": None})])
    assert [(p, n) for p, n, _, _ in ranked] == [(1.0, "t:a"), (0.5, "t:b"), (1.0, "c:C")] and len(ranked[2][3]["why"]) == 200
    state, size = pack.greedy_state(ranked, [], "d" * 900, {"x": 1}, 40, 6000)
    assert json.loads(state)["researcher_taste"] == {"directives": "d" * 900, "terms": {"a": 2.0, "b": 1.0}, "cards": None, "recent_titles": []} and size == len(state)
    whole = pack.greedy_state(ranked, [], None, {"x": 1}, 6000, 6000)
    assert json.loads(whole[0])["researcher_taste"]["cards"] and json.loads(pack.greedy_state(ranked, [], None, {"x": 1}, 6000, whole[1] - 1)[0])["researcher_taste"]["cards"] is None
    assert pack.greedy_state(ranked, [], None, {"x": "y" * 500}, 6000, 300)[0] is None
    assert one(spark, pack.json_bytes(F.lit('{"b":"é","a":1}'))) == len('{"a": 1, "b": "\\u00e9"}')


def test_resolution(spark):
    w = spark.createDataFrame([(1, "A", "x", "2601.00001", None), (2, "A2", "y", "2601.00001", "10.1/z"), (3, "A3", "z", None, "https://doi.org/10.1/Z"), (4, "B", "x", None, "10.48550/arXiv.2601.00009"), (5, "B", "y", "2601.00009v2", None)],
                              "row int, title string, citer string, arxiv string, doi string")
    assert {tuple(r["citers"]) for r in resolve.resolved(w).collect()} == {("x", "y", "z"), ("x", "y")}


def test_long_chains_have_one_root(spark):
    order = random.Random(8).sample(range(400), 400)
    links = [(f"r{i}", f"k{order[i]:03}") for i in range(400)] + [(f"r{i}", f"k{order[i + 1]:03}") for i in range(399)]
    alone = [("z1", "x"), ("z2", "x"), ("z2", "y"), ("w", "q")]
    got = dict(map(tuple, resolve.components(spark.createDataFrame(links + alone, "row string, key string")).collect()))
    assert got == {f"r{i}": "k000" for i in range(400)} | {"z1": "x", "z2": "x", "w": "q"}


def test_cited_by_query_is_brute_force(spark, tmp_path):
    rng = random.Random(3)
    lines = [(rng.randrange(380, 460), rng.randrange(1, 4), rng.randrange(1, 40)) for _ in range(300)]
    orders = [k for k in range(380, 460) if k % 9]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in orders], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(1, 40)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    want: dict[int, list[int]] = {}
    for order, _, part in sorted(lines):
        if order in orders and part % 7 and order not in want.setdefault(part, []):
            want[part].append(order)
    got = queries.QUERIES["er_02_cited_by"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((f"doi:10.1/{p}", f"part {p}", ",".join(map(str, c))) for p, c in want.items() if c)


def test_parsers(spark):
    assert parsers.latex(r"$\sqrt{\text{iSWAP}}$ gates with \(\alpha_2\) and \beta") == "√(iSWAP) gates with α₂ and β"
    page = "Title\nA. One, B. Two\n1 Department of Physics, University of X,\nBerlin, 12345 Germany\n2 RIKEN, Wako, Japan and\nAbstract\nUniversity of Nowhere"
    assert one(spark, parsers.affiliations(F.lit(page))) == ["University of X, Berlin", "RIKEN, Wako"]
    assert one(spark, parsers.affiliations(F.lit(""))) == [] == one(spark, parsers.affiliations(F.lit(None).cast("string")))
    many = "\n".join(f"{k} University of {c}" for k, c in enumerate("ABCDEF")) + "\nuniversity of  a\n" + "prose " * 20 + "\nInstitute of Nothing"
    shown, more = parsers.shown_affiliations(parsers.affiliations(F.lit(many)))
    assert one(spark, shown) == [f"University of {c}" for c in "ABCD"] and one(spark, more) == 2
    assert parsers.frontmatter("---\ntype: paper\n---\nbody")[1] == "body" and parsers.frontmatter("no")[0] is None


def test_sections(spark):
    page = "Abstract\nWe do things.\n1. Introduction\nx\nSummary\nshort\nReferences\nIV. Conclusions\n" + "We conclude a lot of things here and there. " * 2 + "\nReferences\n[1]"
    assert one(spark, text.abstract_section(F.lit(page))) == "We do things."
    assert one(spark, text.conclusions_section(F.lit(page))).startswith("We conclude")
    assert one(spark, text.conclusions_section(F.lit("none"))) is None


def test_scorer_fails_open(spark):
    def down(kind, states):
        raise TimeoutError

    s = spark.createDataFrame([("1", "{}"), ("2", None)], "id string, state string")
    assert {r["fail_reason"] for r in scorer.ask(s, "score", down).collect()} == {"outage: TimeoutError", "state-overflow"}
    assert {r["fail_reason"] for r in scorer.ask(s, "noul", None).collect()} == {"no-key"}


def test_pools_are_disjoint_and_complete(spark):
    items = spark.createDataFrame([(k, float(max(0, 50 - k)), ["t"] if k % 2 else ["t", "u"]) for k in range(100)], "id int, score double, terms array<string>")
    got = rank.pools(items, "s", 10, 5)
    assert got.count() == 100 and {r["pool"]: r["count"] for r in got.groupBy("pool").count().collect()}["survivor"] == 10


def test_sources(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><item><title>T &amp; U</title><link>http://arxiv.org/abs/2601.01011v2</link><description>&lt;p&gt;x&lt;/p&gt;</description></item></rss>")
    (tmp_path / "bad.xml").write_text("<rss><item><title>T")
    assert [r["id"] for r in files.rss(spark, str(tmp_path / "f.xml"), "q").collect()] == ["2601.01011"]
    assert files.rss(spark, str(tmp_path / "bad.xml"), "q").count() == 0
    (tmp_path / "ns.xml").write_text('<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><item><title>T</title><link>http://arxiv.org/abs/2601.00001</link><dc:creator>A B, C D</dc:creator></item></channel></rss>')
    assert [r["authors"] for r in files.rss(spark, str(tmp_path / "ns.xml"), "q").collect()] == [["A B", "C D"]]
    (tmp_path / "arxiv-2601.00001.txt").write_text("two\nlines")
    assert [tuple(r) for r in files.library(spark, str(tmp_path)).collect()] == [("2601.00001", "two\nlines")]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("---\ntype: paper\narxiv: '2601.01001'\n---\nbody [[x]]")
    assert files.notes(spark, str(tmp_path / "n")).select(files.note_field("arxiv")).first()[0] == "2601.01001"
    (tmp_path / "r.jsonl").write_text('{"candidate_arxiv":"1","run_id":"r","distribution":{"true":0.9}}\n{"candidate_arxiv":"2","run_id":"r","distribution":{"error":"x"}}\n')
    assert [r["distribution"] for r in files.receipts(spark, str(tmp_path / "r.jsonl")).orderBy("candidate_arxiv").collect()] == [{"true": 0.9}, {}]
    cfg = files.Config.load('top = 7\nfeeds = ["q"]\n[lanes.side]\nfeeds = ["c"]\nroots = ["r"]\n')
    assert cfg.lane("side").top == 7 and cfg.lane("side").feeds == ("c",) and cfg.problems() == ["no roots"]


def test_paged_connector(spark):
    def transport(url):
        return '{"data": [1], "next": 100}' if "offset" not in url else '{"data": [2]}'

    remote = connectors.source("refs_test", transport, 0.0, connectors.reference_pages)
    assert connectors.fetch(spark, remote, ["u?x=1"]).count() == 2


def test_sinks(spark, tmp_path):
    assert sinks.parse_sinks("vault, slack") == ("vault", "slack")
    for bad in ("", "none,vault", "mail"):
        with pytest.raises(ValueError):
            sinks.parse_sinks(bad)

    def broken(df):
        raise OSError("disk")

    assert sinks.render_report({"a": spark.range(2), "b": spark.range(3)}, most=2).count("id=") == 4
    assert "(more rows)" in sinks.render_report({"b": spark.range(3)}, most=2) and "(more rows)" not in sinks.render_report({"a": spark.range(2)}, most=2)
    errors, posted = sinks.fan_out(spark.range(3), {"vault": broken, "slack": lambda df: df.count()})
    assert errors["vault"] == "OSError: disk" and errors["slack"] is None and posted
    rows = spark.createDataFrame([(1, "keep", 1)], "paper int, label_type string, pos int")
    assert sinks.append_labels(rows, rows.limit(0), str(tmp_path / "l")) == 1
    assert sinks.append_labels(rows, spark.read.parquet(str(tmp_path / "l")), str(tmp_path / "l")) == 0


def test_registry_without_training_operators(tmp_path):
    """A copy of the repository without the operators' folder and the pipeline file still registers all the rest."""
    import __spark_entry__

    assert "rank_01_digest" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    root = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 130


def test_streams(spark, tmp_path):
    from corvane.streaming import logs

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "1", dt.datetime(2026, 1, 1)), ("a", "1", dt.datetime(2026, 1, 1)), ("a", "2", dt.datetime(2026, 1, 2))], "source string, id string, ts timestamp").write.parquet(str(tmp_path / "in" / "p"))
    s = spark.readStream.schema("source string, id string, ts timestamp").parquet(str(tmp_path / "in" / "p"))
    q = logs.seen_once(s).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_label_stream_written_twice_adds_nothing(spark, tmp_path):
    from corvane.streaming import logs

    path = str(tmp_path / "ledger")
    empty = spark.createDataFrame([], "paper int, label_type string, pos int")
    empty.write.parquet(path)
    write = logs.label_sink(spark, path, lambda: spark.read.parquet(path))
    batch = spark.createDataFrame([(1, "keep", 1), (1, "keep", 2), (2, "skip", 3)], "paper int, label_type string, pos int")
    for _ in range(2):
        write(batch, 0)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "keep", 1), (2, "skip", 3)]


def test_week_windows(spark, tmp_path):
    from corvane.streaming import logs

    spark.createDataFrame([(dt.datetime(2026, 1, 8, 12), "p"), (dt.datetime(2026, 1, 9, 12), "p")], "ts timestamp, paper string").write.parquet(str(tmp_path / "w"))
    s = spark.readStream.schema("ts timestamp, paper string").parquet(str(tmp_path / "w"))
    q = logs.week_windows(s).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["window"]["start"].day: (r["rows"], r["papers"]) for r in spark.table("weeks").collect()}
    assert len(got) == 8 and got[2] == (1, 1) and got[9] == (1, 1) and all(got[k] == (2, 1) for k in range(3, 9))
