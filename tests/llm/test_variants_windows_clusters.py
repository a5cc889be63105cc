"""Spelling variants, benchmark windows and clusters against brute force and their SQL."""

from __future__ import annotations

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from corvane.llm import op11_spelling, op12_decontamination, op13_exponion, queries

DOCS = "doc_id long, text string, word string, n long, item string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0, "clash", "clash") for i, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize("name", ["op11_spelling", "op12_decontamination", "op13_exponion"])
def test_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.QUERIES[name](spark, data)
    rows = con.sql(queries.ORACLES[name])
    order = [rows.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[k] for k in order)) for r in rows.fetchall())


def near(x: str, y: str) -> bool:
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute_words(rows, every=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}


def brute_variants(n):
    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, n[w], len(close)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return {w: tuple(x) for w, x in out.items()}


def test_variants_are_brute_force(spark):
    rng, rows = random.Random(5), []
    base = ["separate", "seperate", "sepérate", "separates", "necessary", "neccessary", "necesary", "definitely", "definately", "Édition", "édition", "edition", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "straße"]
    base += ["".join(rng.choices("abé", k=rng.randint(7, 9))) for _ in range(400)]
    for i in range(300):
        rows.append((i, " ".join(rng.choice(base[: rng.randint(1, len(base))]) for _ in range(60)) + ", Separate-NECESSARY_x2definitely"))
    rows += [(7, "separate again"), (None, "separate separate definitely"), (400, None), (401, ""), (402, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 3001 + " " + "z" * 3001)]
    want = brute_words(rows)
    got = {r["word"]: r["n"] for r in op11_spelling.vocabulary(docs(spark, rows), every=31).collect()}
    assert got == want and len(want) > 200
    found = op11_spelling.variants(spark.createDataFrame(list(want.items()), "word string, n long")).collect()
    assert len(found) == len(want)
    assert {r["word"]: (r["form"], r["n"], r["n_near"], r["root"]) for r in found} == brute_variants(want)
    assert all(r["form_n"] == (want[r["form"]] if r["form"] else None) for r in found)


def test_long_chains_of_forms(spark):
    words = [("x" * 7 + "y" * k, 10**k) for k in range(1, 9)]
    got = {r["word"]: r["root"] for r in op11_spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1][0]}


def test_pairs_come_once(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("ab", k=rng.randint(7, 8))): 2 for _ in range(300)}
    got = [(r["a"], r["b"]) for r in op11_spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    assert len(got) == len({frozenset(p) for p in got}) == sum(near(x, y) for x in words for y in words if x < y)


def test_no_words(spark):
    assert op11_spelling.variants(op11_spelling.vocabulary(docs(spark, []).limit(0), every=31)).count() == 0


def brute_hits(text, items, window, percent):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, which = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            part, width = w[k : k + size], min(3, size)
            m = size - width + 1
            for s in range(len(own) - size + 1):
                if 100 * sum(own[s + j : s + j + width] == part[j : j + width] for j in range(m)) >= percent * m:
                    hit |= set(range(s, s + size))
                    which.add("" if name is None else str(name))
    return len(own), len(hit), sorted(which)


@pytest.mark.parametrize(("window", "percent"), [(10, 100), (10, 60), (4, 100)])
def test_windows_are_brute_force(spark, window, percent):
    rng = random.Random(window * percent)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "x1", "7", "éß", "中文", "the"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 30])))) for k in range(2, 22)]
    items = [(k, t) for k, t in items if len(t.split()) > 2 or k < 4] + [(30, None), (31, "..."), (33, "The-the THE"), (32, items[-1][1]), (32, items[-2][1]), (None, items[5][1])]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            own = (rng.choice(items)[1] or "").split()
            if own and rng.random() < 0.5:
                own[rng.randrange(len(own))] = "other"
            parts.append(", ".join(own).upper())
        rows.append((i, "\n".join(parts)))
    rows += [(1, rows[5][1]), (1, rows[5][1]), (None, rows[6][1]), (None, rows[6][1]), (None, "none"), (90, None), (91, ""), (92, "word " * 30_000)]
    got = op12_decontamination.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), window, percent)
    assert got.columns == ["doc_id", "n_words", "spans", "n_hit", "items"]
    want = sorted(str((i, *brute_hits(t, items, window, percent))) for i, t in rows)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got.collect()) == want


def test_windows_without_broadcast(spark, data, monkeypatch):
    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    rows = lambda: sorted(map(str, op12_decontamination.contamination(read("documents"), read("benchmark")).collect()))
    want = rows()
    monkeypatch.setattr(op12_decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(op12_decontamination, "FLUSH", 10)
    monkeypatch.setattr(op12_decontamination, "MOST_BITS", 8)
    monkeypatch.setattr(op12_decontamination, "LEAST_BITS", 8)
    assert rows() == want


def test_empty_benchmark_and_documents(spark):
    some, none = docs(spark, [(1, "a b c")]), spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in op12_decontamination.contamination(some, none).collect()] == [(3, 0, [])]
    assert op12_decontamination.contamination(some.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, np.array([max(-(2**27), min(2**27, int(np.floor(256 * float(np.float32(x)))))) for x in v], object)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))
    c = [r[1] for r in order[:k]]
    nearest = lambda v: min(range(len(c)), key=lambda j: (((v - c[j]) ** 2).sum(), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        c = [sum(v for (_, v), o in zip(kept, own, strict=True) if o == j) // own.count(j) if j in own else c[j] for j in range(len(c))]
    return sorted(str((i, j := nearest(v), int(((v - c[j]) ** 2).sum()))) for i, v in kept), c


@pytest.mark.parametrize("scale", [0.02, 1.0, 1e5, 1e9])
def test_clusters_are_plain_rounds(spark, scale):
    rng = random.Random(int(scale * 100))
    rows = [(i, [rng.choice([0, 0, 1, 1, -1, rng.gauss(0, 1)]) * scale for _ in range(4)]) for i in range(250)]
    rows += [(3, [scale] * 4), (3, [scale] * 4), (None, [0.0] * 4), (None, [scale] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf")] + [0.0] * 3), (905, [])]
    frame = spark.createDataFrame([(i, v, 7, 7) for i, v in rows], "vec_id long, embedding array<float>, cluster int, q int").repartition(4)
    found, centroids, inertia = op13_exponion.cluster(frame, k=9, rounds=4, dims=4)
    want, c = plain_clusters(rows, 9, 4, 4)
    got = found.collect()
    assert sorted(str((r["vec_id"], r["cluster"], r["distance"])) for r in got) == want
    assert [x.tolist() for x in centroids] == [x.tolist() for x in c]
    assert sum(inertia.values()) == sum(r["distance"] for r in got)


def test_search_skips_and_keeps_ties():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-40, 40, (3000, 8)) + 300 * rng.integers(0, 6, (3000, 1)), np.repeat([[5] * 8], 50, 0)]).astype(np.int64)
    old = x[rng.choice(len(x), 40, replace=False)]
    old[7] = old[3]
    new = old + rng.integers(-6, 7, old.shape)
    new[7] = new[3]
    moved = np.sqrt(op13_exponion.own_squared(new, old)) * (1 + op13_exponion.SLACK)
    label, _, _, looked = op13_exponion.Search(new, moved).again(x, *op13_exponion.Search(old).first(x))
    assert (label == op13_exponion.squared(x, new).argmin(1)).all() and looked < 0.5 * len(x) * len(new)


def test_fewer_vectors_than_centroids(spark):
    one = spark.createDataFrame([(1, [0.5] * 64)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in op13_exponion.cluster(one)[0].collect()] == [(1, 0, 0)]
    assert op13_exponion.cluster(one.limit(0))[0].count() == 0
