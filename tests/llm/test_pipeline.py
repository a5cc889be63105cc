"""The corpus pipeline against brute force, stage by stage."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import xxhash

import corpus_pipeline
from corvane.llm import op1_mix, op4_bpe, op6_quality
from corvane.llm.common import kept, materialize

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(4000))


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, frames = docs.columns, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = docs = materialize(stage(spark, docs, data))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    text = {n: {r["doc_id"]: r["text"] for r in f.select("doc_id", "text").collect()} for n, f in list(frames.items())[:-1]}
    judged = op6_quality.judge(frames["documents"].select("doc_id", "text"), op6_quality.learn_from(frames["documents"], spark.read.parquet(f"{data}/labels.parquet")))
    assert set(text["quality_rules"]) == {r["doc_id"] for r in judged.where("kept").select("doc_id").collect()}
    best: dict[str, tuple] = {}
    for i, t in text["quality_rules"].items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[k] = min(best.get(k, (1, 0)), (-len(t), i))
    assert set(text["exact_dedup"]) == {v[1] for v in best.values()}
    assert set(text["near_dedup"]) <= set(text["exact_dedup"]) and set(text["source_mix"]) <= set(text["near_dedup"])
    taken = {r["doc_id"]: r["taken"] / max(r["size"], 1) for r in op1_mix.mix(frames["near_dedup"]).collect()}
    chance = {i: xxhash.xxh64_intdigest(str(i), xxhash.xxh64_intdigest("copies", 42)) % 2**20 / 2**20 for i in taken}
    copies = Counter({i: n for i, x in taken.items() if (n := int(x) + (chance[i] < x % 1))})
    assert copies and Counter(r["doc_id"] for r in frames["source_mix"].select("doc_id").collect()) == copies
    shas = Counter((i, hashlib.sha256(text["near_dedup"][i].encode()).hexdigest()) for i in copies.elements())
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in frames["bpe_tokens"].collect()) == shas


def test_near_dedup_and_tokens_are_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    words = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] for i, t in text.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in words.items()}
    root = {i: i for i in text}
    linked = [(a, b) for a in text for b in text if a < b and sets[a] and 10 * len(both := sets[a] & sets[b]) >= 8 * (len(sets[a]) + len(sets[b]) - len(both))]
    while any(root[a] != root[b] for a, b in linked):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert linked
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, data).select("doc_id").collect()) == sorted(i for i in text if root[i] == i)
    got = op4_bpe.decode(corpus_pipeline.tokens(spark, docs, data), op4_bpe.default_tokenizer()).select("doc_id", "decoded", "n_tokens").collect()
    assert {r["doc_id"]: r["decoded"] for r in got} == text and all(r["n_tokens"] > 0 or not text[r["doc_id"]] for r in got)


EDGE = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "b"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "de", "a"), (5, "The quick  brown fox jumps over the lazy dog again and again", "en", "b"),
    (6, LONG, "en", "b"), (7, LONG + " x", "en", None), (7, LONG + " x", "en", None), (8, "é ß 中文 🙂", None, "c"), (None, "no id here at all", "en", "c"), (None, "another one without an id", "en", "c"),
]
CLASHING = "doc_id long, text string, lang string, source string, row string, key string, copies int, w string"


def _edge(spark, rows=EDGE):
    return spark.createDataFrame([(*r, "r", "k", 0, "w") for r in rows], CLASHING).repartition(3)


def test_stages_on_edge_rows(spark, data):
    """Nulls, blanks, a long text twice, rows without an id, columns whose names clash: what stays, whole."""
    docs = _edge(spark)
    ids = lambda d: sorted(str(r["doc_id"]) for r in d.collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
    judged = ids(corpus_pipeline.quality_rules(spark, docs, data))
    assert set(judged) <= {"6", "7"}  # all others have fewer than 50 words
    assert ids(corpus_pipeline.exact_dedup(spark, docs, data)) == sorted(["4", "5", "6", "7", "8", "None", "None"])  # 4 is longer than 2 and 3
    near = corpus_pipeline.near_dedup(spark, docs, data).collect()
    assert sorted(str(r["doc_id"]) for r in near) == sorted(["1", "2", "3", "4", "6", "8", "None", "None"])
    assert all(r["row"] == "r" and r["key"] == "k" and r["copies"] == 0 and r["w"] == "w" for r in near)
    mixed = corpus_pipeline.source_mix(spark, docs, data).collect()
    assert {r["doc_id"] for r in mixed} <= {1, 5, 6, 7, 8, None} and any(r["doc_id"] == 6 for r in mixed)
    got = {(r["doc_id"], r["n_tokens"] > 0) for r in corpus_pipeline.tokens(spark, docs, data).collect()}
    assert (2, False) in got and (3, False) in got and (6, True) in got


def test_stages_on_an_empty_table(spark, data):
    docs = _edge(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_run_leaves_its_result_only(spark, data):
    before = set(kept())
    got = corpus_pipeline.run(spark, data)
    mine = [p for p in kept() if p not in before]
    assert len(mine) == 1 and got.count() > 0
    folder = mine[0].removeprefix("file://")
    assert not [p for p in os.listdir(os.path.dirname(folder)) if p.startswith("corvane-steps")]


def test_decode_takes_rows_without_ids_and_any_block(spark, monkeypatch):
    tokenizer = op4_bpe.default_tokenizer()
    docs = _edge(spark).select("doc_id", "text")
    monkeypatch.setattr(op4_bpe, "BLOCK_IDS", 5)
    ids = op4_bpe.encode(docs, tokenizer, ["doc_id"]).unionByName(spark.createDataFrame([(99, None)], "doc_id long, ids array<int>"))
    got = Counter((r["doc_id"], r["decoded"]) for r in op4_bpe.decode(ids, tokenizer).collect())
    assert got == Counter([*((r["doc_id"], r["text"] or "") for r in docs.collect()), (99, "")])
