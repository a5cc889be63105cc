"""Exact dedup with a minimal perfect hash over the historical distinct digests.

1. Each row is reduced to (digest of the normalised text, code points, id); texts never leave the scan stage.
2. Rows of the history are aggregated by digest (map-side first, so a group that holds a third of all rows arrives as one
   row a task), dealt into buckets by a digest prefix, and each bucket becomes one index row: a minimal perfect hash
   (hash and displace) with one slot a digest.  A slot holds the full digest and the winner's locator (code points, id)
   and the number of rows.  The number of buckets follows the number of digests, so a bucket stays small at any scale.
3. Arriving rows, aggregated in the same way, look their digest up in its bucket and compare all 32 bytes: members
   update a slot's winner, nonmembers form groups of their own.
4. The winners join back to the rows by digest; the join is a sort-merge join that AQE splits where one digest is hot.

Edge cases: null text counts as empty; blank texts form one group; equal rows (same id twice) all count, and all rows
with the winner's id are marked kept; without history everything is a nonmember; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, strip_space, table

#: Digests that one bucket of the index holds on average.
BUCKET_DIGESTS = 20_000
#: Mean number of digests that share a displacement.
GROUP = 4

_SLOTS = "bucket int, n int, seeds binary, digests binary, lengths binary, ids binary, nulls binary, sizes binary"
_FOUND = "digest binary, member boolean, keep_id long, keep_length long, group_size long"


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes), length (code points of the original) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(strip_space(text), 256)).alias("digest"), F.length(text).cast("long").alias("length"))


def _best(rows: DataFrame) -> DataFrame:
    """One row a digest: its size and the best (code points, then smallest id; a null id loses)."""
    key = F.struct((-F.col("length")).alias("neg"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    got = rows.groupBy("digest").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("size"))
    return got.select("digest", (-F.col("k.neg")).alias("length"), F.col("k.none").alias("none"), F.coalesce("k.id", F.lit(0)).alias("id"), "size")  # no null in a column of ids, which pandas would turn into floats


def _mix(words: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    """A position below n for each digest (its first two 64-bit words) under a seed."""
    with np.errstate(over="ignore"):
        x = words[:, 0] ^ ((words[:, 1] + np.asarray(seed, np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(n)).astype(np.int64)


def build_mph(words: np.ndarray) -> np.ndarray:
    """Displacement seeds of a minimal perfect hash over distinct digests (n rows of two words).

    Digests fall into n / GROUP groups; from the largest group on, the first seed is taken that sends all members of the
    group to free slots that differ.
    """
    n = len(words)
    groups = max(1, math.ceil(n / GROUP))
    of = _mix(words, 0, groups)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(groups + 1))
    sizes = np.diff(bounds)
    seeds, taken = np.zeros(groups, np.uint32), np.zeros(n, bool)
    tries = np.arange(1, 257, dtype=np.uint64)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        members, first = words[order[bounds[g] : bounds[g + 1]]], 0
        while True:
            at = np.stack([_mix(np.repeat(m[None], len(tries), 0), tries + np.uint64(first), n) for m in members], 1)
            free = ~taken[at].any(1)
            if len(members) > 1:
                s = np.sort(at, 1)
                free &= (s[:, 1:] != s[:, :-1]).all(1)
            if free.any():
                k = int(free.argmax())
                seeds[g] = first + k + 1
                taken[at[k]] = True
                break
            first += len(tries)
    return seeds


def mph_slots(words: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each digest; only a digest that the index was built over is certain to own its slot."""
    return _mix(words, seeds[_mix(words, 0, len(seeds))], n)


def _as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)[:, :2]


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index: a row a bucket with the hash's seeds and its slots."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        digests = list(pdf["digest"])
        words = _as_words(digests)
        seeds = build_mph(words)
        at = np.argsort(mph_slots(words, seeds, len(digests)))
        ids, nulls = pdf["id"].to_numpy(np.int64), pdf["none"].to_numpy(bool)
        return pd.DataFrame([{"bucket": key[0], "n": len(digests), "seeds": seeds.tobytes(), "digests": b"".join(digests[i] for i in at),
                              "lengths": pdf["length"].to_numpy(np.int64)[at].tobytes(), "ids": ids[at].tobytes(), "nulls": nulls[at].tobytes(), "sizes": pdf["size"].to_numpy(np.int64)[at].tobytes()}])

    return _best(history).withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(one, _SLOTS)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def look_up(index: DataFrame, arriving: DataFrame, buckets: int) -> DataFrame:
    """One row a distinct digest of history and arrivals together: member (of the index), winner and size."""

    def one(key, slots: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(slots):
            s = slots.iloc[0]
            n = int(s["n"])
            seeds, full = np.frombuffer(s["seeds"], np.uint32), s["digests"]
            lengths, ids, sizes = (np.frombuffer(s[c], np.int64).copy() for c in ("lengths", "ids", "sizes"))
            nulls = np.frombuffer(s["nulls"], bool).copy()
        else:
            n, full = 0, b""
        if len(new):
            digests = list(new["digest"])
            at = mph_slots(_as_words(digests), seeds, n) if n else np.zeros(len(digests), np.int64)
            for d, slot, length, null, row_id, size in zip(digests, at.tolist(), new["length"], new["none"], new["id"], new["size"], strict=True):
                if n and full[32 * slot : 32 * slot + 32] == d:  # all bytes count: a nonmember may fall on any slot
                    sizes[slot] += size
                    if (-length, null, row_id) < (-lengths[slot], nulls[slot], ids[slot]):
                        lengths[slot], ids[slot], nulls[slot] = length, row_id, null
                else:
                    out.append((d, False, None if null else int(row_id), length, size))
        out += [(full[32 * i : 32 * i + 32], True, None if nulls[i] else int(ids[i]), int(lengths[i]), int(sizes[i])) for i in range(n)]
        got = pd.DataFrame(out, columns=["digest", "member", "keep_id", "keep_length", "group_size"])
        got["keep_id"] = pd.array([x[2] for x in out], dtype="Int64")
        return got

    new = _best(arriving).withColumn("bucket", _bucket(buckets))
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInPandas(one, _FOUND)


def dedup(docs: DataFrame, historical: Column) -> DataFrame:
    """Every row with its group's winner.  historical: true on rows of the history (what earlier runs took in)."""
    prints = materialize(fingerprint(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), "prints")  # texts are read and hashed once
    tagged = prints.withColumn("old", F.coalesce(historical, F.lit(False)))
    buckets = max(1, math.ceil(prints.count() / BUCKET_DIGESTS))
    index = build_index(tagged.where("old"), buckets)
    found = look_up(index, tagged.where(~F.col("old")), buckets)
    return prints.join(found, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "member"
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the ids (by crc32) stand for what an earlier run took in; the result is the same for any such split."""
    return dedup(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 2) == 0).drop("member")


def _row_key(doc_id: Column, digest: Column) -> Column:
    return F.concat_ws(":", digest, F.coalesce(doc_id.cast("string"), F.lit("null")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns as they were; of equal rows that repeat the winner's id, one stays.

    The join key holds the digest and the id, so no key is hot, and the last step reuses the join's partitioning.
    """
    kept = dedup(docs, crc_mod(F.col("doc_id"), 2) == 0).where("kept").select(_row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _row_key(F.col("doc_id"), F.sha2(strip_space(text), 256)).alias("key"))
    return held.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


ORACLE = r"""
WITH f AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT h, count(*) AS c, (min({'a': -n, 'b': doc_id})).b AS k FROM f GROUP BY h)
SELECT doc_id, k AS keep_id, c AS group_size, doc_id = k AS kept, f.h AS text_sha256 FROM f JOIN g USING (h)
"""
