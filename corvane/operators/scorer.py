"""The model layer behind an injectable scorer (MDL-1 to 10, FLT-6, 7, 15, PRJ-9, 10)."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.batches import slices
from corvane.schemas import RATINGS, RELEVANCE

from .rank import finalists, pool_lexical, rescored

#: The questions' levels, each with its criterion.
RELEVANCE_QUESTION = dict(zip(RELEVANCE, ("matches the taste digest strongly and immediately", "clear overlap with the taste digest", "partial overlap with the taste digest",
                                          "tangential to the taste digest", "no meaningful overlap with the taste digest"), strict=True))
NOUL_QUESTION = {"true": "there is meaningful overlap with the taste digest", "false": "no meaningful overlap with the taste digest"}
RATING_QUESTION = RATINGS

#: A scorer gets the question's kind and states (JSON) and returns a distribution for each; it may raise.
Scorer = Callable[[str, list[str]], list[dict[str, float]]]

ANSWER = "id string, primitive string, distribution map<string,double>, confidence double, top string, latency_ms int, ok boolean, fail_reason string"


def ask(states: DataFrame, primitive: str, scorer: Scorer | None, least: float = 0.6, keep: str = "") -> DataFrame:
    """MDL-4, FLT-6: answers and receipts of states (id, state); failures become reasons, never exceptions.

    keep: columns of states, with types, that the answers have too.  A task holds a few states at a time.
    """
    more = [x.split()[0] for x in keep.split(",")] if keep else []

    columns = ["id", "primitive", "distribution", "confidence", "top", "latency_ms", "ok", "fail_reason", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.map_(pa.string(), pa.float64()), pa.float64(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
        for batch in batches:
            for part in slices(batch):
                out = []
                for key, state in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    began, dist, reason = time.monotonic(), {}, None
                    if scorer is None:
                        reason = "no-key"
                    elif state is None:
                        reason = "state-overflow"
                    else:
                        try:
                            dist = scorer(primitive, [state])[0]
                        except Exception as e:  # noqa: BLE001  an outage of any kind is journalled as one
                            reason = f"outage: {type(e).__name__}"
                    top = min(dist, key=lambda k: (-dist[k], k)) if dist else None
                    sure = dist[top] if dist else None
                    if sure is not None and sure < least:
                        reason = "low-confidence"
                    out.append((key, primitive, list(dist.items()), sure, top, int(1000 * (time.monotonic() - began)), reason is None, reason))
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, *part.columns[2:]], columns)

    return states.select(F.col("id").cast("string").alias("id"), "state", *more).mapInArrow(run, f"{ANSWER}, {keep}" if keep else ANSWER)


def stand_in(primitive: str, states: list[str]) -> list[dict[str, float]]:
    """A deterministic scorer for tests."""
    out = []
    for s in states:
        x = int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        out.append({"true": x, "false": 1 - x} if primitive == "noul" else {RELEVANCE[int(x * 4.999)]: 0.7, RELEVANCE[int(x * 4.999) - 1]: 0.3})
    return out


def mass_of(key: Column, seed: str = "mass") -> Column:
    """A stand-in mass in [0, 1) that SQL engines agree on: the first seven hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 7), 16, 10).cast("double") / 268435456.0


def model_first(items: DataFrame, top: int = 5) -> DataFrame:
    """MDL-5: all eligible items by model mass; one that the model failed on needs a lexical score."""
    ok = F.col("mass").isNotNull() | (F.col("score") > 0)
    return items.where(ok).withColumn("mass", F.coalesce("mass", F.lit(0.0))).orderBy(F.desc("mass"), F.desc("score"), "id").limit(top)


def lifted(pooled: DataFrame, least: float = 0.6) -> DataFrame:
    """FLT-7: survivors, and near-misses and probes that the model lifts over a threshold; rescued tells the pool of the latter."""
    kept = pooled.where((F.col("pool") == "survivor") | (F.col("pool").isin("near-miss", "probe") & (F.col("mass") >= least)))
    return kept.withColumn("rescued", F.when(F.col("pool") != "survivor", F.col("pool")))


def lexical_first(pooled: DataFrame, least: float = 0.6, top: int = 5) -> DataFrame:
    """MDL-6, FLT-7: what is lifted and the survivors, ranked together."""
    return lifted(pooled, least).orderBy(F.desc("mass"), F.desc("score"), "id").limit(top)


def two_pass(items: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """MDL-7: the k finalists with the masses of a second pass."""
    return rescored(finalists(items, ["run"], k), second)


def with_content(items: DataFrame, cache: DataFrame) -> DataFrame:
    """MDL-8: candidates with cached conclusions; missed tells which a connector has to fetch."""
    got = items.join(cache.select(F.col("arxiv").alias("id"), "conclusions"), "id", "left")
    return got.withColumn("missed", F.col("conclusions").isNull())


def bound(candidates: DataFrame, receipts: DataFrame) -> DataFrame:
    """JOIN-15: candidates with the receipt of their call (run_id, id), the last where a call was repeated; none where it failed."""
    rest = [c for c in receipts.columns if c not in ("run_id", "id")]
    last = receipts.groupBy("run_id", "id").agg(F.max_by(F.struct(*rest), "pos").alias("receipt"))
    return candidates.join(last, ["run_id", "id"], "left")


def unrated(notes: DataFrame, proposals: DataFrame) -> DataFrame:
    """FLT-15, MDL-9: notes with an id, without a rating and without a proposal."""
    return notes.where("rating IS NULL AND arxiv IS NOT NULL").join(proposals.select("arxiv"), "arxiv", "left_anti")


def states_of(items: DataFrame) -> DataFrame:
    return items.select("id", F.to_json(F.struct("*")).alias("state"))


__all__ = ["ask", "json", "lexical_first", "mass_of", "model_first", "pool_lexical", "stand_in", "states_of", "two_pass", "unrated", "with_content"]
