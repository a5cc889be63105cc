"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Training (driver, numpy): at most TRAIN_ROWS labelled rows, each reduced on the executors to hashed n-gram counts, so that
a row's size is bounded by DIM whatever its text's length.  Follow-the-regularised-leader (proximal, per-coordinate
rates) with an elastic-net penalty keeps the weights sparse; a temperature fitted on rows that training left out
calibrates the probabilities.  Scoring is one pass over whole texts, without a shuffle; the model (classes x DIM
floats) travels with the tasks.

Edge cases: null texts and texts without a letter are ``und`` with score 0; rows with a null lang or a null text teach
nothing; without training rows everything is ``und``; ties between classes go to the first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, uniform_order

#: At most so many labelled rows are learned from (a documented bound), in a hash order.
TRAIN_ROWS = 4000
DIM, GRAMS, EPOCHS = 1 << 13, (1, 2, 3), 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
#: Letters hashed at once; longer texts are counted part by part.
PART = 1 << 19


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of a whole text, lower-cased."""
    letters = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(DIM, np.float32)
    for at in range(0, len(letters), PART):
        x = letters[at : at + PART + max(GRAMS) - 1]  # a gram belongs to the part that it starts in
        for n in GRAMS:
            starts = min(PART, len(x) - n + 1)
            if starts <= 0:
                continue
            h = x[:starts] * np.uint32(0x9E3779B1) + np.uint32(n)
            for k in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[k : k + starts] * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0x27D4EB2F)
            out += np.bincount(h >> np.uint32(19), minlength=DIM)
    return out


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        size = float(np.sqrt((x * x).sum()))
        return (self.weights @ x) / (size or 1.0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        z = self.logits(gram_counts(text)).astype(np.float64) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.classes[k], float(p[k] / p.sum())


def fit(rows: list[tuple[int, str, np.ndarray, np.ndarray]]) -> Model:
    """rows: (id, class, places, counts) of each training text."""
    classes = sorted({r[1] for r in rows})
    if not classes:
        return Model([], np.zeros(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, np.float32), 1.0)
    df = np.zeros(DIM)
    for _, _, at, _ in rows:
        df[at] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    y = [classes.index(r[1]) for r in rows]
    x = []
    for _, _, at, n in rows:
        v = np.log1p(n) * idf[at]
        x.append((at, (v / (np.sqrt((v * v).sum()) or 1)).astype(np.float64)))
    left_out = [k for k in range(len(rows)) if k % 5 == 0] if len(rows) >= 50 else []
    taught = sorted(set(range(len(rows))) - set(left_out))
    z, sq = np.zeros((len(classes), DIM + 1)), np.zeros((len(classes), DIM + 1))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    rng = np.random.default_rng(9)
    for _ in range(EPOCHS):
        for k in rng.permutation(taught):
            at, v = x[k]
            at, v = np.append(at, DIM), np.append(v, 1.0)
            zz, nn = z[:, at], sq[:, at]
            w = weights(zz, nn)
            p = w @ v
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = p[:, None] * v
            sq[:, at] = nn + g * g
            z[:, at] = zz + g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA * w
    w = weights(z, sq)
    temperature = 1.0
    if left_out:
        scores = np.stack([w[:, x[k][0]] @ x[k][1] + w[:, DIM] for k in left_out])
        truth = np.array([y[k] for k in left_out])

        def loss(t: float) -> float:
            s = scores / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

        temperature = min(np.geomspace(0.1, 10, 81).tolist(), key=loss)
    return Model(classes, idf, w[:, :DIM].astype(np.float32), w[:, DIM].astype(np.float32), temperature)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the places and counts of each text's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [gram_counts(x or "") for x in batch.column(2).to_pylist()]
            at = [np.flatnonzero(c).astype(np.int32) for c in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([c[a] for c, a in zip(got, at, strict=True)], pa.list_(pa.float32()))], ["doc_id", "lang", "at", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, "doc_id long, lang string, at array<int>, n array<float>")


def train(docs: DataFrame, allowed: Column) -> Model:
    """A model from at most TRAIN_ROWS of the rows where allowed is true; ids of the sample (bounded) are broadcast."""
    ids = (docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
           .orderBy(uniform_order(F.col("doc_id"), "lang"), "doc_id").limit(TRAIN_ROWS))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
    sample = known.groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("text")).alias("r")).select("doc_id", "r.*")  # of texts that share an id, always the same
    rows = sorted(((r["doc_id"], r["lang"], np.array(r["at"], np.int64), np.array(r["n"], np.float32)) for r in counted(sample).collect()), key=lambda r: r[0])
    return fit(rows)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return predict(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
