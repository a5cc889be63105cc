"""Toxicity by a convolutional text classifier, trained over all labelled rows.

Words and their beginnings (PREFIXES bytes) are hashed.  Those that speak for the label in the training rows, and the most
frequent words, have an embedding of their own bucket; a word has that of its most telling unit, and all other words share
a few.  Filters of several widths run over a text's embeddings, each keeps its maximum over the whole text, and a linear
layer reads the maxima.  Embeddings start from a unit's evidence (signed root of its log-likelihood ratio), filters from small
random numbers; all are trained by Adagrad on the rows' logistic loss.  Max pooling sends a gradient to one place of a
text for each filter only, so a text of any length is trained on and scored whole.

Thresholds are calibrated by language: the training rows' languages teach a small naive Bayes over the same words, the
threshold of each language is the one with the best F1 on rows left out of training (a fifth, by a hash of the id), and a
score is moved so that its language's threshold is at 0.5.  The language of a text is guessed from its words; no column but
text is an input.

``learn`` (the query's way) uses every labelled row and whole text.  Units are counted by tasks and summed by Spark; texts are
saved as tokens, dealt to shards of about SHARD_ROWS rows by a hash of the id, and in each epoch every shard descends from
the same weights, whose moves are then averaged over the shards that made them; languages are counted, and thresholds found
from counts by language and score (BINS a unit of logit).  The driver gets what the model holds: at most UNITS telling units
and FREQUENT words, its weights, and those counts.  The model doesn't depend on how rows
lie.  ``train`` is the variant for one machine: at most TRAIN_ROWS rows and TRAIN_BYTES bytes of whole texts of each label in
memory (documented bounds; no query uses it), weighted by the classes' counts in the whole table.  Scoring is one narrow
pass; the model travels with the tasks.

Edge cases: null and blank texts have no words and get the score of an empty text; without rows of both labels the score
is the share of toxic rows (0 without rows); ids that repeat in labels count once, with their largest label; labelled rows of
fewer than 60 ids, or of one label only on either side, aren't split, and thresholds come from the rows trained on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Steps, crc_mod, table, uniform_order
from .hashing import Powers, word_chunks

#: At most so many labelled rows of each label are learned from by ``train`` (documented bounds), in a hash order.
TRAIN_ROWS = 2000
#: At most so many bytes of whole texts of each label: in the hash order, rows up to the first that doesn't fit any more.
TRAIN_BYTES = 256 << 20
#: Bytes of a word's beginnings that are units too; frequent words that tell languages apart.
PREFIXES, FREQUENT = (4, 5, 6, 7, 8), 2000
BUCKETS, SHARED, DIM, WIDTHS, FILTERS, EPOCHS, BATCH, RATE = 1 << 15, 16, 8, (1, 2, 3), 6, 4, 64, 0.08
#: Rows of label 1 that must hold a unit, and the evidence that it must have, for an embedding of its own.
MIN_ROWS, MIN_EVIDENCE = 3, 4.0
#: Of the units that speak for label 1, counted over all rows, the UNITS that start furthest have an embedding each (a model's size).
UNITS = BUCKETS - FREQUENT
#: About so many rows, and bytes of tokens, are seen between two averages of the weights by one task.
SHARD_ROWS, SHARD_BYTES = 4096, 16 << 20
#: Tokens worked on at once; units a task counts at once; parts of a unit of logit that thresholds tell apart; a sum's steps.
PIECE, HELD, BINS, UNIT = 1 << 20, 1 << 20, 1024, 2.0**32


@dataclass
class Model:
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    bucket: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    evidence: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    emb: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + SHARED + 1, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    flat: float | None = 0.0
    languages: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + SHARED + 1, 1), np.float32))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Embedding rows of words, given a row of unit hashes each: that of the unit with the most evidence."""
        if not len(h):
            return np.zeros(0, np.int32)
        _, first, inverse = np.unique(h[:, 0], return_index=True, return_inverse=True)
        units = h[first]
        best, out = np.full(len(units), -1.0, np.float32), (BUCKETS + (units[:, 0] % np.uint64(SHARED)).astype(np.int32)).astype(np.int32)
        if len(self.known):
            for k in range(units.shape[1]):
                at = np.searchsorted(self.known, units[:, k])
                at[at == len(self.known)] = 0
                better = (self.known[at] == units[:, k]) & (self.evidence[at] > best)
                best[better], out[better] = self.evidence[at[better]], self.bucket[at[better]]
        return out[inverse]

    def pooled(self, tokens: np.ndarray, starts: np.ndarray, place: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of every filter over each text; tokens of consecutive texts, each followed by padding. place: also where they are."""
        x = self.emb[tokens]
        values, where = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            y = x @ f[0]
            for k in range(1, w):
                y[:-k] += x[k:] @ f[k]
            for k in range(1, w):
                y[np.append(starts[1:], len(tokens)) - k] = -np.inf  # such a window would reach into the next text
            best = np.maximum.reduceat(y, starts, axis=0)
            values.append(np.maximum(best, 0))
            if place:
                ends = np.append(starts[1:], len(tokens))
                where.append(np.stack([a + y[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)]))
        return np.concatenate(values, 1), np.concatenate(where, 1) if place else None

    def logits(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.pooled(tokens, starts)[0] @ self.out + self.bias

    def language(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.languages[tokens], starts, axis=0).argmax(1)

    def score(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(starts), self.flat)
        z = self.logits(tokens, starts) - self.cuts[self.language(tokens, starts)]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


_PAD = BUCKETS + SHARED
_GAP = max(WIDTHS)


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each followed by padding, and where each starts."""
    n = np.array([len(t) + _GAP for t in texts])
    starts = np.cumsum(n) - n
    out = np.full(int(n.sum()), _PAD, np.int32)
    for s, t in zip(starts, texts, strict=True):
        out[s : s + len(t)] = t
    return out, starts


def _evidence(units: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units that speak for label 1 with their evidence, and the most frequent words (evidence 0), by hash."""
    toxic, seen = np.unique(np.concatenate([np.unique(u) for u, label in zip(units, y, strict=True) if label == 1]), return_counts=True)
    toxic, a = toxic[seen >= MIN_ROWS], seen[seen >= MIN_ROWS].astype(np.float64)
    b = np.zeros(len(toxic))
    for u, label in zip(units, y, strict=True):
        if label == 0 and len(toxic):
            at = np.searchsorted(toxic, mine := np.unique(u))
            at[at == len(toxic)] = 0
            b[at[toxic[at] == mine]] += 1
    na, nb = y.sum(), (1 - y).sum()
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / e), 0)
    share = (a + b) / (na + nb)
    g = 2 * (part(a, na * share) + part(b, nb * share) + part(na - a, na * (1 - share)) + part(nb - b, nb * (1 - share)))
    z = np.sqrt(np.maximum(g, 0)) * np.sign(a / na - b / nb)
    toxic, z = toxic[z >= MIN_EVIDENCE], z[z >= MIN_EVIDENCE]
    words, count = np.unique(np.concatenate([u[:, 0] for u in units]), return_counts=True)
    frequent = np.setdiff1d(words[np.argsort(-count, kind="stable")[:FREQUENT]], toxic)
    known, z = np.concatenate((toxic, frequent)), np.concatenate((z, np.zeros(len(frequent))))
    o = np.argsort(known)
    return known[o], z[o]


def _fresh(known: np.ndarray, bucket: np.ndarray, evidence: np.ndarray, start: np.ndarray, share: float, rng: np.random.Generator) -> Model:
    """An untrained model: units with their buckets and evidence, where the first component of each one's embedding starts, the share of label 1."""
    m = Model(flat=None)
    m.known, m.evidence, m.bucket = known, evidence.astype(np.float32), bucket.astype(np.int32)
    m.emb = rng.normal(0, 0.05, (BUCKETS + SHARED + 1, DIM)).astype(np.float32)
    m.emb[:, 0] = 0
    strong = np.zeros(BUCKETS)
    np.maximum.at(strong, m.bucket, start)
    m.emb[:BUCKETS, 0] = strong
    m.emb[_PAD] = 0
    m.filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in m.filters:
        f[:, 0, 0] = 1
    m.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    m.out[::FILTERS] = 1
    m.bias = float(np.log(share / (1 - share)))
    return m


@dataclass
class Squares:
    """Adagrad's sums of squared gradients of a model's weights."""

    emb: np.ndarray
    filters: list[np.ndarray]
    out: np.ndarray
    bias: float = 1e-2

    @classmethod
    def of(cls, m: Model) -> Squares:
        return cls(np.full_like(m.emb, 1e-3), [np.full_like(f, 1e-2) for f in m.filters], np.full_like(m.out, 1e-2))


def _pieces(texts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most PIECE tokens, or of one longer text."""
    first = size = 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) + _GAP > PIECE:
            yield first, k
            first, size = k, 0
        size += len(t) + _GAP
    yield first, len(texts)


def _descend(m: Model, sq: Squares, texts: list[np.ndarray], y: np.ndarray) -> None:
    """One step of Adagrad on a batch of texts (tokens) and their labels."""
    g_out, g_bias, g_f, moved = 1e-4 * m.out, 0.0, [np.zeros_like(f) for f in m.filters], []
    for a, b in _pieces(texts):
        tokens, starts = laid_out(texts[a:b])
        v, where = m.pooled(tokens, starts, True)
        p = 1 / (1 + np.exp(-np.clip(v @ m.out + m.bias, -30, 30)))
        d = ((p - y[a:b]) / len(texts)).astype(np.float32)
        g_out, g_bias, g_v = v.T @ d + g_out, g_bias + float(d.sum()), d[:, None] * m.out * (v > 0)
        for i, (w, f) in enumerate(zip(WIDTHS, m.filters, strict=True)):
            own, place = g_v[:, i * FILTERS : (i + 1) * FILTERS], where[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(w):
                t = tokens[np.minimum(place + k, len(tokens) - 1)]
                g_f[i][k] += np.einsum("rfd,rf->df", m.emb[t], own)
                moved.append((t.ravel(), (own[:, :, None] * f[k].T[None]).reshape(-1, DIM)))
    sq.out += g_out**2
    m.out -= RATE * g_out / np.sqrt(sq.out)
    sq.bias += g_bias**2
    m.bias -= RATE * g_bias / np.sqrt(sq.bias)
    for f, g, q in zip(m.filters, g_f, sq.filters, strict=True):
        q += g**2
        f -= RATE * g / np.sqrt(q)
    u, inverse = np.unique(np.concatenate([t for t, _ in moved]), return_inverse=True)
    total = np.zeros((len(u), DIM), np.float32)
    np.add.at(total, inverse, np.concatenate([g for _, g in moved]))
    total[u >= BUCKETS] = 0  # shared rows and padding say nothing of a word
    sq.emb[u] += total**2
    m.emb[u] -= 0.5 * RATE * total / np.sqrt(sq.emb[u])


def fit(hashes: list[np.ndarray], labels: list[int], langs: list[str | None], seed: int = 2, stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model of rows in memory.  stands_for: how many labelled rows of the table one row of label 0 and of label 1 stands for."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(flat=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    out = np.arange(len(y)) % 5 == 0 if len(y) >= 60 else np.zeros(len(y), bool)
    taught = np.flatnonzero(~out)
    known, z = _evidence([hashes[k] for k in taught], y[taught])
    m = _fresh(known, known % np.uint64(BUCKETS), z, np.tanh(np.maximum(z, 0) / 10), y[taught].mean(), rng)
    texts, sq = [m.tokens(h) for h in hashes], Squares.of(m)
    for _ in range(EPOCHS):
        order = rng.permutation(taught)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            _descend(m, sq, [texts[k] for k in rows], y[rows])
    names = sorted({x for x in langs if x is not None}) or [""]
    counts = np.full((BUCKETS + SHARED + 1, len(names)), 0.5)
    for k in taught:
        if langs[k] is not None:
            counts[:, names.index(langs[k])] += np.bincount(texts[k], minlength=BUCKETS + SHARED + 1)
    m.languages = np.log(counts / counts.sum(0)).astype(np.float32)
    m.languages[BUCKETS:] = 0
    m.bias += float(np.log(stands_for[1] / stands_for[0]))  # learned at the sample's shares
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    tokens, starts = laid_out(texts)
    z, lang = m.logits(tokens, starts), m.language(tokens, starts)
    held = np.flatnonzero(out) if out.any() else np.arange(len(y))
    overall = _cut(z[held], y[held], weight[held])
    m.cuts = np.array([_cut(z[own], y[own], weight[own]) if (own := held[lang[held] == k]).size >= 40 and 0 < y[own].mean() < 1 else overall for k in range(len(names))])
    return m


def _cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of best F1 of weighted rows, in the middle of its gap."""
    o = np.argsort(-z, kind="stable")
    hit = np.cumsum((weight * y)[o])
    f1 = 2 * hit / (np.cumsum(weight[o]) + max(1, (weight * y).sum()))
    k = int(f1.argmax())
    return float((z[o[k]] + z[o[min(k + 1, len(y) - 1)]]) / 2)


def unit_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Unit hashes of each text's words."""
    out: list[np.ndarray] = []
    for a, b, h, row in word_chunks(pa.array(texts, pa.string()), Powers(), True, PREFIXES):
        out += np.split(h, np.searchsorted(row, np.arange(1, b - a)))
    return out


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """For one machine: a model from at most TRAIN_ROWS rows and TRAIN_BYTES bytes of each label where allowed (a condition on doc_id) is true."""
    known = labels.where(allowed & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [uniform_order(F.col("doc_id"), "toxic"), F.col("doc_id")]
    ids = known.where("toxic = 1").orderBy(*order).limit(TRAIN_ROWS).unionByName(known.where("toxic = 0").orderBy(*order).limit(TRAIN_ROWS))
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")  # ids: at most 2 * TRAIN_ROWS
    sample = rows.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("text")).alias("r")).select("doc_id", "toxic", "r.*")  # of texts that share an id, always the same
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = sample.select("doc_id", size.alias("size"), F.sum(size).over(Window.partitionBy("toxic").orderBy(*order)).alias("upto"))  # at most TRAIN_ROWS rows a label
    fits = sizes.where(F.col("upto") <= TRAIN_BYTES).select("doc_id")
    rows = sorted(sample.select("doc_id", "lang", "text", "toxic").join(F.broadcast(fits), "doc_id").collect(), key=lambda r: r["doc_id"])
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    taken = Counter(r["toxic"] for r in rows)
    stands_for = tuple(max(1.0, total.get(k, 0) / max(1, taken[k])) for k in (0, 1))
    return fit(unit_hashes([r["text"] for r in rows]), [r["toxic"] for r in rows], [r["lang"] for r in rows], stands_for=stands_for)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a task: each unit's rows of label 1 (a) and 0 (b) and its occurrences as a word (n); parts of at most about HELD units."""
    powers, pending, size = Powers(), [], 0

    def summed() -> list[np.ndarray]:
        units, inverse = np.unique(np.concatenate([p[0] for p in pending]), return_inverse=True)
        return [units, *(np.bincount(inverse, np.concatenate([p[k] for p in pending]), len(units)).astype(np.int64) for k in (1, 2, 3))]

    def sent(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(part[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)].view(np.int64)) for x in part], ["unit", "a", "b", "n"])

    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for a, b, h, row in word_chunks(batch.column(1), powers, True, PREFIXES):
            if not len(h):
                continue
            _, first, word, times = np.unique(h[:, 0], return_index=True, return_inverse=True, return_counts=True)
            units, at = np.unique(h[first], return_inverse=True)
            at = at.reshape(len(first), -1)
            pair = np.unique(row * len(first) + word)  # a row's distinct words, then its distinct units
            pair = np.unique(((pair // len(first))[:, None] * len(units) + at[pair % len(first)]).ravel())
            mark, unit = toxic[a:b][pair // len(units)], pair % len(units)
            pending.append([units, *(np.bincount(x, minlength=len(units)) for x in (unit[mark], unit[~mark])), np.bincount(at[:, 0], times, len(units))])
            size += len(units)
            if size > HELD:
                pending = [summed()]
                size = len(pending[0][0])
                if size > HELD // 2:
                    yield from sent(pending[0])
                    pending, size = [], 0
    if pending:
        yield from sent(summed())


def _evidence_of(counts: DataFrame, na: int, nb: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _evidence, from a table of counts: units, evidence, and how far a unit's start is from that of one without evidence.

    A unit's start is its evidence (to 1) times the excess of label 1 among its rows (both labels as if equally frequent),
    because the evidence of any difference, however small, grows with the table; units are chosen by it.
    """
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    a, b, share = F.col("a").cast("double"), F.col("b").cast("double"), (F.col("a") + F.col("b")) / (na + nb)
    g = 2 * (part(a, na * share) + part(b, nb * share) + part(na - a, na * (1 - share)) + part(nb - b, nb * (1 - share)))
    telling = counts.where((F.col("a") >= MIN_ROWS) & (a / na > b / nb)).select("unit", F.sqrt(F.greatest(g, F.lit(0.0))).alias("z"), ((a / na - b / nb) / (a / na + b / nb)).alias("excess"))
    top = telling.where(F.col("z") >= MIN_EVIDENCE).withColumn("start", F.tanh(F.col("z") / 10) * F.col("excess")).orderBy(F.desc("start"), "unit").limit(UNITS).toArrow()
    words = counts.where("n > 0").orderBy(F.desc("n"), "unit").limit(FREQUENT).toArrow()["unit"].to_numpy().view(np.uint64)
    units, z, start = top["unit"].to_numpy().view(np.uint64), top["z"].to_numpy(), top["start"].to_numpy()
    frequent = np.setdiff1d(words, units)
    none = np.zeros(len(frequent))
    known, z, start = np.concatenate((units, frequent)), np.concatenate((z, none)), np.concatenate((start, none))
    o = np.argsort(known)
    return known[o], z[o], start[o]


def _tokenised(rows: DataFrame, m: Model) -> DataFrame:
    """rows with their texts as 16-bit tokens."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for a, b, h, row in word_chunks(batch.column("text"), powers, True, PREFIXES):
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b - a)))) * 2
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(m.tokens(h).astype(np.uint16))])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in kept), packed], [*kept, "tokens"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "tokens binary"]))


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int32) if x else np.zeros(0, np.int32) for x in column.to_pylist()]


def _flat(emb: np.ndarray, filters: list[np.ndarray], out: np.ndarray, bias: float) -> np.ndarray:
    """All weights (or their squares) as rows of DIM numbers: the embeddings, then the rest with zeros at its end."""
    rest = np.concatenate([*(f.ravel() for f in filters), out, [bias]]).astype(np.float64)
    return np.concatenate((emb.astype(np.float64), np.append(rest, np.zeros(-len(rest) % DIM)).reshape(-1, DIM)))


def _shaped(flat: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, float]:
    n = BUCKETS + SHARED + 1
    rest, filters, at = flat[n:].ravel(), [], 0
    for w in WIDTHS:
        filters.append(rest[at : at + w * DIM * FILTERS].reshape(w, DIM, FILTERS).astype(np.float32))
        at += w * DIM * FILTERS
    size = len(WIDTHS) * FILTERS
    return flat[:n].astype(np.float32), filters, rest[at : at + size].astype(np.float32), float(rest[at + size])


def _epoch(texts: DataFrame, weights: np.ndarray, squares: np.ndarray, shards: int, epoch: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and squares after every row was seen once: each shard descends from the same weights, and what it has moved is averaged.

    A row of weights counts the shards that moved it alone, so a word of few shards learns as fast as one of all.
    Moves are summed as whole numbers of UNIT, so that no order of summing shows.
    """
    names = [f"{k}{d}" for k in "pq" for d in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own, rows, y = None, None, [], []

        def moved() -> pa.RecordBatch:
            m, sq = state
            if rows:
                _descend(m, sq, rows, np.array(y, np.float64))
            p, q = (_flat(x.emb, x.filters, x.out, x.bias) - _flat(*_shaped(before)) for x, before in ((m, weights), (sq, squares)))
            both = np.rint(np.concatenate((p, q), 1) * UNIT).astype(np.int64)
            at = np.flatnonzero(both.any(1))
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c) for c in both[at].T.copy())], ["row", *names])

        for batch in batches:
            for shard, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(batch.column(2)), strict=True):
                if shard != own:
                    if own is not None:
                        yield moved()
                    emb, filters, out, bias = _shaped(weights)
                    own, rows, y, state = shard, [], [], (Model(emb=emb, filters=filters, out=out, bias=bias), Squares(*_shaped(squares)))
                rows.append(text)
                y.append(toxic)
                if len(rows) == BATCH:
                    _descend(*state, rows, np.array(y, np.float64))
                    rows, y = [], []
        if own is not None:
            yield moved()

    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard")
    order = texts.select(shard, "toxic", "tokens", "doc_id", F.xxhash64("doc_id", F.lit(epoch)).alias("place")).repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "doc_id")
    moves = order.select("shard", "toxic", "tokens").mapInArrow(run, ", ".join(["row int", *(f"{n} long" for n in names)]))
    got = moves.groupBy("row").agg(F.count("*").alias("shards"), *(F.sum(n).alias(n) for n in names)).toArrow()  # a model's rows at most
    at, shares = got["row"].to_numpy(), got["shards"].to_numpy()[:, None] * UNIT
    weights, squares = weights.copy(), squares.copy()
    weights[at] += np.stack([got[n].to_numpy() for n in names[:DIM]], 1) / shares
    squares[at] += np.stack([got[n].to_numpy() for n in names[DIM:]], 1) / shares
    return weights, squares


def _language_weights(texts: DataFrame) -> np.ndarray:
    """Naive Bayes weights of the rows' languages, from the counts of tokens of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "token", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), strict=True):
                if lang not in counts and len(counts) == 64:
                    yield from sent()
                n = counts.setdefault(lang, np.zeros(BUCKETS + SHARED + 1, np.int64))
                np.add.at(n, text, 1)
        yield from sent()

    known = texts.where("lang is not null")
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect()) or [""]
    got = known.select("lang", "tokens").mapInArrow(run, "lang string, token int, n long").groupBy("lang", "token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS + SHARED + 1, len(names)), 0.5)
    at = {x: k for k, x in enumerate(names)}
    counts[got["token"].to_numpy(), [at[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
    weights = np.log(counts / counts.sum(0)).astype(np.float32)
    weights[BUCKETS:] = 0
    return weights


def _cuts(texts: DataFrame, m: Model) -> np.ndarray:
    """The threshold of each language (that of all rows for one with few), from counts of all rows by language and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _unpacked(batch.column(1))
            for a, b in _pieces(texts) if texts else ():
                tokens, starts = laid_out(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(m.language(tokens, starts).astype(np.int32)), pa.array(m.logits(tokens, starts).astype(np.float64)), batch.column(0).slice(a, b - a).cast(pa.int32())], ["lang", "z", "toxic"])

    scored = texts.select("toxic", "tokens").mapInArrow(run, "lang int, z double, toxic int")
    bin_ = F.floor(F.least(F.greatest("z", F.lit(-64.0)), F.lit(64.0)) * BINS).alias("bin")
    got = scored.groupBy("lang", bin_).agg(F.sum("toxic").alias("hit"), F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).toArrow()  # 128 * BINS rows a language at most
    lang, bins, hit, n, low, high = (got[c].to_numpy() for c in ("lang", "bin", "hit", "n", "low", "high"))

    def best(own: np.ndarray) -> float:
        ids, at = np.unique(-bins[own], return_inverse=True)  # from the highest scores on
        total, hits = np.bincount(at, n[own]), np.bincount(at, hit[own])
        lowest, highest = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
        np.minimum.at(lowest, at, low[own])
        np.maximum.at(highest, at, high[own])
        k = int((2 * np.cumsum(hits) / (np.cumsum(total) + max(1, hits.sum()))).argmax())
        return float((lowest[k] + (highest[k + 1] if k + 1 < len(ids) else lowest[k])) / 2)

    overall = best(np.arange(len(n)))
    own = [np.flatnonzero(lang == k) for k in range(m.languages.shape[1])]
    return np.array([best(x) if n[x].sum() >= 40 and 0 < hit[x].sum() < n[x].sum() else overall for x in own])


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, seed: int = 2) -> Model:
    """A model from every labelled row where allowed (a condition on doc_id) is true; the query's way."""
    known = labels.where(allowed & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(allowed & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text").join(known, "doc_id")
    one = rows.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("text")).alias("r")).select("doc_id", "toxic", "r.*")  # of texts that share an id, always the same
    with Steps(docs.sparkSession) as step:
        one = step(one.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0), "rows")
        n = Counter({(r["toxic"], r["fold"]): r["count"] for r in one.groupBy("toxic", "fold").count().collect()})
        ones, zeros = (n[k, False] + n[k, True] for k in (1, 0))
        if not ones or not zeros:
            return Model(flat=1.0 if ones else 0.0)
        folded = ones + zeros >= 60 and all(n.values()) and len(n) == 4  # enough rows of both labels on either side
        na, nb = (n[1, False], n[0, False]) if folded else (ones, zeros)
        taught = one.where("not fold") if folded else one
        counts = step(taught.select("toxic", "text").mapInArrow(_partial_counts, "unit long, a long, b long, n long").groupBy("unit").agg(*(F.sum(c).alias(c) for c in "abn")), "counts")
        units, _, start = _evidence_of(counts, na, nb)
        m = _fresh(units, np.arange(len(units)), start, start, na / (na + nb), np.random.default_rng(seed))  # a bucket each
        texts = step(_tokenised(one, m), "texts")
        taught, held = (texts.where("not fold"), texts.where("fold")) if folded else (texts, texts)
        size = taught.agg(F.sum(F.octet_length("tokens"))).first()[0]
        shards = max(1, -(-(na + nb) // SHARD_ROWS), -(-size // SHARD_BYTES))
        sq = Squares.of(m)
        weights, squares = (_flat(x.emb, x.filters, x.out, x.bias) for x in (m, sq))
        for epoch in range(EPOCHS):
            weights, squares = _epoch(taught, weights, squares, shards, epoch)
        m.emb, m.filters, m.out, m.bias = _shaped(weights)
        m.languages = _language_weights(taught)
        m.cuts = _cuts(held, m)
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for a, b, h, row in word_chunks(batch.column(1), powers, True, PREFIXES):
                n = np.bincount(row, minlength=b - a)
                shift = np.arange(b - a) * _GAP
                tokens = np.full(len(h) + (b - a) * _GAP, _PAD, np.int32)
                tokens[np.arange(len(h)) + shift[row]] = model.tokens(h)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(tokens, np.cumsum(n) - n + shift), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents")
    got = score(docs, learn(docs, table(spark, sf_dir, "labels"), ~held_out))
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
