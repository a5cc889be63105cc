"""Suffix-array dedup by prefix-free parsing: bytes under a repeated WINDOW-byte string go, the first occurrence stays.

1. Triggers.  A rolling hash over GRAM bytes picks a trigger in every window of WINDOW bytes: the least hash in it, the
   leftmost of equal ones.  Equal windows have the same trigger at the same place.  The windows that share a trigger
   occurrence are one phrase; a phrase's text is the union of its windows, so phrases overlap by WINDOW - 1 bytes and
   no window reaches out of its phrase.
2. Parse and dictionary.  A phrase is known by a hash of its text and place of trigger.  Of each distinct phrase the first
   occurrence (doc_id, start) enters the dictionary; every later one is removed whole.  Tasks keep the first of their own
   before anything is shuffled, so a passage in a third of all documents arrives as one entry a task.  A task deals to at
   most FAN ranges of buckets at once; where there are more buckets, tasks of a range merge what arrives, in portions of
   bounded size, and deal it to narrower ranges.  So a phrase costs the same at every size of the corpus, a very common one
   is merged level by level, and a trigger that only many tasks together show to be hot is found on the way.
3. Of the dictionary, only phrases whose trigger also stands in another distinct phrase can share a window.  Their texts
   meet by trigger; the suffixes of all of them are sorted by their first WINDOW bytes (prefix doubling: 8, 16, 32, 64,
   then WINDOW), which with the entries' positions gives the order of equal windows in the corpus.  All but the first of
   a class are removed.  What repeats as a whole never gets here, so highly repetitive text costs little.
4. Triggers with more than HOT distinct phrases (a border of a very common passage) would gather in one task; their
   windows go the exact way of a grouped minimum over window hashes, which is summed before it is shuffled.
5. Spans join back to the texts.

Edge cases: null text is empty; texts shorter than WINDOW have no windows; a null doc_id comes after all others; rows
that repeat a doc_id and text are one document, given back as often as they came; equal (or no) doc_ids with other texts
are documents of their own, told apart and ordered by a 64-bit hash of the text; an empty table gives no rows; other
columns are ignored.  Phrases are compared by 64-bit hashes of text and place, windows of hot triggers by 128 bits.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, materialize, table
from .hashing import Powers, buffers, chunks, mix, prefix_hash

WINDOW, GRAM = 100, 16
#: Phrases that a task gathers before it sends them; phrases of a bucket; bytes of dictionary text of a bucket.
FLUSH, BUCKET_PHRASES, BUCKET_BYTES = 300_000, 120_000, 1 << 20
#: Distinct phrases of a trigger from which on its windows are grouped one by one: in a task's share, in all.
TASK_HOT, HOT = 2048, 20_000
#: Shares that a task deals to at once; tasks that the shares of a wide range of buckets go to.
FAN, SALTS = 1024, 32
DUP, DETAIL, HOT_DETAIL = 0, 1, 2
_LAST_ID = 2**63 - 1


def window_triggers(gram: np.ndarray) -> np.ndarray:
    """For each start of a window, the place of the least gram hash in it (leftmost of equal ones)."""
    width = WINDOW - GRAM + 1
    n = len(gram)
    if n < width:
        return np.zeros(0, np.int64)
    x = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    x[:n] = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    rows = x.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(data: np.ndarray, bounds: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Of consecutive texts: (row, first window, last window, trigger hash, phrase hash); windows count from the text's start."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_hash(data, powers)
    down = powers.upto(len(data) + 1)[1]
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    trigger = window_triggers(gram)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(trigger)]
    inside = np.arange(len(trigger)) + WINDOW <= bounds[row + 1]
    new = np.ones(len(trigger), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    low = np.flatnonzero(new & inside)
    if not len(low):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    last = np.ones(len(trigger), bool)
    last[:-1] = new[1:] | ~inside[1:]
    high = np.flatnonzero(last & inside)
    at = trigger[low]
    shape = ((high - low).astype(np.uint64) << np.uint64(8)) | (at - low).astype(np.uint64)
    whole = mix((sums[high + WINDOW] - sums[low]) * down[low] + mix(shape))
    r = row[low]
    return r, low - bounds[r], high - bounds[r], gram[at], whole


def _pack(h: np.ndarray, k: np.ndarray, doc: np.ndarray, tag: np.ndarray, low: np.ndarray, high: np.ndarray, dup: tuple, hot: np.ndarray, known: bool) -> bytes:
    """One task's share of a bucket: entries (hashes raw, places compressed), removed phrases and hot triggers."""
    small = zlib.compress(np.diff(doc, prepend=0).tobytes() + tag.astype(np.int64).tobytes() + low.astype(np.int32).tobytes() + (high - low).astype(np.uint8).tobytes()
                          + np.diff(dup[0], prepend=0).tobytes() + dup[1].astype(np.int64).tobytes() + dup[2].astype(np.int32).tobytes() + (dup[3] - dup[2]).astype(np.uint8).tobytes(), 1)
    return struct.pack("<IIII", len(h), len(dup[0]), len(hot), known) + h.tobytes() + k.tobytes() + hot.tobytes() + small


def _unpack(blob: bytes) -> tuple:
    n, m, q, known = struct.unpack_from("<IIII", blob)
    at = 16
    h, k = (np.frombuffer(blob, np.uint64, n, at + 8 * n * i) for i in (0, 1))
    hot = np.frombuffer(blob, np.uint64, q, at + 16 * n)
    small, at, out = zlib.decompress(blob[16 + 16 * n + 8 * q :]), 0, []
    for count in (n, m):
        doc = np.cumsum(np.frombuffer(small, np.int64, count, at))
        tag = np.frombuffer(small, np.int64, count, at + 8 * count)
        low = np.frombuffer(small, np.int32, count, at + 16 * count)
        size = np.frombuffer(small, np.uint8, count, at + 20 * count)
        out.append((doc, tag, low, low + size))
        at += 21 * count
    return h, k, hot, bool(known), *out


def _firsts(k: np.ndarray, doc: np.ndarray, tag: np.ndarray, low: np.ndarray) -> np.ndarray:
    """True at the first occurrence (doc, tag, low) of each k, and at what repeats its very place."""
    o = np.lexsort((low, tag, doc, k))
    ks, ds, ts, ls = k[o], doc[o], tag[o], low[o]
    head = np.concatenate(([True], ks[1:] != ks[:-1])) if len(o) else np.zeros(0, bool)
    at = np.maximum.accumulate(np.where(head, np.arange(len(o)), 0)) if len(o) else np.zeros(0, np.int64)
    out = np.empty(len(o), bool)
    out[o] = (ds == ds[at]) & (ts == ts[at]) & (ls == ls[at])
    return out


def spans(buckets: int) -> list[int]:
    """Buckets to a share at each level, the last 1: a task deals its phrases to at most FAN shares at once, whatever their number is."""
    out, span = [], buckets
    while not out or span > 1:
        span = max(1, math.ceil(span / FAN))
        out.append(span)
    return out


def _dealt(entries: tuple[np.ndarray, ...], known: np.ndarray, marks: np.ndarray, gone: tuple[np.ndarray, ...], buckets: int, span: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Entries (h, k, doc, tag, low, high), marks of hot triggers and removed phrases as shares of the buckets that occur among them.

    The first occurrence of a phrase stays an entry, later ones join the removed ones, which go with any share.  Entries of
    triggers that are hot here are dealt by phrase; a mark of the trigger goes where its other entries go.
    """
    h, k, doc, tag, low, high = entries
    first = _firsts(k, doc, tag, low)
    gone = tuple(np.concatenate((x, y[~first])) for x, y in zip(gone, (doc, tag, low, high), strict=True))
    h, k, doc, tag, low, high, known = (x[first] for x in (h, k, doc, tag, low, high, known))
    u, inverse = np.unique(h, return_inverse=True)
    hot = u[np.bincount(inverse[~known], minlength=len(u)) > TASK_HOT]
    known = known | np.isin(h, hot)
    marks = np.union1d(marks, hot)
    n = np.uint64(buckets)
    share = lambda at: (at % n).astype(np.int64) // span
    to, marks_to = share(np.where(known, mix(k), h)) * 2 + known, share(marks) * 2
    groups = np.unique(np.concatenate((to, marks_to)))
    if not len(groups):
        groups = np.zeros(1, np.int64)
    o, marks = np.argsort(to, kind="stable"), marks[np.argsort(marks_to, kind="stable")]
    cuts, marks_cuts = (np.searchsorted(np.sort(x), np.append(groups, np.iinfo(np.int64).max)) for x in (to, marks_to))
    by_doc = np.lexsort((gone[2], gone[1], gone[0]))
    gone_cuts = np.arange(len(groups) + 1) * len(by_doc) // len(groups)
    names, blobs = [], []
    for i, g in enumerate(groups.tolist()):
        a, b = o[cuts[i] : cuts[i + 1]], by_doc[gone_cuts[i] : gone_cuts[i + 1]]
        names.append(g // 2)
        blobs.append(_pack(h[a], k[a], doc[a], tag[a], low[a], high[a], tuple(x[b] for x in gone), marks[marks_cuts[i] : marks_cuts[i + 1]], g % 2 == 1))
    for at in range(0, len(names), 64):
        some = len(names[at : at + 64])
        yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 64], pa.int64()), pa.array([salt] * some, pa.int32()), pa.array(blobs[at : at + 64], pa.binary())], ["bucket", "salt", "share"])


def _salt() -> int:
    context = TaskContext.get()
    return context.partitionId() % SALTS if context is not None else 0


def _of_task(buckets: int, span: int):
    """Texts to shares."""

    def send(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, tag, low, high, h, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        nothing = tuple(np.zeros(0, x.dtype) for x in (doc, tag, low, high))
        yield from _dealt((h, k, doc, tag, low, high), np.zeros(len(h), bool), h[:0], nothing, buckets, span, _salt())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, parts, held = Powers(), [], 0
        for batch in batches:
            ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, bounds = buffers(batch.column(2))
            for a, b in chunks(bounds):
                own = bounds[a : b + 1]
                row, low, high, h, k = phrases(data[own[0] : own[-1]], own - own[0], powers)
                parts.append((ids[a:b][row], tags[a:b][row], low, high, h, k))
                held += len(row)
                if held >= FLUSH:
                    yield from send(parts)
                    parts, held = [], 0
        if held:
            yield from send(parts)

    return run


def _joined(blobs: list[bytes]) -> tuple:
    """Entries, which of them are dealt by phrase, marks and removed phrases of several shares."""
    shares = [_unpack(x) for x in blobs]
    h, k, marks = (np.concatenate([s[i] for s in shares]) for i in range(3))
    known = np.concatenate([np.full(len(s[0]), s[3]) for s in shares])
    doc, tag, low, high = (np.concatenate([s[4][i] for s in shares]) for i in range(4))
    return (h, k, doc, tag, low, high), known, marks, tuple(np.concatenate([s[5][i] for s in shares]) for i in range(4))


def _merged(buckets: int, span: int):
    """Shares of wide ranges of buckets to shares of narrow ones: what many tasks hold first is merged on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, held = [], 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                blobs.append(blob)
                held += sum(struct.unpack_from("<II", blob))
                if held >= FLUSH:
                    yield from _dealt(*_joined(blobs), buckets, span, _salt())
                    blobs, held = [], 0
        if blobs:
            yield from _dealt(*_joined(blobs), buckets, span, _salt())

    return run


_SHARE = "bucket long, salt int, share binary"
_FLAGS = "dk long, tag long, low int, high int, kind int, h long"


def _of_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """The dictionary of a bucket: which entries are later occurrences, and which may share windows with others."""
    (h, k, doc, tag, low, high), known, marks, gone = _joined(list(pdf["share"]))
    first = _firsts(k, doc, tag, low)
    kind = np.where(first, -1, DUP)
    at = np.flatnonzero(first & ~known)
    if len(at):
        _, inverse = np.unique(h[at], return_inverse=True)
        n = np.bincount(inverse)[inverse]
        kind[at] = np.where((n > HOT) | np.isin(h[at], marks), HOT_DETAIL, np.where(n > 1, DETAIL, -1))
    kind[first & known] = HOT_DETAIL
    keep = kind >= 0
    zero = np.zeros(len(gone[0]), np.int64)
    return pd.DataFrame({"dk": np.concatenate((doc[keep], gone[0])), "tag": np.concatenate((tag[keep], gone[1])).astype(np.int64), "low": np.concatenate((low[keep], gone[2])).astype(np.int32),
                         "high": np.concatenate((high[keep], gone[3])).astype(np.int32), "kind": np.concatenate((kind[keep], zero)).astype(np.int32), "h": np.concatenate((h[keep].view(np.int64), zero))})


_TEXTS = "dk long, tag long, low int, h long, data binary, w1 long, w2 long"


#: Two hashes of a byte, far from linear in it: of the windows of hot triggers.
_BYTES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _window_hashes(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each window of a text."""
    up, down = powers.upto(len(raw) + 1)
    out = []
    for t in _BYTES:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(t[raw] * up[: len(raw)], out=sums[1:])
        out.append(mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(raw) - WINDOW + 1]).view(np.int64))
    return out[0], out[1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of dictionary entries; of hot triggers, a row a window with 128 bits of hash."""
    powers = Powers()
    for batch in batches:
        out: list[tuple] = []
        for dk, tag, packed, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = zlib.decompress(packed)
            for m in marks:
                data = raw[m["low"] : m["high"] + WINDOW]
                if m["kind"] == DETAIL:
                    out.append((dk, tag, m["low"], m["h"], data, None, None))
                    continue
                w1, w2 = _window_hashes(np.frombuffer(data, np.uint8), powers)
                out += [(dk, tag, m["low"] + i, m["h"], None, x, y) for i, (x, y) in enumerate(zip(w1.tolist(), w2.tolist(), strict=True))]
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["dk", "tag", "low", "h", "data", "w1", "w2"])


def window_classes(text: np.ndarray) -> np.ndarray:
    """For each start, the class of the WINDOW bytes from there on (equal bytes, equal class), by prefix doubling; text is padded at its end."""
    n = len(text)
    x = np.concatenate((text, np.zeros(WINDOW, np.uint8))).astype(np.uint64)
    first = np.zeros(n + WINDOW - 8, np.uint64)
    for i in range(8):
        first = (first << np.uint64(8)) | x[i : len(x) - 8 + i]
    rank = np.unique(first, return_inverse=True)[1]
    for step in (8, 16, 32):
        rank = np.unique(rank[:-step] * np.int64(len(rank) + 1) + rank[step:], return_inverse=True)[1]
    jump = WINDOW - 64
    return np.unique(rank[:n] * np.int64(len(rank) + 1) + rank[jump : jump + n], return_inverse=True)[1] if len(rank) >= jump + n else _short(rank, n, jump)


def _short(rank: np.ndarray, n: int, jump: int) -> np.ndarray:
    padded = np.concatenate((rank, np.zeros(jump + n - len(rank), rank.dtype)))
    return np.unique(padded[:n] * np.int64(len(padded) + 1) + padded[jump : jump + n], return_inverse=True)[1]


def _sorted_suffixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of dictionary entries that an earlier entry has, as runs of starts.

    Entries are laid out in the order of the corpus (a window is in one entry of its text), so the first of equal windows
    is the one with the least place.
    """
    pdf = pdf.drop_duplicates(["dk", "tag", "low"]).sort_values(["dk", "tag", "low"], ignore_index=True)
    lengths = np.fromiter(map(len, pdf["data"]), np.int64, len(pdf))
    text = np.frombuffer(b"".join(pdf["data"]), np.uint8)
    ends = np.cumsum(lengths)
    whole = np.ones(len(text), bool)
    whole[(ends[:, None] - np.arange(1, WINDOW)).ravel()] = False  # windows don't reach out of their entry
    at = np.flatnonzero(whole)
    of = window_classes(text)[at]
    o = np.argsort(of, kind="stable")
    first = np.ones(len(o), bool)
    first[1:] = of[o[1:]] != of[o[:-1]]
    later = np.ones(len(o), bool)
    later[o[first]] = False
    at = at[later]
    entry = np.searchsorted(ends, at, "right")
    doc, tag, low = (pdf[c].to_numpy()[entry] for c in ("dk", "tag", "low"))
    return _runs(entry, doc, tag, low + (at - (ends - lengths)[entry]))


def _runs(entry: np.ndarray, doc: np.ndarray, tag: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    new = np.ones(len(w), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (w[1:] != w[:-1] + 1)
    low = np.flatnonzero(new)
    high = np.append(low[1:] - 1, len(w) - 1) if len(low) else low
    return pd.DataFrame({"dk": doc[low].astype(np.int64), "tag": tag[low].astype(np.int64), "low": w[low].astype(np.int32), "high": w[high].astype(np.int32)})


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))


def _keyed(docs: DataFrame, apart: bool) -> DataFrame:
    """dk, tag, text, doc_id; apart: some texts share an id, so all rows are told apart by text too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(_id().alias("dk"), (F.xxhash64(text) if apart else F.lit(0).cast("long")).alias("tag"), text.alias("text"), F.col("doc_id"))


def _measured(docs: DataFrame) -> tuple[int, bool]:
    """Bytes of all texts, and whether texts that differ share an id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    by = docs.select(_id().alias("dk"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n")).groupBy("dk").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.sum("n").alias("n"))
    total, shared = by.agg(F.sum("n"), F.count_if(F.col("low") != F.col("high"))).first()
    return total or 0, bool(shared)


def _packed(keyed: DataFrame) -> DataFrame:
    """keyed with its texts compressed: they are shuffled twice, and shuffles compress text to little less than its size."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([zlib.compress((x.as_py() or "").encode(), 1) for x in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["dk", "tag", "doc_id", "packed"])

    return keyed.select("dk", "tag", "doc_id", "text").mapInArrow(run, f"dk long, tag long, doc_id {kind}, packed binary")


def repeats(docs: DataFrame, step: Steps) -> tuple[DataFrame, bool]:
    """dk, tag, low, high: runs of window starts in docs whose windows occur earlier; and whether tags tell texts apart."""
    total, apart = _measured(docs)
    keyed = _keyed(docs, apart)
    buckets = max(1, math.ceil(total / 43 / BUCKET_PHRASES))
    first, *narrower = spans(buckets)
    shares = keyed.select("dk", "tag", "text").mapInArrow(_of_task(buckets, first), _SHARE)
    for span in narrower:
        shares = shares.repartition("bucket", "salt").sortWithinPartitions("bucket").select("share").mapInArrow(_merged(buckets, span), _SHARE)
    flags = step(shares.groupBy("bucket").applyInPandas(_of_bucket, _FLAGS), "flags")
    detail = flags.where(F.col("kind") != DUP).groupBy("dk", "tag").agg(F.collect_set(F.struct("low", "high", "kind", "h")).alias("marks"))
    texts = step(_packed(keyed).join(detail, ["dk", "tag"]).select("dk", "tag", "packed", "marks").mapInArrow(_texts, _TEXTS), "phrases")
    entries = texts.where("data IS NOT NULL")
    held = entries.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(1, math.ceil(held / BUCKET_BYTES))
    dealt = entries.select("dk", "tag", "low", "data", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int").alias("part"))
    within = dealt.groupBy("part").applyInPandas(_sorted_suffixes, "dk long, tag long, low int, high int")
    hot = texts.where("data IS NULL")
    earliest = hot.groupBy("w1", "w2").agg(F.min(F.struct("dk", "tag", "low")).alias("e"))
    single = hot.join(earliest, ["w1", "w2"]).where(F.struct("dk", "tag", "low") > F.col("e")).select("dk", "tag", "low", F.col("low").alias("high"))
    return flags.where(F.col("kind") == DUP).select("dk", "tag", "low", "high").unionByName(within).unionByName(single), apart


def _cut(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, packed, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, spans = zlib.decompress(packed), []
                for low, high in sorted((r["low"], r["high"] + WINDOW) for r in runs or ()):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(high, spans[-1][1])
                    else:
                        spans.append([low, high])
                at, kept = 0, []
                for low, high in spans:
                    kept.append(raw[at:low])
                    at = high
                kept = b"".join([*kept, raw[at:]])
                row = (doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, [x for s in spans for x in s], kept) if with_kept else row)
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()][: len(out[0]) if out else 5]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(kinds)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """Sizes and digest of what stays of every row; with_kept: also the removed spans (start, end, start, end...) and the bytes that stay."""
    with Steps(docs.sparkSession) as step:
        found, apart = repeats(docs, step)
        runs = materialize(found.groupBy("dk", "tag").agg(F.collect_set(F.struct("low", "high")).alias("runs")), "runs")
    joined = _packed(_keyed(docs, apart)).join(runs, ["dk", "tag"], "left").select("doc_id", "packed", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", spans array<long>, kept binary" if with_kept else ""
    return joined.mapInArrow(_cut(with_kept), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
