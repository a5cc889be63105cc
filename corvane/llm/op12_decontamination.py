"""Benchmark decontamination: a prefix-filtered set join of item windows against all texts.

1. Windows.  Each item is cut into windows of `window` consecutive words (a shorter item is one window), each with the
   shingles of SHINGLE words at their places.  Equal windows of different items are one window.
2. Rarity.  The shingles of the windows are counted in all texts: a bitmap of them (of a size with a fixed bound) picks the
   texts' shingles that may be among them, tasks count those, the sums are joined to the windows' shingles.
3. Prefix.  A window that must share t of its m shingles needs one of its m - t + 1 rarest.  Only these are looked for.
4. Join.  A second pass over the texts gives the places of prefix shingles with the words around them; they are joined to
   the windows by shingle.  Place of shingle and offset in the window tell where the window would start (positional
   bound); it has to fit into the text (length bound).
5. Verification: of the text's window of the item window's size, t shingles have to be the window's at their places (share
   1: all words are equal).  Words are compared by 64-bit hashes, ten in a row for windows of ten words.

A passage that stands in a third of all texts gives a row an occurrence and prefix shingle; the windows' side is broadcast
while it has at most BROADCAST_ROWS rows and joined by sort and merge (AQE splits hot shingles) beyond.  No text is shuffled.

Edge cases: null and blank texts have no words; items without words have no windows; an item without an id is known by an
empty one, items that share an id are one item; rows that repeat a doc_id, or have none, are documents of their own;
empty tables give no rows, or no hits; other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, materialize, table
from .hashing import Powers, buffers, chunks, mix, prefix_hash

SHINGLE = 3
#: Bits of a bitmap: BITS_PER_KEY a key, at most 2 ** MOST_BITS (16 MB), beyond which more places reach the join.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 32, 16, 27
#: Rows of the windows' side that a broadcast may have; distinct shingles that a task counts before it sends them.
BROADCAST_ROWS, FLUSH = 200_000, 1 << 20
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def text_words(data: np.ndarray, bounds: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of consecutive texts: runs of digits, letters (A-Z as a-z) and all that isn't ASCII."""
    data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    inside = np.concatenate(([False], ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128), [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start, end = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1])), np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    sums, down = prefix_hash(data, powers), powers.upto(len(data) + 1)[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), np.searchsorted(bounds, start, "right") - 1


def shingles(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of `width` words and the place of their first word."""
    at = np.flatnonzero(row[: len(h) - width + 1] == row[width - 1 :]) if len(h) >= width else np.zeros(0, np.int64)
    x = np.full(len(at), width, np.uint64)
    for k in range(width):
        x += h[at + k] * _ODD[k]
    return mix(x), at


def _chunks(column: pa.Array, powers: Powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, bounds = buffers(column)
    for a, b in chunks(bounds):
        own = bounds[a : b + 1]
        yield a, b, *text_words(data[own[0] : own[-1]], own - own[0], powers)


def windows(items: DataFrame, window: int) -> DataFrame:
    """item, words (hashes) and grams (shingles in order) of each window of each item (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for a, b, h, row in _chunks(batch.column(1), powers):
                names, out, grams = [], [], []
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                for i in range(b - a):
                    own = h[cuts[i] : cuts[i + 1]]
                    size = min(window, len(own))
                    found = shingles(own, np.zeros(len(own), np.int64), min(SHINGLE, size))[0].view(np.int64) if size else None
                    for k in range(len(own) - size + 1 if size else 0):
                        names.append(batch.column(0)[a + i])
                        out.append(own[k : k + size].view(np.int64))
                        grams.append(found[k : k + size - min(SHINGLE, size) + 1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))], ["item", "words", "grams"])

    found = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(run, "item string, words array<long>, grams array<long>")
    return found.withColumn("wid", F.xxhash64("words"))


def bitmap(keys: DataFrame) -> np.ndarray:
    """Words of 64 bits: bit h of each h of keys, modulo the number of bits.  What is collected is bounded by MOST_BITS."""
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_PER_KEY * keys.count()).bit_length()))
    at = F.col("h").bitwiseAND(bits - 1)
    rows = keys.select(F.shiftright(at, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(64 * len(bits) - 1)
    return np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))


def counts(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """h and n: how often the texts have the shingles that the bitmap marks, a row a task and shingle or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, keys, n = Powers(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, h, row in _chunks(batch.column(0), powers):
                found = [keys]
                for width in widths:
                    g = shingles(h, row, width)[0]
                    found.append(g[_marked(bits, g)])
                keys, of = np.unique(np.concatenate(found), return_inverse=True)
                n = np.bincount(of, weights=np.concatenate((n, np.ones(len(of) - len(n), np.int64))), minlength=len(keys)).astype(np.int64)
                if len(keys) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])
                    keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, bits: np.ndarray, widths: list[int], window: int) -> DataFrame:
    """A row a document (dk, th, n: its words), and one a place of a marked shingle: dk, th, n, h, pos and the words around (window - 1 on both sides)."""
    reach = np.arange(1 - window, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            dk, th = (batch.column(i) for i in (0, 1))
            for a, b, h, row in _chunks(batch.column(2), powers):
                many = np.bincount(row, minlength=b - a)
                first = np.cumsum(many) - many
                none = lambda kind: pa.nulls(b - a, kind)
                yield pa.RecordBatch.from_arrays([dk.slice(a, b - a), th.slice(a, b - a), pa.array(many.astype(np.int32)), none(pa.int64()), none(pa.int32()), none(pa.list_(pa.int64()))], ["dk", "th", "n", "h", "pos", "around"])
                for width in widths:
                    g, at = shingles(h, row, width)
                    hit = _marked(bits, g)
                    g, at = g[hit], at[hit]
                    for k in range(0, len(at), 20_000):
                        p = at[k : k + 20_000]
                        of = row[p]
                        near = p[:, None] + reach
                        own = (near >= first[of][:, None]) & (near < (first[of] + many[of])[:, None])
                        around = np.where(own, h[np.clip(near, 0, len(h) - 1)], np.uint64(0)).view(np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(reach)), pa.array(around.ravel()))
                        yield pa.RecordBatch.from_arrays([dk.take(pa.array(a + of)), th.take(pa.array(a + of)), pa.array(many[of].astype(np.int32)), pa.array(g[k : k + 20_000].view(np.int64)), pa.array((p - first[of]).astype(np.int32)), lists], ["dk", "th", "n", "h", "pos", "around"])

    return docs.select("dk", "th", "text").mapInArrow(run, "dk long, th long, n int, h long, pos int, around array<long>")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df  # counted: a row has at most `window` hashes


def _prefixes(found: DataFrame, seen: DataFrame, percent: int) -> DataFrame:
    """h, wid, words, offset and least (shingles to share) of the rarest m - least + 1 shingles of each window; only windows that can occur."""
    grams = found.select("wid", "words", F.posexplode("grams").alias("offset", "h")).join(seen, "h", "left")
    rarest = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")))
    least = F.expr(f"cast(({percent} * size(rarest) + 99) div 100 AS int)")
    each = grams.groupBy("wid").agg(F.first("words").alias("words"), rarest.alias("rarest")).withColumn("least", F.greatest(least, F.lit(1)))
    return each.select("wid", "words", "least", F.explode(F.expr("slice(rarest, 1, size(rarest) - least + 1)")).alias("x")).where("x.n > 0").select(F.col("x.h").alias("h"), "wid", "words", F.col("x.offset").alias("offset"), "least")


def _verified(at: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """dk, th, wid, start and stop (words) of every occurrence of a window."""
    both = at.join(prefixes, "h").withColumn("size", F.size("words")).withColumn("start", F.col("pos") - F.col("offset"))
    fits = both.where("start >= 0 AND start + size <= n").withColumn("part", F.expr(f"slice(around, {window} - offset, size)"))
    width = f"least(size, {SHINGLE})"
    equal = f"size(filter(sequence(1, size - {width} + 1), k -> slice(part, k, {width}) = slice(words, k, {width})))"
    return fits.where(f"part = words OR (least < size - {width} + 1 AND {equal} >= least)").select("dk", "th", "wid", "start", (F.col("start") + F.col("size")).alias("stop"))


def _covered(spans: Column) -> Column:
    """Words in at least one of the spans (start, stop), which are sorted."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], a["to"]))).alias("n"), F.greatest(a["to"], x["stop"]).alias("to"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, percent: int = 100) -> DataFrame:
    """doc_id, n_words, spans (start, stop in words, of every window found), n_hit (words in them) and items (sorted ids) of every row.

    A window is found where at least `percent` of its shingles stand at their places.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("dk"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    with Steps(docs.sparkSession) as step:
        cut = step(windows(items, window), "windows")
        found = cut.dropDuplicates(["wid"])
        widths = sorted(r[0] for r in cut.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE numbers
        grams = cut.select(F.explode("grams").alias("h")).distinct()
        seen = counts(docs, bitmap(grams), widths).join(grams, "h", "left_semi")
        prefixes = step(_prefixes(found, seen, percent), "prefixes")
        at = step(places(keyed, bitmap(prefixes.select("h").distinct()), widths, window), "places")
        who = lambda: [F.coalesce("dk", F.lit(-1)).alias("k"), "th"]  # noqa: E731  what is found depends on the text alone
        hits = step(_verified(at.where("h IS NOT NULL"), _small(prefixes), window).select(*who(), "wid", "start", "stop").distinct(), "hits")
        spans = hits.groupBy("k", "th").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
        names = hits.select("k", "th", "wid").distinct().join(_small(cut.select("wid", "item").distinct()), "wid").groupBy("k", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
        rows = at.where("h IS NULL").select("dk", "n", *who()).join(spans.join(names, ["k", "th"]), ["k", "th"], "left")
        spans, names = F.coalesce("spans", F.expr("array()").cast("array<struct<start:int,stop:int>>")), F.coalesce("items", F.array().cast("array<string>"))
        return materialize(rows.select(F.col("dk").alias("doc_id"), F.col("n").cast("long").alias("n_words"), spans.alias("spans"), _covered(spans).cast("long").alias("n_hit"), names.alias("items")), "contamination")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS a FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS a FROM benchmark),
bi AS (SELECT item_id, a, unnest(range(1, greatest(len(a) - 9, 1) + 1)) AS i FROM b WHERE len(a) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(a[i:i + least(len(a), 10) - 1], ' ') AS w, least(len(a), 10) AS k FROM bi),
di AS (SELECT doc_id, a, k, unnest(range(1, len(a) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win)),
g AS (SELECT doc_id, i, k, array_to_string(a[i:i + k - 1], ' ') AS w FROM di),
m AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON g.w = win.w),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.a)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
