"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles, with connected components.

1. Texts become sets of 64-bit shingle hashes.  Equal sets form a class, known by a digest of 64 bits (``node``; classes
   are counted by 128); from step 3 on only one text of a class takes part, and all rows get its component at the end.
2. Coarse filter, exact.  A set's shingles in hash order: of two linked sets, the first k common shingles lie among the
   first n - t + k of both (t: least overlap).  With k in proportion to n, a set that finds fewer than k of its prefix
   in prefixes of other sets links with nothing.  That drops nearly all unrelated texts for a fifth of their shingles.
   A task sends the prefix of equal sets once.
3. The rest get their shingles counted in full.  Shingles of one set only don't matter; the others are ordered rarest
   first, and a set whose shared shingles are fewer than its least overlap drops out.
4. Heavy and light.  Small (light) sets enumerate all subsets of two shingles of their prefix as keys; large (heavy) sets
   use single shingles, that is they scan inverted lists, which light sets enter too.  The boundary is the size at which
   the summed cost (subsets written against list entries read) is least, from a histogram by size.
5. Pivot rounds.  Each list names its most typical set (whose shingles most sets hold); each set is verified against
   one such pivot in another component, and the components of all links so far are taken.  A group of near copies of any
   size collapses in one round, a verification a set.  Rounds go on while they pay.
6. Exact pass over lists that still span components.  A set outside its list's main component looks for partners by
   key and size: the shingles left of a set bound the size of whom it can link with, so sizes are probed in bins, an
   equi-join.  Members of one component never meet, and every pair that is left is verified.

Keys that many rows share: prefixes and counts are aggregated before the shuffle, joins are sort-merge joins that AQE
splits, and joins on a component's root are salted.

Edge cases: no words or null text: an empty set, n_shingles 0, a component of its own; with fewer words than a shingle
has, the whole sequence is the one shingle; rows that repeat a doc_id are documents of their own; component_id is the
smallest doc_id of the component, null where all its rows have none; an empty table gives no rows; other columns of the
input are ignored by ``join_components`` and passed on by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, materialize, table
from .hashing import Powers, mix, word_chunks

#: A further round of pivots follows while one in so many of a round's verifications links.
PAYS = 100
#: What reading a list entry costs at most, in subsets written: lists collapse around pivots, so long ones aren't read in pairs.
READS = 6
#: Bins of set sizes to a doubling; tasks that a component's rows are dealt to.
BINS, SALTS = 24, 32
#: Rows (two numbers each) that a broadcast may have.
BROADCAST_ROWS = 200_000
_NULL_ID = 2**63 - 1
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def shingles(h: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, by row and then hash, from its words' hashes in order."""
    many = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    full = max(0, len(h) - width + 1)
    whole = row[:full] == row[width - 1 :] if full else np.zeros(0, bool)
    x = np.full(full, width, np.uint64)
    for k in range(width):
        x += h[k : k + full] * _ODD[k % 8] * np.uint64(2 * (k // 8) + 1)
    keys, of = mix(x[whole]), row[:full][whole]
    short = np.flatnonzero((many > 0) & (many < width))
    if len(short):
        first = np.cumsum(many) - many
        s = many[short].astype(np.uint64)
        for k in range(width - 1):
            has = many[short] > k
            s[has] += h[first[short[has]] + k] * _ODD[k % 8] * np.uint64(2 * (k // 8) + 1)
        keys, of = np.concatenate((keys, mix(s))), np.concatenate((of, short))
    o = np.lexsort((keys, of))
    keys, of = keys[o], of[o]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[new], of[new]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.view(np.int64)))


def _k(n):
    """Common shingles that the coarse filter asks for; works on numbers, arrays and columns (integer arithmetic)."""
    return (n * 4 + 99) // 100


def sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """dk, th, n and digest (d1, d2) of every row's set, and its hash-ordered prefix, where the task meets the set first; docs has dk, th and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, met = Powers(), np.zeros(0, np.uint64)
        for batch in batches:
            for a, b, h, row in word_chunks(batch.column(2), powers, True):
                keys, of = shingles(h, row, b - a, width)
                n, d = digests(keys, of, b - a)
                first = np.cumsum(n) - n
                new = np.zeros(b - a, bool)
                new[np.unique(d[0], return_index=True)[1]] = True
                new &= ~np.isin(d[0], met)
                met = np.concatenate((met, d[0][new]))
                prefix = np.where(new, np.minimum(n, n * (100 - percent) // 100 + np.maximum(_k(n), 1)), 0)
                inside = np.arange(len(keys)) - first[of] < prefix[of]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int32)), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), _lists(keys[inside], prefix)], ["dk", "th", "n", "d1", "d2", "prefix"])

    return docs.select("dk", "th", "text").mapInArrow(run, "dk long, th long, n int, d1 long, d2 long, prefix array<long>")


def digests(keys: np.ndarray, of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 128-bit digest (two rows of numbers) of each set; empty sets have a digest of zeros."""
    n = np.bincount(of, minlength=rows)
    first, some, d = np.cumsum(n) - n, np.flatnonzero(n), np.zeros((2, rows), np.uint64)
    if len(some):
        for i in (0, 1):
            d[i, some] = mix(np.add.reduceat(mix(keys ^ _ODD[i]), first[some]) + n[some].astype(np.uint64))
    return n, d


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, n and all shingles of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for a, b, h, row in word_chunks(batch.column(0), powers, True):
                keys, of = shingles(h, row, b - a, width)
                n, d = digests(keys, of, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(d[0].view(np.int64)), pa.array(n.astype(np.int32)), _lists(keys, n)], ["node", "n", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, n int, shingles array<long>")


def _first_row() -> Column:
    """The row of a class or component that stands for it: smallest doc_id, null last, then a hash of the text."""
    return F.min(F.struct(F.col("dk").isNull().alias("none"), F.col("dk").alias("dk"), F.col("th").alias("th")))


def _survivors(found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """dk, th of a row of each class that the coarse filter leaves."""
    tokens = found.where("size(prefix) > 0").select("d1", F.explode("prefix").alias("h"))
    common = tokens.groupBy("h").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low < high").select("h")
    hits = tokens.join(common, "h", "left_semi").groupBy("d1").agg(F.count(F.lit(1)).alias("hits"))
    need = F.expr(f"greatest(1, (((n * {percent} + 99) div 100) * 4 + 99) div 100) * sent")
    return classes.join(hits, "d1").where(F.col("hits") >= need).select(F.col("w.dk").alias("dk"), F.col("w.th").alias("th")).distinct()


def _rare_first(full: DataFrame, percent: int) -> DataFrame:
    """Sets that may still link: node, n, least (overlap), hs (shingles that other sets hold too, rarest first), cs (counts of its prefix) and typical."""
    tokens = full.select("node", "n", F.explode("shingles").alias("h"))
    counts = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = tokens.join(counts, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("shared"))
    shared = shared.withColumn("least", F.expr(f"(n * {percent} + 99) div 100").cast("int")).where(F.size("shared") >= F.col("least"))
    typical = F.aggregate("shared", F.lit(0.0), lambda a, x: a + x["c"]) / F.col("n")
    return shared.select("node", "n", "least", F.col("shared.h").alias("hs"), F.expr("transform(slice(shared, 1, size(shared) - least + 1), x -> x.c)").alias("cs"), typical.alias("typical"))


def boundary(costs: list[tuple[int, float, float]]) -> int:
    """The size up to which sets are light: (size, cost as light, cost as heavy) rows; the split of least total cost."""
    costs = sorted(costs)
    total = sum(c[2] for c in costs)
    best, at = total, 0
    for size, light, heavy in costs:
        total += light - heavy
        if total < best:
            best, at = total, size
    return at


def _keys(shared: DataFrame, percent: int) -> DataFrame:
    """key, node, n, typical, most (size of the largest partner that a set can link with if they meet here first) and lone (keys of one light shingle) of every list entry."""
    rem, prefix = F.size("hs"), F.size("cs")
    costs = shared.select("n", F.floor(F.log2(F.col("n").cast("double")) * 4).alias("step"), ((prefix + 1) * prefix / 2 + prefix).alias("light"), F.aggregate("cs", F.lit(0.0), lambda a, c: a + F.least(c, F.lit(READS))).alias("heavy"))
    rows = costs.groupBy("step").agg(F.max("n").alias("n"), F.sum("light").alias("light"), F.sum("heavy").alias("heavy")).collect()  # a few rows an octave of sizes
    light_to = boundary([(r["n"], r["light"], r["heavy"]) for r in rows])
    tagged = shared.withColumn("light", (F.col("n") <= light_to) & (F.col("least") >= 2))
    single = tagged.select("node", "n", "typical", "light", rem.alias("r"), F.posexplode(F.expr("slice(hs, 1, size(cs))")).alias("i", "h"))
    single = single.select(F.xxhash64(F.lit("one"), "h").alias("key"), "node", "n", "typical", (F.col("r") - F.col("i")).alias("rem"), F.col("light").alias("lone"))
    pairs = F.expr("flatten(transform(slice(hs, 1, size(cs) + 1), (x, i) -> transform(slice(hs, i + 2, greatest(size(cs) - i, 0)), (y, j) -> named_struct('a', x, 'b', y, 'i', i))))")
    double = tagged.where("light").select("node", "n", "typical", rem.alias("r"), F.explode(pairs).alias("x"))
    key = F.xxhash64(F.lit("two"), F.least("x.a", "x.b"), F.greatest("x.a", "x.b")).alias("key")
    double = double.select(key, "node", "n", "typical", (F.col("r") - F.col("x.i")).alias("rem"), F.lit(False).alias("lone"))
    most = F.expr(f"cast(((100 + {percent}) * rem) div {percent} - n AS int)").alias("most")
    return single.unionByName(double).select("key", "node", "n", "typical", most, "lone")


def verified(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    left = shared.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha"))
    right = shared.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("o"))
    return both.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _by_root(rows: DataFrame, roots: DataFrame, root: str, spread: Column) -> DataFrame:
    """rows joined to roots (a row a root); a root's rows are dealt to SALTS tasks, since one component may hold any share of them."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    return salted.join(roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), [root, "salt"], "left").drop("salt")


def components(edges: DataFrame, step: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, root of every node of an edge (a, b): its component's least node.  Least neighbours and pointer jumps until nothing changes."""
    both = step(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = step(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = now.join(near, now["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("up"))
        jump = now.where("root < node").select(F.col("node").alias("up"), F.col("root").alias("top")).join(lower.select("up").distinct(), "up", "left_semi")
        nxt = step(_by_root(lower, jump, "up", F.col("node")).select("node", "was", F.coalesce("top", "up").alias("root")), "roots")
        now = nxt.select("node", "root")
        if not nxt.where("was <> root").limit(1).count():
            return now


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """entries with c, the component of each one's set (the set itself where it has no link yet)."""
    if labels is None:
        return entries.withColumn("c", F.col("node"))
    return entries.join(labels, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root")


def _open(listed: DataFrame, order: Column) -> DataFrame:
    """Entries of the lists in which different components can meet, with the list's pivot p (least by order) and its component."""
    heads = listed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("lone").alias("all_lone"), F.min(F.struct(order.alias("o"), F.col("node").alias("node"), F.col("c").alias("c"))).alias("p"))
    return listed.join(heads.where("low < high AND NOT all_lone").select("key", "p"), "key")


def _bin(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * BINS).cast("int")


def _meeting(open_lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open lists that the bounds allow: sets outside a list's main component against all others there."""
    probes = open_lists.where("c <> p.c").select("key", "node", "n", "c", "most", "lone", F.expr(f"(n * {percent} + 99) div 100").cast("int").alias("least"), F.least(F.col("most"), F.expr(f"n * 100 div {percent}").cast("int")).alias("upto"))
    probes = probes.where("least <= upto").withColumn("bin", F.explode(F.sequence(_bin(F.col("least")), _bin(F.col("upto")))))
    x, y = probes.alias("x"), open_lists.withColumn("bin", _bin(F.col("n"))).withColumn("main", F.col("c") == F.col("p.c")).alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.c") != F.col("y.c")) & (F.col("y.main") | (F.col("x.node") < F.col("y.node")))
    fits = (F.col("y.n") >= F.col("x.least")) & (F.col("y.n") <= F.col("x.upto")) & (F.col("x.n") <= F.col("y.most")) & ~(F.col("x.lone") & F.col("y.lone"))
    return x.join(y, meet & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def link(shared: DataFrame, percent: int, step: Callable[[DataFrame, str], DataFrame], rounds: int | None = None) -> DataFrame | None:
    """node, root (least node of its component) of every set of shared that links; rounds: pivot rounds at most (the result is the same)."""
    entries = step(_keys(shared, percent), "keys")
    labels, links, r = None, None, 0
    while rounds is None or r < rounds:
        order = F.xxhash64(F.lit(r), "node") if r else -F.col("typical")
        spanning = step(_open(_labelled(entries, labels), order), "lists")
        chosen = step(spanning.where("c <> p.c").groupBy(F.col("node").alias("a")).agg(F.min("p").alias("p")).select("a", F.col("p.node").alias("b")), "chosen")
        new = step(verified(chosen, shared, percent), "links")
        tried, linked = chosen.count(), new.count()
        if linked:
            links = new if links is None else links.unionByName(new)
            labels = components(links, step)
        entries, r = spanning.drop("c", "p"), r + 1
        if linked * PAYS <= tried:
            break
    rest = step(_open(_labelled(entries, labels), -F.col("typical")), "open")
    new = step(verified(step(_meeting(rest, percent), "meeting"), shared, percent), "links")
    if not new.limit(1).count():
        return labels
    return components(new if links is None else links.unionByName(new), step)


def _rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """dk, th, n and the first row (w: dk, th) of its component, of every row of docs (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("dk"), _text_hash().alias("th"), "text")
    with Steps(docs.sparkSession) as step:
        found = step(sets(keyed, width, percent), "sets")
        classes = step(found.where("n > 0").groupBy("d1", "d2").agg(F.first("n").alias("n"), F.count_if(F.size("prefix") > 0).alias("sent"), _first_row().alias("w")), "classes")
        some = step(_survivors(found, classes, percent), "survivors")
        few = some.count() <= BROADCAST_ROWS
        key = [F.coalesce("dk", F.lit(_NULL_ID)).alias("k"), "th"]
        texts = keyed.select(*key, "text").join(F.broadcast(some.select(*key)) if few else some.select(*key), ["k", "th"], "left_semi")  # counted: at most BROADCAST_ROWS
        full = step(full_sets(texts, width).where("n > 0").dropDuplicates(["node"]), "full")
        shared = step(_rare_first(full, percent), "shared")
        labels = link(shared, percent, step)
        if labels is not None:
            linked = classes.join(labels.withColumnRenamed("node", "d1"), "d1").select("d1", "d2", "root", "w.dk", "w.th")
            firsts = linked.groupBy("root").agg(_first_row().alias("top"))
            tops = _by_root(linked, firsts, "root", F.col("d1")).select("d1", "d2", "top")
            classes = classes.join(tops, ["d1", "d2"], "left").withColumn("w", F.coalesce("top", "w"))
        rows = found.select("dk", "th", "n", "d1", "d2").join(classes.select("d1", "d2", "w"), ["d1", "d2"], "left")
        alone = F.struct(F.col("dk").isNull().alias("none"), "dk", "th")
        return materialize(rows.select("dk", "th", "n", F.when(F.col("n") > 0, F.col("w")).otherwise(alone).alias("w")), "jaccard")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def join_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: sets of width words link at a Jaccard similarity of percent / 100."""
    return _rows(docs, width, percent).select(F.col("dk").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("w.dk").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), 4, 85)


def one_of_each(docs: DataFrame) -> DataFrame:
    """A document of each component (words of five, similarity 0.8), all columns as they were: the one with the smallest id.

    Null ids come last, then a hash of the text decides.  Of rows with equal id and text one stays; texts without words
    link with nothing and stay.  The row's id and text hash are joined under names of their own, as one struct.
    """
    first = _rows(docs, 5, 80).where(F.struct("dk", "th").eqNullSafe(F.struct("w.dk", "w.th"))).select(_row_key(F.col("dk"), F.col("th")).alias("key")).distinct()
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _row_key(F.col("doc_id").cast("long"), _text_hash()).alias("key"))
    return held.join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def _row_key(dk: Column, th: Column) -> Column:
    return F.concat_ws(":", F.coalesce(dk.cast("string"), F.lit("null")), th.cast("string"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[^ ]+') AS a FROM documents),
s AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')] ELSE list_distinct(list_transform(range(1, len(a) - 2), lambda i: a[i] || ' ' || a[i+1] || ' ' || a[i+2] || ' ' || a[i+3])) END AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
rep AS (SELECT x FROM t GROUP BY x HAVING count(*) > 1),
u AS (SELECT t.* FROM t JOIN rep USING (x)),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS o FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p WHERE 100 * o >= 85 * (m + n - o)),
e AS (SELECT i, j FROM l UNION SELECT j, i FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.doc_id)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, m.root AS component_id FROM s JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m USING (doc_id)
"""
