"""Spelling variant grouping: letter-parity bitmasks in three bands, joined by equal bands, filtered by length and verified.

1. Vocabulary.  Runs of letters are counted, summed in each task before the shuffle, so a word of every text is one row a task.
2. Masks.  A word's mask holds a bit a letter: whether it occurs an odd number of times.  One inserted or deleted letter
   flips one bit, a replaced one at most two; of three bands of the mask, at least one is the same for two near words.
3. Keys.  Bands alone would gather ever more words under a key, since an alphabet has few parities.  The edit also has a
   place: of three pieces of the shorter word (``_CUTS``) two are equal.  A key is a band, its bits, the place of the
   edit, the two other pieces and the shorter length, which is the length filter: a word enters under its own length and
   the one below.  Two words meet under several keys; ``_first_meeting`` takes the first of them, so no pair is made twice.
4. Pairs that meet are verified by edit distance (Spark's ``levenshtein`` with a threshold) inside the join.
5. A word's form is its most frequent near word if that is at least ``ratio`` times as frequent; counts grow along forms,
   so chains are short and pointer jumps end after a few rounds.

Hot keys: a group of words that share two thirds of their letters is spread by the parity of the rest, and what is left
of it is split by AQE's skew join.  All steps are written in the shared folder.

Edge cases: null texts have no runs; a null doc_id counts as an empty one in the checksum; rows that repeat a doc_id
count as often as they stand there; an empty table gives no rows; ties of frequency go to the smallest word by code
points; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, materialize, table

LETTERS = r"[A-Za-zÀ-ÿ]"
BANDS = 3
#: Bits of a mask, and those of each band.
BITS = 63
_BAND = tuple(sum(1 << k for k in range(b, BITS, BANDS)) for b in range(BANDS))
#: Code points of the shorter word before its second and third piece.
_CUTS = ("{0} div 3", "(2 * {0}) div 3")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(run: Column) -> Column:
    """Only A-Z to lower case; what is ASCII goes the faster way."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def vocabulary(docs: DataFrame, every: int | None = None, shortest: int = 7, least: int = 2) -> DataFrame:
    """word and n of every run of at least `shortest` letters that occurs `least` times or more.

    every: a run whose checksum (crc32 of ``<doc_id>:<run>``) it divides loses a letter, by the same checksum.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"{LETTERS}{{{shortest},}}+"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", _folded(F.col("run")).alias("word"))
    if every is not None:
        at = F.col("h") % F.length("word")
        cut = F.concat(F.expr("left(word, cast(h % length(word) AS int))"), F.substring("word", at.cast("int") + F.lit(2), F.length("word")))
        words = words.withColumn("h", F.crc32(F.encode(F.concat_ws(":", "id", "word"), "UTF-8"))).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))
        words = words.where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def mask(word: Column) -> Column:
    """A bit a letter (by code point modulo BITS): set if the letter occurs an odd number of times."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, x: F.when(x == "", m).otherwise(m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x) % BITS))))


def _keys(words: DataFrame, below: bool) -> DataFrame:
    """A row for each band and place of the edit: key, word, n, mask, c (length of the shorter word), band and place.

    below: also as the longer word of a pair of unequal lengths.
    """
    lengths = F.array(F.length("word"), F.length("word") - 1) if below else F.array(F.length("word"))
    rows = words.select("word", "n", "mask", F.explode(lengths).alias("c"))
    a, b = (cut.format("c") for cut in _CUTS)
    parts = F.array(F.expr(f"left(word, {b})"), F.expr(f"concat(left(word, {a}), ' ', right(word, c - {b}))"), F.expr(f"right(word, c - {a})"))
    rows = rows.select("*", F.posexplode(parts).alias("place", "part")).select("*", F.posexplode(F.array(*[F.col("mask").bitwiseAND(m) for m in _BAND])).alias("band", "bits"))
    return rows.select(F.xxhash64("c", "place", "part", "band", "bits").alias("key"), "word", "n", "mask", "c", "place", "band")


def _first_meeting() -> Column:
    """Whether this key is the first under which the words meet: no earlier band is equal, no earlier place fits."""
    flips = F.col("x.mask").bitwiseXOR(F.col("y.mask"))
    earlier = [F.lit(True), flips.bitwiseAND(_BAND[0]) != 0, (flips.bitwiseAND(_BAND[0]) != 0) & (flips.bitwiseAND(_BAND[1]) != 0)]
    band = F.when(F.col("x.band") == 0, earlier[0]).when(F.col("x.band") == 1, earlier[1]).otherwise(earlier[2])
    a, b = (cut.format("x.c") for cut in _CUTS)
    place = F.when(F.col("x.place") == 0, F.lit(True)).when(F.col("x.place") == 1, F.expr(f"left(x.word, {b}) <> left(y.word, {b})")).otherwise(F.expr(f"left(x.word, {a}) <> left(y.word, {a})"))
    return band & place


def near_pairs(words: DataFrame) -> DataFrame:
    """Every pair of distinct words (word, n) one edit apart, once: a, an, b, bn; a isn't longer than b."""
    masked = words.select("word", "n", mask(F.col("word")).alias("mask"))
    x, y = _keys(masked, False).alias("x"), _keys(masked, True).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") == F.col("y.c")) & (F.col("x.place") == F.col("y.place")) & (F.col("x.band") == F.col("y.band"))
    once = (F.length("y.word") > F.col("x.c")) | (F.col("x.word") < F.col("y.word"))
    near = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    return x.join(y, same & once & _first_meeting() & near).select(F.col("x.word").alias("a"), F.col("x.n").alias("an"), F.col("y.word").alias("b"), F.col("y.n").alias("bn"))


def _roots(forms: DataFrame, step: Steps) -> DataFrame:
    """word, root of every word that has a form: pointer jumps until nothing changes (each form is ratio times as frequent)."""
    now = step(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jumps = now.select(F.col("word").alias("root"), F.col("root").alias("top"))
        nxt = step(now.join(jumps, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        now = nxt.select("word", "root")
        if not nxt.where("moved").limit(1).count():
            return now


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word (word, n; a row a word)."""
    with Steps(words.sparkSession) as step:
        words = step(words.select("word", "n"), "words")
        pairs = step(near_pairs(words), "pairs")
        both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("m")))
        best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
        found = words.join(best, "word", "left").withColumn("is", -F.col("best.m") >= ratio * F.col("n"))
        found = step(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is"), F.col("best.near")).alias("form"), F.when(F.col("is"), -F.col("best.m")).alias("form_n")), "found")
        roots = _roots(found.where("form IS NOT NULL"), step)
        return materialize(found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")), "variants")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), every=31)).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
kind AS (SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM kind),
sums AS (SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, poly),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM sums),
w AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
gap AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
less AS (SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS rest FROM gap),
hole AS (SELECT word, left(word, i - 1) || '.' || substr(word, i + 1) AS rest FROM gap),
pair AS (SELECT a.word AS x, b.word AS y FROM hole a JOIN hole b ON a.rest = b.rest AND a.word <> b.word UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM w) UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM w)),
best AS (SELECT x, count(*) AS n_near, min({'m': -n, 'w': y}) AS b FROM pair JOIN w ON w.word = y GROUP BY x),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * n THEN b.w END AS form, CASE WHEN -b.m >= 10 * n THEN -b.m END AS form_n FROM w LEFT JOIN best ON x = word),
r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN r USING (word) WHERE root NOT IN (SELECT word FROM f WHERE form IS NOT NULL)
"""
