"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditional expressions.

Statistics of a text are DataFrame expressions only (one narrow stage, no shuffle).  Learning takes the statistics of a
bounded sample of labelled ids (TRAIN_ROWS, chosen by a hash order; of texts that share an id, the least statistics) to the driver; applying the list is one
``when(...).when(...).otherwise(...)`` over columns, so it runs in the scan stage at any scale.

Sequential covering: each rule is a conjunction of thresholds that predicts "reject".  It grows on two thirds of the rows
by FOIL gain, is pruned on the last third by (p - n) / (p + n), and is taken while its precision there stays above
MIN_PRECISION; the rows it covers leave and the next rule is grown.  The list's default is "keep", so a clean document
goes only where a rule with evidence fires.

Edge cases: null and blank texts have no words and fail the base; without labelled rows of both classes the list is
empty and the base alone decides; a row with a null id is scored as any other; extra columns pass through in
``keep_good``.  Windows of three words are compared by a 64-bit hash inside one text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, strip_space, table, uniform_order, word_array

#: At most so many labelled rows are learned from (a documented bound; the sample is uniform by a hash of the id).
TRAIN_ROWS = 20_000
#: Precision that a rule must reach on the pruning rows and on all rows, and the rows it must cover there.
MIN_PRECISION, MIN_COVER = 0.9, 4
FEW = 24
MAX_CONDITIONS, MAX_RULES, CUTS = 3, 12, 48

MIN_WORDS, MAX_REPEAT = 50, 50
NO_SYMBOLS = r"[^#*$%&|<>]"
#: What rules may test; all are ratios or small numbers, so that thresholds carry over to other lengths.
FEATURES = ("symbol_ratio", "mean_word", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "words_a_line")


def _count(text: Column, pattern: str) -> Column:
    """Characters of a class, given the class of all others: long runs of those go, so few matches are made."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of three that occur at least twice.

    Most texts have no or few distinct windows of that kind: then one pass marks their places.  Where there are more than
    FEW, (window, place) pairs are sorted and neighbours compared, so long repetitive texts stay at n log n.
    """

    def union(p: Column) -> Column:
        # each window adds three words, less what the one before it has covered
        return F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))), F.lit(0), lambda a, x: a + x)

    def marked(grams: Column, twice: Column) -> Column:
        return F.array_remove(F.transform(grams, lambda g, i: F.when(F.array_contains(twice, g), i).otherwise(F.lit(-1))), -1)

    def ranked(r: Column) -> Column:
        n = F.size(r)
        same = F.filter(r, lambda x, k: ((k > 0) & (F.get(r, k - 1)["g"] == x["g"])) | ((k < n - 1) & (F.get(r, k + 1)["g"] == x["g"])))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = bind(F.sort_array(grams), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1) == x))))
        return bind(twice, lambda t: bind(F.when(F.size(t) <= FEW, marked(grams, t)).otherwise(bind(pairs, ranked)), union))

    n = F.size(words)
    grams = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    found = bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(n < 4, F.lit(0)).otherwise(found).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one struct column ``stats``: the contract's counts and FEATURES."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(strip_space(x)) > 0)
    from_words = bind(word_array(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    from_lines = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    # one pass leaves the characters that are counted, and each class is counted in what is left
    few = bind(F.regexp_replace(t, r"[^\p{Lu}0-9!?#*$%&|<>]+", ""), lambda x: F.struct(_count(x, NO_SYMBOLS + "+").alias("n_symbols"), _count(x, r"[^\p{Lu}]+").alias("n_upper"), _count(x, "[^0-9]+").alias("n_digits"), _count(x, "[^!?]+").alias("n_marks")))
    raw = docs.withColumn("stats", F.struct(from_words.alias("w"), from_lines.alias("l"), few.alias("c")))

    def expand(s: Column) -> Column:
        part = lambda a, b: a / F.greatest(b, F.lit(1)).cast("double")
        n, c, k = s["w"]["n_words"], s["w"]["word_chars"], s["c"]
        return F.struct(
            n.alias("n_words"), c.alias("word_chars"), k["n_symbols"].alias("n_symbols"), s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"),
            part(k["n_symbols"], c).alias("symbol_ratio"), part(c, n).alias("mean_word"), part(s["l"]["n_dup_lines"], s["l"]["n_lines"]).alias("dup_line_ratio"),
            part(s["w"]["n_repeat_words"], n).alias("repeat_ratio"), part(k["n_upper"], c).alias("upper_ratio"), part(k["n_digits"], c).alias("digit_ratio"),
            part(k["n_marks"], c).alias("mark_ratio"), part(n, s["l"]["n_lines"]).alias("words_a_line"),
        )

    # a generator of one row: filters on stats can't move below it and compute the statistics again for each mention
    return raw.withColumn("stats", F.explode(F.array(bind(F.col("stats"), expand))))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def column(self, s: Column) -> Column:
        return s[self.feature] >= F.lit(self.value) if self.at_least else s[self.feature] <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; precision and cover are those of the pruning rows."""

    conditions: tuple[Condition, ...]
    precision: float
    cover: int

    def column(self, s: Column) -> Column:
        out = self.conditions[0].column(s)
        for c in self.conditions[1:]:
            out = out & c.column(s)
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions)) + f" -> reject ({self.precision:.3f} of {self.cover})"


def _holds(c: Condition, x: np.ndarray) -> np.ndarray:
    v = x[:, FEATURES.index(c.feature)]
    return v >= c.value if c.at_least else v <= c.value


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    inside, chosen = np.ones(len(x), bool), []
    while len(chosen) < MAX_CONDITIONS:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not n0 or not p0:
            break
        before, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
        for f in FEATURES:
            v = x[:, FEATURES.index(f)]
            for cut in np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, CUTS))):
                for up in (True, False):
                    c = Condition(f, up, float(cut))
                    now = inside & _holds(c, x)
                    p, n = int((now & bad).sum()), int((now & ~bad).sum())
                    if p and (g := p * (np.log2(p / (p + n)) - before)) > gain:
                        best, gain = c, g
        if best is None:
            break
        chosen.append(best)
        inside &= _holds(best, x)
    return chosen


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    def worth(r: list[Condition]) -> tuple[float, int]:
        m = np.logical_and.reduce([_holds(c, x) for c in r])
        p, n = int((m & bad).sum()), int((m & ~bad).sum())
        return ((p - n) / (p + n) if p + n else -1.0, p)

    while len(rule) > 1:
        shorter = max(([c for c in rule if c is not out] for out in rule), key=worth)
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    return rule


def learn(x: np.ndarray, bad: np.ndarray, split: np.ndarray) -> list[Rule]:
    """Ordered rules from rows x of FEATURES; split is true on the pruning rows."""
    left, rules = np.ones(len(x), bool), []
    while len(rules) < MAX_RULES and (left & bad & ~split).sum() >= MIN_COVER:
        grown = _grow(x[left & ~split], bad[left & ~split])
        if not grown:
            break
        rule = _prune(grown, x[left & split], bad[left & split])
        m = left & np.logical_and.reduce([_holds(c, x) for c in rule])
        precise = lambda k: (k & bad).sum() / max(1, k.sum())
        if (m & split).sum() < MIN_COVER or min(precise(m & split), precise(m)) < MIN_PRECISION:
            break
        rules.append(Rule(tuple(rule), float(precise(m & split)), int((m & split).sum())))
        left &= ~m
    return rules


def learn_from(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from the labelled rows of docs that pass the base (quality 0: reject)."""
    ids = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
           .orderBy(uniform_order(F.col("doc_id"), "quality"), "doc_id").limit(TRAIN_ROWS))
    labelled = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most TRAIN_ROWS rows of two numbers
    seen = statistics(labelled).where(~base_failed(F.col("stats"))).groupBy("doc_id", "quality").agg(F.min(F.struct(*[F.col(f"stats.{f}").alias(f) for f in FEATURES])).alias("s"))
    rows = seen.select("doc_id", "quality", "s.*").orderBy("doc_id").collect()  # a row an id: at most TRAIN_ROWS
    if len({r["quality"] for r in rows}) < 2:
        return []
    x = np.array([[float(r[f]) for f in FEATURES] for r in rows])
    split = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 for r in rows])
    return learn(x, np.array([r["quality"] == 0 for r in rows]), split)


def verdict(rules: list[Rule], s: Column) -> Column:
    """The first rule that fires (its number from 0), or -1: the decision list as one conditional expression."""
    if not rules:
        return F.lit(-1)
    out = F.when(rules[0].column(s), F.lit(0))
    for k, r in enumerate(rules[1:], 1):
        out = out.when(r.column(s), F.lit(k))
    return out.otherwise(F.lit(-1))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with ``stats``, ``base_failed``, ``rule`` and ``kept``."""
    s = F.col("stats")
    return statistics(docs).withColumn("base_failed", base_failed(s)).withColumn("rule", verdict(rules, s)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == -1))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = judge(docs, learn_from(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", *[F.col(f"stats.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base and the list keep, all columns as they were."""
    plain = docs.select("doc_id", "text")
    rules = learn_from(plain, labels)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text"))
    return judge(packed, rules).where("kept").select("row.*")
