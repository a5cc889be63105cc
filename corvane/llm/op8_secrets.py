"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean trigram query (an OR of ANDs, letters folded to lower case) on
the driver.  The index holds postings (trigram, document) for the trigrams that the rules ask for.  A conjunction's
postings are intersected by counting its trigrams per document; documents of any conjunction are candidates of the rule
and are verified with the regular expression itself.  A rule without mandatory trigrams scans all texts.

Postings hold ids and trigrams only.  For verification a text is shuffled to its candidate rules only if it holds all
trigrams of some conjunction, which is tested in place; all other texts (nearly all) are scanned where they are.

Matches keep their places by native means: splitting at the expression gives the gaps, extracting gives the matches, and
prefix sums of their lengths (blocked, so many matches in one text stay cheap) give start and end in code points.

Edge cases: null text is empty; a text without matches has an empty list and the digest of an empty string; rows that
repeat a doc_id share candidates but each is verified on its own text; rows without a doc_id are told apart by a hash of
their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table


@dataclass(frozen=True)
class Rule:
    """pattern: Java regular expression; group: the part whose length counts, of least code points at least; base: one of the contract's."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = False


#: The contract's kinds in order, then those that this scan adds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
)
#: Strings that a part of a pattern may stand for before the query stops following it; alternatives of a character class.
MOST_STRINGS, MOST_CLASS = 64, 6

Query = frozenset[frozenset[str]]  # OR of ANDs; an empty AND holds for every text
_ANY: Query = frozenset([frozenset()])


def _simplest(q: set[frozenset[str]]) -> Query:
    return frozenset(a for a in q if not any(b < a for b in q))


def _and(a: Query, b: Query) -> Query:
    return _simplest({x | y for x in a for y in b})


def _query_of(strings: set[str]) -> Query:
    return _simplest({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}) if strings else _ANY


def _strings(node: tuple) -> set[str] | None:
    """All lower-cased strings that a node stands for, or None where they are too many."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < MOST_CLASS:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= MOST_CLASS else None
    if name == "SUBPATTERN":
        return _all_strings(arg[3])
    if name == "BRANCH":
        parts = [_all_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if name == "MAX_REPEAT" and arg[1] <= 2:
        one = _all_strings(arg[2])
        if one is None:
            return None
        out, now = set(), {""}
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                out |= now
            now = {a + b for a in now for b in one}
        return out if len(out) <= MOST_STRINGS else None
    return None


def _all_strings(sequence) -> set[str] | None:
    now = {""}
    for node in sequence:
        one = _strings(node)
        if one is None or len(now) * len(one) > MOST_STRINGS:
            return None
        now = {a + b for a in now for b in one}
    return now


def _sequence_query(sequence) -> Query:
    query, now = _ANY, {""}
    for node in sequence:
        one = _strings(node)
        if one is not None and len(now) * len(one) <= MOST_STRINGS:
            now = {a + b for a in now for b in one}
            continue
        query, now = _and(query, _query_of(now)), {""}
        if one is not None:
            now = set(one)
        elif str(node[0]) == "SUBPATTERN":
            query = _and(query, _sequence_query(node[1][3]))
        elif str(node[0]) == "BRANCH":
            query = _and(query, _simplest({c for x in node[1][1] for c in _sequence_query(x)}))
        elif str(node[0]) == "MAX_REPEAT" and node[1][0] >= 1:
            query = _and(query, _sequence_query(node[1][2]))
    return _and(query, _query_of(now))


def trigram_query(pattern: str) -> Query:
    """The Boolean query of a pattern; a text that matches satisfies it in lower case."""
    return _sequence_query(parser.parse(pattern))


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string")))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """key, trigram: the inverted index of docs (doc_id, text), for these trigrams."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    found = docs.select(_key().alias("key"), low.alias("low"))
    # an array of expressions: for other arrays Spark adds a filter on their size, which would look for every trigram once more
    return found.select("key", F.explode(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])).alias("trigram")).where("trigram IS NOT NULL")


def candidates(docs: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key, rules: the rules that a document must be verified for (those with mandatory trigrams)."""
    spark = docs.sparkSession
    terms = [(rule, k, t, len(clause)) for rule, q in queries.items() for k, clause in enumerate(sorted(q, key=sorted)) for t in sorted(clause)]
    asked = spark.createDataFrame(terms, "rule string, clause int, trigram string, need int")
    index = postings(docs, sorted({t[2] for t in terms})).distinct()
    met = index.join(F.broadcast(asked), "trigram").groupBy("key", "rule", "clause", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")  # asked: a few rows a rule
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def possible(queries: dict[str, Query]) -> Column:
    """Whether text (in place) holds all trigrams of a conjunction; a conjunction that contains another adds nothing."""
    clauses = sorted(_simplest({c for q in queries.values() for c in q}), key=sorted)

    def held(low: Column) -> Column:
        return functools.reduce(lambda a, b: a | b, [functools.reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in sorted(c)]) for c in clauses])

    return bind(F.lower(F.coalesce(F.col("text"), F.lit(""))), held)  # lower case once a text


_BLOCK = 64


def sums_before(lengths: Column) -> Column:
    """For each element, the sum of those before it: block sums first, then inside a block."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def body(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: add(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        return bind(starts, lambda s: F.transform(x, lambda _, i: F.get(s, F.floor(i / _BLOCK).cast("int")) + add(F.slice(x, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(bind(lengths, body))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's matches in text whose counted part is long enough."""
    p = F.lit(rule.pattern)
    hits, parts, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(rule.group)), F.split(text, rule.pattern, -1)
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")

    def place(h: Column) -> Column:
        long = lambda x: F.transform(x, lambda y: F.length(y))
        found = bind(F.struct(long(h).alias("h"), long(gaps).alias("g"), long(parts).alias("p")), lambda s: bind(sums_before(s["h"]), lambda hb: bind(sums_before(s["g"]), lambda gb: F.transform(
            s["h"], lambda n, i: F.struct((F.get(hb, i) + F.get(gb, i + 1)).alias("start"), F.lit(number).alias("number"), (F.get(hb, i) + F.get(gb, i + 1) + n).alias("end"), F.get(s["p"], i).alias("part"))))))
        kept = F.filter(found, lambda x: x["part"] >= rule.least)
        return F.when(F.size(h) == 0, none).otherwise(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["number"].alias("number"), x["end"].alias("end"))))

    return bind(hits, place)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and ``found``: the sorted array of (start, number of the rule, end) of every row."""
    queries = {r.name: trigram_query(r.pattern) for r in rules}
    indexed = {n: q for n, q in queries.items() if q != _ANY}
    held = docs.select(_key().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), possible(indexed).alias("possible"))
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")

    def verified(rows: DataFrame, names: Column | None) -> DataFrame:
        each = [spans(F.col("text"), r, k) if r.name not in indexed else F.when(F.array_contains(names, r.name), spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules) if names is not None or r.name not in indexed]
        # a generator of one row: what stands above mentions the matches often, but they are found once
        return rows.select("doc_id", "text", F.explode(F.array(F.sort_array(F.flatten(F.array(none, *each))))).alias("found"))

    if not indexed:
        return verified(held, None)
    joined = held.where("possible").join(candidates(docs, indexed), "key", "left")
    return verified(held.where("NOT possible"), None).unionByName(verified(joined, F.coalesce("rules", F.array().cast("array<string>"))))


def _joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    name = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(name, x["number"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    got, f = scan(docs, rules), F.col("found")
    base = [k for k, r in enumerate(rules) if r.base]

    def count(k: int) -> Column:
        return F.size(F.filter(f, lambda x: x["number"] == k)).cast("long").alias(f"n_{rules[k].name}")

    counts = [count(k) for k in base]
    digest = F.sha2(_joined(F.filter(f, lambda x: x["number"].isin(base)), rules), 256)
    return got.select("doc_id", *counts, digest.alias("base_sha256"), _joined(f, rules).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
