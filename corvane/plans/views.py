"""The engine's relations as views of the bundled test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.labels import first_labels
from corvane.operators.review import is_relevant, relevance
from corvane.schemas import RELEVANCE


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Unlabelled documents as a feed: id, source, lang, title, abstract; all that follows the title is the abstract (a feed's 2000 characters are a limit of its parser)."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return docs.select(F.col("doc_id").alias("id"), "source", "lang", F.substring("text", 1, 80).alias("title"), F.expr("substring(text, 81)").alias("abstract"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents of good quality as notes: id, text, source, lang, rating, age_days, staged, tags, inlinks, toxic."""
    got = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id")
    return got.select(F.col("doc_id").alias("id"), "text", "source", "lang", F.when(F.col("toxic") == 1, "marginal").otherwise("useful").alias("rating"), (F.col("doc_id") % 400).alias("age_days"),
                      (F.col("doc_id") % 7 == 0).alias("staged"), F.array("lang", "source").alias("tags"), F.lit(0).alias("inlinks"), "toxic")


def journal(spark: SparkSession, d: str) -> DataFrame:
    """Events as candidates of daily runs."""
    e = table(spark, d, "events")
    paper = F.col("user_id") * 10 + F.dayofmonth("ts") % 10
    w = Window.partitionBy("run", "event_type").orderBy("pos")
    base = e.select(F.col("event_id").alias("pos"), F.to_date("ts").alias("run"), "ts", paper.alias("paper"), F.col("value").alias("lexical"), (paper % 5).cast("int").alias("lvl"),
                    (F.regexp_extract("props", "[0-9]+", 0).cast("int") / 100.0).alias("conf"), "event_type")
    top = F.get(F.array(*[F.lit(x) for x in RELEVANCE]), F.col("lvl"))
    out = base.withColumn("posted", (F.col("event_type") == "purchase") & (F.row_number().over(w) <= 5)).withColumn("top", top)
    return out.withColumn("rel", relevance(F.col("top"), F.col("conf"))).withColumn("relevant", is_relevant(F.col("top")))


def receipts(spark: SparkSession, d: str) -> DataFrame:
    rows = journal(spark, d).where("event_type IN ('view', 'click')")
    return rows.select("run", "paper", "pos", F.when(F.col("event_type") == "view", "score").otherwise("noul").alias("primitive"), F.least(F.lit(1.0), F.col("lexical") / 200).alias("p"))


def label_rows(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "keep").when(F.col("event_type") == "view", "read-later").when(F.col("event_type") == "error", "skip").otherwise("discussed")
    return journal(spark, d).where("lexical > 60").select("paper", kind.alias("label_type"), "pos")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return first_labels(label_rows(spark, d))


#: Words of a benchmark item that documents are looked up by: the first whole ones.
_KEY_WORDS = 4


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Links from benchmark items to documents that hold their text.

    An item's second to fifth word stand in such a document as neighbours: an equi-join with the documents' runs of four
    words finds candidates, containment decides.  Items too short for that are looked up by their middle word, and those
    without one (two words or fewer) are compared one by one.
    """
    words = lambda c: F.array_remove(F.split(c, r"[\x20\x09-\x0D]+"), "")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("src"), F.col("text").alias("bt"), words(F.col("text")).alias("w"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    long, n = F.size("w") >= _KEY_WORDS + 2, F.size("w")
    keyed = b.select("src", "bt", F.when(long, F.array_join(F.slice("w", 2, _KEY_WORDS), " ")).when(n > 2, F.get("w", 1)).alias("key"), F.when(long, _KEY_WORDS).otherwise(1).alias("wide"))
    grams = lambda w, k: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
    found = []
    for k in (_KEY_WORDS, 1):
        own = keyed.where((F.col("wide") == k) & F.col("key").isNotNull()).select("src", "key")
        shown = docs.withColumn("w", words(F.col("text"))).where(F.size("w") >= k).select("doc_id", F.explode(F.array_distinct(grams(F.col("w"), k))).alias("key"))
        found.append(shown.join(own, "key").select("doc_id", "src").distinct())
    pairs = found[0].unionByName(found[1]).join(b.select("src", "bt"), "src").join(docs, "doc_id").where(F.contains("text", F.col("bt")))
    tiny = docs.join(keyed.where("key IS NULL"), F.contains(docs["text"], F.col("bt")))
    return pairs.select("src", F.col("doc_id").cast("string").alias("target")).unionByName(tiny.select("src", F.col("doc_id").cast("string").alias("target")))


#: The same views in DuckDB's SQL.
SQL = {
    "items": "SELECT doc_id AS id, source, lang, substr(text, 1, 80) AS title, substr(text, 81) AS abstract FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "notes": "SELECT d.doc_id AS id, d.text, d.source, d.lang, CASE WHEN l.toxic = 1 THEN 'marginal' ELSE 'useful' END AS rating, d.doc_id % 400 AS age_days, d.doc_id % 7 = 0 AS staged, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1",
    "journal": """SELECT *, CASE lvl WHEN 0 THEN 'must-read' WHEN 1 THEN 'worth-reading' WHEN 2 THEN 'borderline' WHEN 3 THEN 'unlikely' ELSE 'irrelevant' END AS top,
        (5 - lvl)::DOUBLE + CASE WHEN lvl < 2 THEN conf ELSE 1 - conf END AS rel, lvl < 2 AS relevant,
        event_type = 'purchase' AND row_number() OVER (PARTITION BY run, event_type ORDER BY pos) <= 5 AS posted
        FROM (SELECT event_id AS pos, CAST(ts AS DATE) AS run, ts, user_id * 10 + day(ts) % 10 AS paper, value AS lexical, ((user_id * 10 + day(ts) % 10) % 5)::INT AS lvl,
              CAST(regexp_extract(props, '[0-9]+') AS INT)::DOUBLE / 100.0::DOUBLE AS conf, event_type FROM events)""",
    "receipts": "SELECT run, paper, pos, CASE WHEN event_type = 'view' THEN 'score' ELSE 'noul' END AS primitive, least(1.0::DOUBLE, lexical / 200) AS p FROM journal WHERE event_type IN ('view', 'click')",
    "label_rows": "SELECT paper, CASE event_type WHEN 'signup' THEN 'keep' WHEN 'view' THEN 'read-later' WHEN 'error' THEN 'skip' ELSE 'discussed' END AS label_type, pos FROM journal WHERE lexical > 60",
    "ledger": "SELECT paper, label_type, min(pos) AS pos FROM label_rows GROUP BY 1, 2",
    "outcomes": "SELECT paper, CASE WHEN bool_or(label_type IN ('keep', 'read-later')) THEN 1 WHEN bool_or(label_type = 'skip') THEN 0 END AS outcome FROM ledger GROUP BY 1",
    "latest": "SELECT run, paper, primitive, p, pos FROM (SELECT *, row_number() OVER (PARTITION BY run, paper ORDER BY pos DESC) AS rn FROM receipts) WHERE rn = 1",
    "graded": "SELECT l.*, o.outcome FROM latest l JOIN outcomes o USING (paper) WHERE o.outcome IS NOT NULL",
    "tok": r"""SELECT id, factor, unnest(list_filter(list_transform(regexp_split_to_array(replace(lower(text), '|', ' '), '\s+'), lambda t: trim(t, '.,;:!?()[]{}"''')), lambda t: length(t) >= 3 AND regexp_full_match(t, '[\p{L}\p{N}]+'))) AS term
        FROM (SELECT *, pow(0.5, age_days / 180.0::DOUBLE) * CASE WHEN rating = 'marginal' THEN 0.5 ELSE 1.0 END::DOUBLE AS factor FROM notes)""",
    "prof": """SELECT term, df, CASE WHEN df >= 0.8 * n AND n >= 3 THEN 0 ELSE m * greatest(1.0::DOUBLE, ln(n / df) + 1) END AS weight
        FROM (SELECT term, count(*) AS df, sum(c * factor) AS m FROM (SELECT id, term, any_value(factor) AS factor, count(*) AS c FROM tok GROUP BY 1, 2) GROUP BY 1), (SELECT count(*)::DOUBLE AS n FROM notes)""",
    "terms": "SELECT term, round(weight, 6) AS weight FROM prof WHERE weight > 0 ORDER BY round(weight, 6) DESC, term LIMIT 200",
    "hits": r"""SELECT id, source, term, weight, len(regexp_extract_all(t, '(^|[^a-z0-9-])' || term || '([^a-z0-9-]|$)')) AS in_title, len(regexp_extract_all(a, '(^|[^a-z0-9-])' || term || '([^a-z0-9-]|$)')) AS in_abstract
        FROM (SELECT id, source, lower(title) AS t, lower(abstract) AS a FROM items) i, terms""",
    "sc": """SELECT i.id, i.source, coalesce(round_even(s * 100, 0) / 100, 0.0::DOUBLE) AS score, coalesce(n, 0) AS n_terms, terms FROM items i LEFT JOIN
        (SELECT id, source, sum(weight * (1 + least(1.0::DOUBLE, length(term) / 16)) * (3 * in_title + in_abstract)) AS s, count(*) AS n, string_agg(term, ',' ORDER BY weight DESC, term) AS terms FROM hits WHERE in_title + in_abstract > 0 GROUP BY 1, 2) h ON h.id = i.id AND h.source = i.source""",
    "pooled": """SELECT s.*, CASE WHEN r <= 40 AND score > 0 THEN 'survivor' WHEN score > 0 AND n_terms = 1 THEN 'near-miss' WHEN score > 0 THEN 'none' WHEN z <= 20 THEN 'probe' ELSE 'none' END AS pool,
        ('0x' || substr(md5('mass:' || id), 1, 7))::BIGINT / 268435456.0::DOUBLE AS mass
        FROM (SELECT *, row_number() OVER (ORDER BY score DESC, source, id) AS r, row_number() OVER (PARTITION BY score <= 0 ORDER BY sha256('seed:' || id), source, id) AS z FROM sc) s""",
}
_NEEDS = {"receipts": ["journal"], "label_rows": ["journal"], "ledger": ["label_rows"], "outcomes": ["ledger"], "latest": ["receipts"], "graded": ["latest", "outcomes"],
          "tok": ["notes"], "prof": ["tok", "notes"], "terms": ["prof"], "hits": ["items", "terms"], "sc": ["items", "hits"], "pooled": ["sc"]}


def with_views(names: str, select: str) -> str:
    """select with the named views (and those that they need) as common table expressions."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in _NEEDS.get(n, []):
            need(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order) + " " if order else "") + select
