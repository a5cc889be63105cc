"""One registered query for each operator, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane import storage
from corvane.functions import numbers, parsers, text
from corvane.operators import calibrate, daily, labels, pack, profile, rank, resolve, review, scorer
from corvane.sources import connectors, files, sinks

from . import views
from .views import table, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str = "") -> Callable[[Query], Query]:
    """Registers a query; sql is what DuckDB runs over the named views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(needs, sql)
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _terms(s: SparkSession, d: str) -> DataFrame:
    n = views.notes(s, d).withColumn("tags", F.array().cast("array<string>"))
    top = profile.top_terms(profile.profile(n, F.col("text"), stop=()), 200)
    return top.select("term", F.round("weight", 6).alias("weight"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return rank.scored(views.items(s, d), _terms(s, d))


def _pooled(s: SparkSession, d: str) -> DataFrame:
    rows = _scored(s, d).select("source", "id", "title", "score", "terms")  # pools are saved; what follows reads no abstract
    return rank.pools(rows, "seed").withColumn("mass", scorer.mass_of(F.col("id")))


def _graded(s: SparkSession, d: str) -> DataFrame:
    return calibrate.graded(calibrate.latest(views.receipts(s, d)), labels.by_paper(views.ledger(s, d)))


# --- flagship, profile ------------------------------------------------------------------------------------------------


@query("rank_01_digest", "SELECT id, score, n_terms FROM sc WHERE score > 0 ORDER BY score DESC, source, id LIMIT 20", "sc")
def _(s, d):
    return rank.survivors(_scored(s, d), 20).select("id", "score", F.size("terms").cast("long").alias("n_terms"))


@query("agg_01_document_frequency", "SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY 1", "tok")
def _(s, d):
    return profile.document_frequency(profile.token_counts(views.notes(s, d), F.col("text"), ()))


@query("agg_02_profile", "SELECT term, df, round(weight, 4) AS weight FROM prof", "prof")
def _(s, d):
    n = views.notes(s, d).withColumn("tags", F.array().cast("array<string>"))
    return profile.profile(n, F.col("text"), stop=()).select("term", "df", F.round("weight", 4).alias("weight"))


@query("agg_03_saturation_cap", "SELECT term, df FROM prof WHERE weight = 0 UNION ALL SELECT 'zzeverywhere', count(*) FROM notes", "prof")
def _(s, d):
    """A word that every note has weighs nothing."""
    n = views.notes(s, d).withColumn("tags", F.array().cast("array<string>"))
    return profile.profile(n, F.concat("text", F.lit(" zzeverywhere")), stop=()).where("weight = 0").select("term", "df")


def _full_profile(tokens: str, notes: str, name: str) -> str:
    """SQL of a profile with stop words, tags and one directive, over tokens (id, factor, term) and notes (factor, lang, source)."""
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    return f"""{name}_n AS (SELECT count(*)::DOUBLE AS n FROM ({notes})),
{name}_b AS (SELECT term, df, CASE WHEN df >= 0.8 * n AND n >= 3 THEN 0 ELSE m * greatest(1.0::DOUBLE, ln(n / df) + 1) END AS w FROM (SELECT term, count(*) AS df, sum(c * factor) AS m FROM (SELECT id, term, any_value(factor) AS factor, count(*) AS c FROM ({tokens}) WHERE term NOT IN ({stop}) GROUP BY 1, 2) GROUP BY 1), {name}_n),
{name} AS (SELECT term, sum(df)::BIGINT AS df, sum(w) AS weight FROM (SELECT * FROM {name}_b UNION ALL SELECT lower(unnest([lang, source])), 0, 3.0::DOUBLE * factor FROM ({notes}) UNION ALL SELECT 'directed', 0, 5.0::DOUBLE) GROUP BY 1)"""


_FACTOR = "pow(0.5, age_days / 180.0::DOUBLE) * CASE WHEN rating = 'marginal' THEN 0.5 ELSE 1.0 END::DOUBLE AS factor"


@query("agg_02_full_profile", with_views("tok", "").rstrip() + ", " + _full_profile("SELECT * FROM tok", f"SELECT *, {_FACTOR} FROM notes", "full_prof") + " SELECT term, df, round(weight, 4) AS weight FROM full_prof")
def _(s, d):
    """With stop words, tags and a directive."""
    directed = s.createDataFrame([("Directed",)], "term string")
    return profile.profile(views.notes(s, d), F.col("text"), directed).select("term", "df", F.round("weight", 4).alias("weight"))


@query("agg_06_inlinks", "SELECT d.doc_id AS id, count(DISTINCT b.item_id) AS inlinks FROM documents d LEFT JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1")
def _(s, d):
    n = _docs(s, d).select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("basename"))
    return profile.inlinks(views.edges(s, d), n).select("id", "inlinks")


@query("join_08_link_counts", "SELECT b.item_id AS src, count(*) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1")
def _(s, d):
    return views.edges(s, d).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("agg_20_fold_summary", "SELECT count(*) AS scanned, count(*) AS with_identity, count(*) FILTER (staged) AS staged, count(*) FILTER (toxic = 1) AS seeded, count(*) FILTER (lang = 'en') AS with_why FROM notes", "notes")
def _(s, d):
    n = views.notes(s, d).select(F.col("id").alias("identity"), F.when(F.col("staged"), "staged").otherwise("").alias("status"), F.when(F.col("toxic") == 1, "x").alias("seed"), F.when(F.col("lang") == "en", "y").alias("why"))
    return profile.fold_summary(n)


@query("agg_22_normalised_priority", "SELECT term, round(weight / max(weight) OVER (), 6) AS priority FROM terms", "terms")
def _(s, d):
    t = _terms(s, d)
    return t.join(F.broadcast(t.agg(F.max("weight").alias("top")))).select("term", F.round(numbers.share_of_max(F.col("weight"), F.col("top")), 6).alias("priority"))


@query("agg_23_staged_audit", with_views("tok", "").rstrip() + ", " + _full_profile("SELECT * FROM tok", f"SELECT *, {_FACTOR} FROM notes", "pa") + ", "
       + _full_profile("SELECT * FROM tok WHERE id % 7 <> 0 OR id % 2 = 0", f"SELECT *, {_FACTOR} FROM notes WHERE id % 7 <> 0 OR id % 2 = 0", "pb")
       + " SELECT term, round(coalesce(pa.weight, 0), 4) AS all_w, round(coalesce(pb.weight, 0), 4) AS gated_w FROM pa FULL JOIN pb USING (term) WHERE abs(coalesce(pa.weight, 0) - coalesce(pb.weight, 0)) > 1e-9")
def _(s, d):
    """Two profiles: all notes, and those that contribute (staged ones with odd ids are untouched)."""
    raw = views.notes(s, d).withColumn("contributes", ~(F.col("staged") & (F.col("id") % 2 != 0)))
    got = profile.staged_audit(raw, F.col("text"), directives=s.createDataFrame([("directed",)], "term string"))
    return got.select("term", F.round("all_w", 4).alias("all_w"), F.round("gated_w", 4).alias("gated_w"))


@query("prj_01_identity", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'arxiv:' || lpad(CAST(doc_id AS VARCHAR), 9, '0') WHEN doc_id % 3 = 1 THEN 'doi:10.1/' || doc_id END AS identity FROM documents")
def _(s, d):
    k = F.col("doc_id")
    return _docs(s, d).select("doc_id", profile.identity(F.when(k % 3 == 0, F.lpad(k.cast("string"), 9, "0")), F.when(k % 3 == 1, F.concat(F.lit("10.1/"), k.cast("string")))).alias("identity"))


@query("prj_02_note_build", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'core' WHEN doc_id % 4 = 1 THEN 'marginal' END AS rating, CASE WHEN doc_id % 4 = 2 THEN 'because ' || lang END AS why,
(doc_id % 4) < 3 AS touched, NOT (doc_id % 7 = 0 AND doc_id % 4 = 3) AS contributes, CASE WHEN doc_id % 5 = 0 THEN DATE '2026-01-02' WHEN doc_id % 5 = 1 THEN DATE '2026-02-03' ELSE DATE '2026-03-04' END::VARCHAR AS read FROM documents""")
def _(s, d):
    k = F.col("doc_id")
    raw = _docs(s, d).select("doc_id", F.when(k % 4 == 0, "core").alias("rating"), F.lit(None).cast("string").alias("why"), F.when(k % 4 == 1, "marginal").when(k % 4 == 2, F.concat(F.lit("because "), "lang")).alias("relevance"),
                             F.when(k % 5 == 0, "2026-01-02T10:00").otherwise("soon").alias("read_date"), F.when(k % 5 == 1, " 2026-02-03").alias("date"), F.to_timestamp(F.lit("2026-03-04 05:06:07")).alias("mtime"), F.when(k % 7 == 0, "staged").alias("status"))
    return profile.built_notes(raw).select("doc_id", "rating", "why", "touched", "contributes", F.col("read").cast("string").alias("read"))


@query("prj_16_profile_flag", "SELECT CASE WHEN count(*) FILTER (NOT staged) < 5 OR count(*) FILTER (NOT staged AND toxic = 1) = 0 THEN 'degraded' ELSE 'full' END AS flag FROM notes", "notes")
def _(s, d):
    return profile.flag(views.notes(s, d).select((~F.col("staged")).alias("contributes"), F.when(F.col("toxic") == 1, "w").alias("why")))


@query("prj_17_cards", "SELECT n.id, n.rating, b.text AS abstract FROM notes n LEFT JOIN benchmark b ON b.item_id = n.id", "notes")
def _(s, d):
    n = views.notes(s, d).select(F.col("id").cast("string").alias("arxiv"), F.lpad(F.col("id").cast("string"), 12, "0").alias("title"), F.col("rating").alias("why"), F.lit(1.0).alias("weight"), F.lit(None).cast("date").alias("read"))
    c = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("arxiv"), F.col("text").alias("abstract"), F.lit(None).cast("string").alias("conclusions"))
    return profile.cards(n, c).select(F.col("title").cast("long").alias("id"), F.col("why").alias("rating"), "abstract")


@query("prj_19_worklist", "SELECT id, id || ' | ' || lang || ' | ' || CASE WHEN toxic = 1 THEN 't' ELSE '-' END || ' | ' || CASE WHEN toxic = 1 THEN 'cli' ELSE '-' END AS line FROM notes WHERE staged", "notes")
def _(s, d):
    n = views.notes(s, d).where("staged").select(F.col("id").cast("string").alias("identity"), F.col("lang").alias("title"), "toxic")
    return profile.worklist(n.drop("toxic"), n.where("toxic = 1").select("identity", F.lit("t").alias("ts"), F.lit("cli").alias("src"))).select(F.col("identity").cast("long").alias("id"), "line")


@query("join_07_merged_content", "SELECT coalesce(a.doc_id, b.doc_id) AS arxiv, coalesce(a.lang, b.lang) AS abstract, coalesce(b.source, a.source) AS conclusions FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) b ON a.doc_id = b.doc_id")
def _(s, d):
    x = _docs(s, d).select(F.col("doc_id").alias("arxiv"), F.col("lang").alias("abstract"), F.col("source").alias("conclusions"))
    return profile.merged_content(x.where("arxiv % 2 = 0"), x.where("arxiv % 3 = 0"))


@query("snk_18_backfill", "SELECT doc_id AS arxiv, 'abstract' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'text' FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def _(s, d):
    cache = table(s, d, "labels").select(F.col("doc_id").alias("arxiv"), F.lit("a").alias("abstract"))
    return profile.backfill(_docs(s, d).select(F.col("doc_id").alias("arxiv")), cache, table(s, d, "benchmark").select(F.col("item_id").alias("arxiv")))


@query("win_11_recent", "SELECT id FROM notes ORDER BY CASE WHEN id % 5 > 0 THEN id % 400 END DESC NULLS LAST, id LIMIT 3", "notes")
def _(s, d):
    return profile.recent(views.notes(s, d).withColumn("read", F.when(F.col("id") % 5 > 0, F.col("id") % 400)).withColumn("ord", F.col("id"))).select("id")


# --- ranking ----------------------------------------------------------------------------------------------------------


@query("join_01_term_matches", "SELECT id, term, in_title, in_abstract FROM hits WHERE in_title + in_abstract > 0", "hits")
def _(s, d):
    return rank.matches(views.items(s, d), _terms(s, d)).select("id", "term", F.col("in_title").cast("long").alias("in_title"), F.col("in_abstract").cast("long").alias("in_abstract"))


@query("join_02_author_matches", "SELECT c_custkey AS id, s_name AS name FROM customer JOIN supplier ON split_part(s_name, '#', 2) = lpad(CAST(c_custkey % 97 AS VARCHAR), 9, '0')")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.concat(F.lit("Ánna Supplier "), F.lpad((F.col("c_custkey") % 97).cast("string"), 9, "0"))).alias("authors"))
    r = table(s, d, "supplier").select(F.concat(F.lit("A. "), F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(" — "), "s_name").alias("entry"), F.lit(1.0).alias("weight"))
    return rank.author_matches(c, r).select("id", F.col("group").alias("name"))


@query("join_03_unseen", "SELECT id, source FROM items WHERE id % 3 <> 0 AND id % 5 <> 0", "items")
def _(s, d):
    i = views.items(s, d)
    return rank.unseen(i, i.where("id % 3 = 0"), i.where("id % 5 = 0")).select("id", "source")


@query("join_04_posted_skip", "SELECT id, source FROM items WHERE id % 5 <> 0", "items")
def _(s, d):
    i = views.items(s, d)
    return rank.unseen(i, i.limit(0), i.where("id % 5 = 0")).select("id", "source")


@query("join_05_skipped", "SELECT id, source, CASE WHEN id % 3 = 0 THEN 'corpus' ELSE 'posted' END AS reason FROM items WHERE id % 3 = 0 OR id % 5 = 0", "items")
def _(s, d):
    i = views.items(s, d)
    return rank.skipped(i, i.where("id % 3 = 0"), i.where("id % 5 = 0")).select("id", "source", "reason")


@query("join_12_dead_feeds", "SELECT DISTINCT source AS feed FROM documents WHERE source NOT IN (SELECT source FROM items WHERE id % 11 = 0) UNION SELECT 'empty ' || source FROM documents", "items")
def _(s, d):
    """Every source is configured twice, under a name that never gives a row too."""
    asked = _docs(s, d).select(F.explode(F.array("source", F.concat(F.lit("empty "), "source"))).alias("feed")).distinct()
    return rank.dead_feeds(asked, views.items(s, d).where("id % 11 = 0").select(F.col("source").alias("feed")))


@query("set_01_union_feeds", "SELECT lang AS source, n AS id, min(doc_id) AS first FROM (SELECT lang, doc_id, n_chars % 50 AS n FROM documents) GROUP BY 1, 2")
def _(s, d):
    x = _docs(s, d).select(F.col("lang").alias("source"), (F.col("n_chars") % 50).alias("id"), F.lit(0).alias("feed_pos"), F.col("doc_id").alias("item_pos"))
    return rank.union_feeds([x.where("item_pos % 2 = 0"), x.where("item_pos % 2 = 1")]).select("source", "id", F.col("item_pos").alias("first"))


@query("agg_04_score", "SELECT id, score FROM sc", "sc")
def _(s, d):
    return _scored(s, d).select("id", "score")


@query("agg_05_terms", "SELECT id, terms FROM sc WHERE n_terms > 0", "sc")
def _(s, d):
    return _scored(s, d).where(F.size("terms") > 0).select("id", F.array_join("terms", ",").alias("terms"))


@query("srt_01_survivors", "SELECT id FROM sc WHERE score > 0 ORDER BY score DESC, source, id LIMIT 40", "sc")
def _(s, d):
    return rank.survivors(_scored(s, d)).select("id")


@query("srt_02_pools", "SELECT id, pool FROM pooled", "pooled")
def _(s, d):
    return _pooled(s, d).select("id", "pool")


@query("srt_03_probe", "SELECT event_id AS pos FROM events WHERE value < 1 ORDER BY sha256('seed:' || event_id), event_id LIMIT 20")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("value") < 1, 0.0).otherwise(F.col("value")).alias("score"))
    return rank.probe(e, "seed").select(F.col("id").alias("pos"))


@query("srt_04_picks", "SELECT id, round(mass, 6) AS mass FROM pooled ORDER BY mass DESC, score DESC, id LIMIT 5", "pooled")
def _(s, d):
    return rank.picks(_pooled(s, d)).select("id", F.round("mass", 6).alias("mass"))


@query("srt_05_term_order", "SELECT term, round(weight, 4) AS weight FROM terms", "terms")
def _(s, d):
    return _terms(s, d).select("term", F.round("weight", 4).alias("weight"))


@query("set_04_pools_disjoint", "SELECT pool, count(*) AS n FROM pooled GROUP BY 1", "pooled")
def _(s, d):
    return _pooled(s, d).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query("prj_13_pool_lexical", "SELECT id, CASE WHEN score > 0 AND n_terms > 1 THEN 'survivor' WHEN score > 0 THEN 'near-miss' ELSE 'probe' END AS pool FROM sc", "sc")
def _(s, d):
    return _scored(s, d).select("id", rank.pool_lexical(F.col("score"), F.col("terms")).alias("pool"))


@query("prj_07_canonical_picks", "SELECT id AS arxiv, score, terms FROM pooled WHERE terms IS NOT NULL ORDER BY mass DESC, score DESC, id LIMIT 5", "pooled")
def _(s, d):
    p = rank.picks(_pooled(s, d).where(F.size("terms") > 0)).withColumn("rescued", F.lit(None).cast("string"))
    return rank.canonical(p).select("arxiv", "score", F.array_join("terms", ",").alias("terms"))


@query("prj_14_run_ids", "SELECT doc_id, substr(sha256(lang || '|' || source), 1, 6) AS run_id, substr(sha256(text), 1, 16) AS print FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", rank.run_id(F.col("lang"), F.col("source")).alias("run_id"), F.substring(F.sha2("text", 256), 1, 16).alias("print"))


@query("prj_14_fingerprint", "SELECT substr(sha256(string_agg(l, chr(10) ORDER BY l)), 1, 16) AS fingerprint FROM (SELECT id || '|' || n_terms || '|' || coalesce(terms, '') || '|' AS l FROM pooled ORDER BY mass DESC, score DESC, id LIMIT 5)", "pooled")
def _(s, d):
    """The numbers of terms stand for the scores, which engines write in different ways."""
    return rank.fingerprint(rank.picks(_pooled(s, d)).withColumn("score", F.size("terms")).withColumn("rescued", F.lit(None).cast("string")))


@query("win_09_finalists", "SELECT run::VARCHAR AS run, id, place FROM (SELECT run, pos AS id, row_number() OVER (PARTITION BY run ORDER BY conf DESC, lexical DESC, pos) AS place FROM journal) WHERE place <= 10", "journal")
def _(s, d):
    j = views.journal(s, d).select("run", F.col("pos").alias("id"), F.col("conf").alias("mass"), F.col("lexical").alias("score"))
    return rank.finalists(j, ["run"]).select(F.col("run").cast("string").alias("run"), "id", F.col("place").cast("long").alias("place"))


# --- model layer ------------------------------------------------------------------------------------------------------


@query("mdl_05_model_first", "SELECT id, round(coalesce(m, 0), 6) AS mass FROM (SELECT *, CASE WHEN id % 3 > 0 THEN mass END AS m FROM pooled) WHERE m IS NOT NULL OR score > 0 ORDER BY coalesce(m, 0) DESC, score DESC, id LIMIT 5", "pooled")
def _(s, d):
    return scorer.model_first(_pooled(s, d).withColumn("mass", F.when(F.col("id") % 3 > 0, F.col("mass")))).select("id", F.round("mass", 6).alias("mass"))


@query("mdl_06_lexical_first", "SELECT id, CASE WHEN pool <> 'survivor' THEN pool END AS rescued FROM pooled WHERE pool = 'survivor' OR (pool IN ('near-miss', 'probe') AND mass >= 0.6) ORDER BY mass DESC, score DESC, id LIMIT 5", "pooled")
def _(s, d):
    return scorer.lexical_first(_pooled(s, d)).select("id", "rescued")


@query("mdl_07_two_pass", "SELECT id, round(CASE WHEN id % 2 = 0 THEN conf / 2 ELSE conf END, 6) AS mass FROM (SELECT run, pos AS id, conf, row_number() OVER (PARTITION BY run ORDER BY conf DESC, lexical DESC, pos) AS place FROM journal) WHERE place <= 10", "journal")
def _(s, d):
    j = views.journal(s, d).select("run", F.col("pos").alias("id"), F.col("conf").alias("mass"), F.col("lexical").alias("score"))
    return scorer.two_pass(j, j.where("id % 2 = 0").select("id", (F.col("mass") / 2).alias("mass"))).select("id", F.round("mass", 6).alias("mass"))


_STATE = "'{\"id\":' || id || ',\"title\":' || to_json(title) || ',\"abstract\":' || to_json(abstract) || '}'"
_STAND_IN = f"('0x' || substr(md5({_STATE}), 1, 8))::BIGINT / 4294967295.0::DOUBLE"


@query("mdl_04_ask", f"SELECT id::VARCHAR AS id, 'score' AS primitive, ['must-read', 'worth-reading', 'borderline', 'unlikely', 'irrelevant'][CAST(floor(x * 4.999::DOUBLE) AS INT) + 1] AS top, 0.7::DOUBLE AS confidence, true AS ok, NULL::VARCHAR AS fail_reason FROM (SELECT id, {_STAND_IN} AS x FROM items)", "items")
def _(s, d):
    """The whole candidate is the state."""
    got = scorer.ask(scorer.states_of(views.items(s, d).select("id", "title", "abstract")), "score", scorer.stand_in)
    return got.select("id", "primitive", "top", "confidence", "ok", "fail_reason")


@query("mdl_02_noul", f"SELECT id::VARCHAR AS id, round(x, 6) AS p, greatest(x, 1 - x) >= 0.6 AS ok FROM (SELECT id, {_STAND_IN} AS x FROM items)", "items")
def _(s, d):
    got = scorer.ask(scorer.states_of(views.items(s, d).select("id", "title", "abstract")), "noul", scorer.stand_in)
    return got.select("id", F.round(calibrate.p_positive(F.col("primitive"), F.col("distribution")), 6).alias("p"), "ok")


@query("mdl_08_with_content", "SELECT i.id, l.doc_id IS NULL AS missed FROM items i LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) l ON l.doc_id = i.id", "items")
def _(s, d):
    return scorer.with_content(views.items(s, d), _docs(s, d).where("doc_id % 2 = 0").select(F.col("doc_id").alias("arxiv"), F.col("lang").alias("conclusions"))).select("id", "missed")


@query("mdl_09_unrated", "SELECT id AS arxiv FROM notes WHERE toxic = 0 AND id % 4 <> 0", "notes")
def _(s, d):
    n = views.notes(s, d).select(F.col("id").alias("arxiv"), F.when(F.col("toxic") == 1, "core").alias("rating"))
    return scorer.unrated(n, n.where("arxiv % 4 = 0")).select("arxiv")


def by_confidence(primitive: str, states: list[str]) -> list[dict[str, float]]:
    """A stand-in scorer that is as sure as its state says; it is down where that is nothing."""
    sure = [json.loads(x)["conf"] for x in states]
    return [{"must-read": x, "irrelevant": 1 - x} for x in sure if x or 1 / 0]


@query("flt_06_min_confidence", "SELECT pos::VARCHAR AS id, CASE WHEN pos % 50 = 0 THEN 'state-overflow' WHEN conf = 0 THEN 'outage: ZeroDivisionError' WHEN greatest(conf, 1 - conf) < 0.6 THEN 'low-confidence' END AS reason FROM journal", "journal")
def _(s, d):
    """FLT-6 through the model layer: every fiftieth state is missing, and a state without confidence finds the model down."""
    states = views.journal(s, d).select(F.col("pos").alias("id"), F.when(F.col("pos") % 50 != 0, F.to_json(F.struct("conf"))).alias("state"))
    return scorer.ask(states, "score", by_confidence).select("id", F.col("fail_reason").alias("reason"))


@query("flt_07_rescue_threshold", "SELECT id, pool AS rescued FROM pooled WHERE pool IN ('near-miss', 'probe') AND mass >= 0.6", "pooled")
def _(s, d):
    """FLT-7: near-misses and probes that the model lifts, of a ranking of all candidates."""
    return scorer.lifted(_pooled(s, d), 0.6).where("rescued IS NOT NULL").select("id", "rescued")


# --- labels -----------------------------------------------------------------------------------------------------------


@query("snk_03_ledger", "SELECT paper, label_type, pos FROM ledger WHERE paper % 2 = 1", "ledger")
def _(s, d):
    old = views.ledger(s, d).where("paper % 2 = 0")
    return labels.new_labels(views.label_rows(s, d), old).select("paper", "label_type", "pos")


@query("agg_17_labels_by_paper", "SELECT paper, string_agg(label_type, ',' ORDER BY label_type) AS types FROM ledger GROUP BY 1", "ledger")
def _(s, d):
    return labels.by_paper(views.ledger(s, d)).select("paper", F.array_join("types", ",").alias("types"))


@query("prj_12_outcome", "SELECT paper, coalesce(outcome, -1) AS outcome FROM outcomes", "outcomes")
def _(s, d):
    return labels.by_paper(views.ledger(s, d)).select("paper", F.coalesce("outcome", F.lit(-1)).alias("outcome"))


@query("win_02_first_labels", "SELECT paper, label_type, pos FROM ledger", "ledger")
def _(s, d):
    return views.ledger(s, d).select("paper", "label_type", "pos")


@query("win_07_first_posting", "SELECT paper, min(ts) AS ts FROM journal WHERE posted GROUP BY 1", "journal")
def _(s, d):
    return labels.first_posting(views.journal(s, d)).select("paper", "ts")


@query("win_10_posted_append", "SELECT id FROM (SELECT user_id AS id, min(CASE WHEN event_id < 100 THEN event_id ELSE 1000000 + event_id END) AS p FROM events GROUP BY 1) ORDER BY p DESC LIMIT 50")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"))
    return labels.posted_append(e.where("pos < 100"), e.where("pos >= 100"), 50).select("id")


@query("join_11_arrival", """SELECT p.paper, CASE WHEN v.status = 'read' THEN 'saved-implicit' ELSE 'unsaved-weak-negative' END AS label_type FROM (SELECT paper, min(ts) AS ts FROM journal WHERE posted GROUP BY 1) p
LEFT JOIN (SELECT DISTINCT paper, CASE WHEN paper % 6 = 0 THEN 'staged' ELSE 'read' END AS status FROM journal WHERE paper % 3 = 0) v USING (paper)
WHERE p.paper NOT IN (SELECT paper FROM ledger WHERE label_type IN ('keep', 'read-later', 'discussed')) AND (v.status = 'read' OR (v.status IS NULL AND TIMESTAMP '2024-01-31' >= p.ts + INTERVAL 20 DAY))""", "journal ledger")  # fmt: skip
def _(s, d):
    """Every third paper is in the vault, half of those staged, whatever its labels."""
    l = views.ledger(s, d)
    vault = views.journal(s, d).where("paper % 3 = 0").select("paper", F.when(F.col("paper") % 6 == 0, "staged").otherwise("read").alias("status")).distinct()
    return labels.arrival(labels.first_posting(views.journal(s, d)), vault, l, F.expr("TIMESTAMP_NTZ '2024-01-31'"), 20)


@query("flt_09_human", "SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
def _(s, d):
    c = table(s, d, "conversations").withColumn("bot_id", F.when(F.col("role") == "system", "B")).withColumn("subtype", F.lit(None).cast("string"))
    return labels.human(c).select("conv_id", "turn")


@query("join_25_replies", "SELECT DISTINCT conv_id AS paper, 'discussed' AS label_type FROM conversations WHERE turn > 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)")
def _(s, d):
    c = table(s, d, "conversations").select(F.lit("C").alias("channel"), F.concat("conv_id", F.lit(".0")).alias("parent"), F.concat("conv_id", F.lit("."), "turn").alias("ts"), F.col("conv_id").alias("paper"))
    return labels.reply_labels(c.where("ts = parent").select("channel", "ts", "paper"), c)


@query("join_25_reactions", "SELECT DISTINCT user_id * 10 + day(ts) % 10 AS paper, CASE event_type WHEN 'view' THEN 'keep' ELSE 'skip' END AS label_type FROM events WHERE user_id % 3 = 0 AND event_type IN ('view', 'error')")
def _(s, d):
    e = table(s, d, "events").select((F.col("user_id") * 10 + F.dayofmonth("ts") % 10).alias("paper"), "user_id", "event_type", F.lit("C").alias("channel"), F.col("event_id").cast("string").alias("ts"))
    r = e.select("channel", "ts", F.array(F.struct(F.col("event_type").alias("name"), F.array(F.col("user_id").cast("string")).alias("users"))).alias("reactions"))
    keepers = e.where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("user")).distinct()
    emoji = s.createDataFrame([("view", "keep"), ("error", "skip")], "name string, label_type string")
    return labels.reaction_labels(e.select("channel", "ts", "paper"), r, keepers, emoji)


@query("flt_12_checked_boxes", "SELECT DISTINCT '2601.' || lpad(CAST(doc_id % 900 + 1000 AS VARCHAR), 5, '0') AS paper, 'keep' AS label_type FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def _(s, d):
    """Ticked or not, indented, without link brackets, in notes that aren't digests."""
    k = F.col("doc_id")
    i = F.concat(F.lit("2601."), F.lpad((k % 900 + 1000).cast("string"), 5, "0"))
    line = F.concat(F.when(k % 3 == 0, "  ").otherwise(""), F.lit("- ["), F.when(k % 2 == 0, "x").otherwise(" "), F.lit("] t — "), F.when(k % 5 == 0, F.concat(F.lit("arXiv:"), i)).otherwise(F.concat(F.lit("[arXiv:"), i, F.lit("](https://arxiv.org/abs/"), i, F.lit(")"))))
    return labels.checked_boxes(_docs(s, d).select(F.concat(F.when(k % 7 == 0, "---\ntype: paper\n---\n").otherwise("---\ntype: digest\n---\n"), line, F.lit("\n")).alias("content")))


@query("set_09_all_labels", "SELECT paper, label_type FROM ledger UNION SELECT paper, 'posted' FROM journal WHERE posted", "ledger")
def _(s, d):
    return labels.all_labels(views.ledger(s, d), views.journal(s, d).where("posted").select("paper", F.lit("posted").alias("label_type")))


@query("join_20_display_names", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Ann' ELSE role END AS name FROM conversations")
def _(s, d):
    u = s.createDataFrame([("user", "Ann")], "user string, name string")
    return labels.display_names(table(s, d, "conversations").withColumn("user", F.col("role")), u).select("conv_id", "turn", "name")


# --- calibration ------------------------------------------------------------------------------------------------------


@query("win_01_latest_receipt", "SELECT run::VARCHAR AS run, paper, primitive, pos FROM latest", "latest")
def _(s, d):
    return calibrate.latest(views.receipts(s, d)).select(F.col("run").cast("string").alias("run"), "paper", "primitive", "pos")


@query("join_09_graded", "SELECT run::VARCHAR AS run, paper, outcome FROM graded", "graded")
def _(s, d):
    return _graded(s, d).select(F.col("run").cast("string").alias("run"), "paper", "outcome")


@query("agg_07_brier", "SELECT k.primitive, round(avg((p - outcome) * (p - outcome)), 6) AS brier, count(p) AS n FROM (VALUES ('noul'), ('score')) k(primitive) LEFT JOIN graded g ON g.primitive = k.primitive GROUP BY 1", "graded")
def _(s, d):
    return calibrate.brier(_graded(s, d))


@query("agg_08_reliability", "SELECT primitive, least(9, CAST(floor(p * 10) AS INT)) AS bin, round(sum(p::DECIMAL(28,12))::DOUBLE / count(*), 6) AS mean_p, round(avg(outcome), 6) AS observed, count(*) AS n FROM graded GROUP BY 1, 2", "graded")
def _(s, d):
    return calibrate.reliability(_graded(s, d))


@query("win_06_first_posted", "SELECT run::VARCHAR AS run, paper, pos FROM journal WHERE posted", "journal")
def _(s, d):
    return calibrate.first_posted(views.journal(s, d)).select(F.col("run").cast("string").alias("run"), "paper", "pos")


@query("agg_09_precision5", "SELECT round(avg(CASE WHEN l.paper IS NULL THEN 0.0 ELSE 1.0 END), 6) AS precision, count(*) AS n FROM journal j LEFT JOIN (SELECT DISTINCT paper FROM ledger WHERE label_type <> 'skip') l ON l.paper = j.paper WHERE j.posted", "ledger")
def _(s, d):
    return calibrate.precision_at_5(views.journal(s, d), views.ledger(s, d))


@query("agg_10_probe_lift", """SELECT arm, round(avg(CASE WHEN l.paper IS NULL THEN 0.0 ELSE 1.0 END), 4) AS keep_rate, count(*) AS n FROM (SELECT 'rescue' AS arm, paper FROM journal WHERE posted AND pos % 3 = 0
UNION ALL SELECT 'survivor', paper FROM (SELECT paper FROM journal WHERE posted AND pos % 3 <> 0 AND pos % 2 = 0 ORDER BY pos LIMIT 5)) a LEFT JOIN (SELECT DISTINCT paper FROM ledger WHERE label_type IN ('keep', 'read-later')) l USING (paper) GROUP BY 1""", "ledger")  # fmt: skip
def _(s, d):
    j = views.journal(s, d).withColumn("rescued", F.when(F.col("pos") % 3 == 0, "probe")).withColumn("pool", F.when(F.col("pos") % 2 == 0, "survivor").otherwise("near-miss"))
    return calibrate.probe_lift(j.withColumn("ranking", F.lit("lexical-first")), views.ledger(s, d))


@query("agg_10_probe_lift_na", "SELECT unnest(['rescue', 'survivor']) AS arm, NULL::DOUBLE AS keep_rate, 0::BIGINT AS n")
def _(s, d):
    """One run ranked by model first."""
    j = views.journal(s, d).withColumn("rescued", F.when(F.col("pos") % 3 == 0, "probe")).withColumn("pool", F.lit("survivor"))
    return calibrate.probe_lift(j.withColumn("ranking", F.when(F.col("run") == F.lit("2024-01-05").cast("date"), "model-first").otherwise("lexical-first")), views.ledger(s, d))


@query("agg_11_label_counts", "SELECT count(DISTINCT paper) FILTER (label_type IN ('keep', 'read-later')) AS positives, count(DISTINCT paper) FILTER (label_type = 'skip') AS skips, 0::BIGINT AS weak_negatives FROM ledger", "ledger")
def _(s, d):
    return calibrate.label_counts(views.ledger(s, d))


@query("agg_12_recommendation", "SELECT k, n, CASE WHEN n < 20 THEN 'collect more labels' ELSE 'enough labels' END AS advice FROM (SELECT k, count(DISTINCT paper) FILTER (label_type IN ('keep', 'read-later') AND paper % k = 0) + count(DISTINCT paper) FILTER (label_type = 'skip' AND paper % k = 0) AS n FROM ledger, (VALUES (1), (7), (5000)) v(k) GROUP BY k)", "ledger")
def _(s, d):
    """Of the whole ledger, and of two lanes' parts of it, one of which has too few labels."""
    ledger = views.ledger(s, d)
    parts = [calibrate.recommendation(calibrate.label_counts(ledger.where(F.col("paper") % k == 0))).select(F.lit(k).alias("k"), "n", "advice") for k in (1, 7, 5000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DIRECTIVES = "read widély \"often\"\n" * 50


def _taste(s: SparkSession, d: str) -> pack.Taste:
    """A profile's 200 terms, the 40 newest notes (that aren't staged) as cards and why-lines, three titles, directives."""
    n = views.notes(s, d).where("NOT staged").orderBy("age_days", "id").limit(40)
    rows = n.select(F.expr("left(text, 80)").alias("title"), F.expr("substring(text, 81, 200)").alias("abstract"), F.concat_ws(" ", "lang", "source", F.expr("right(text, 150)")).alias("why"), F.round(numbers.decay(F.col("age_days"), 180.0), 6).alias("w")).collect()
    terms = [(r["term"], r["weight"]) for r in _terms(s, d).collect()]
    return pack.Taste(terms, [(r["w"], {"title": r["title"], "why": r["why"], "abstract": r["abstract"]}) for r in rows], [r["why"] for r in rows], [r["title"] for r in rows[:3]], _DIRECTIVES)


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Documents with a quality label as candidates; those with even ids have conclusions: what their texts end with."""
    x = _docs(s, d).join(table(s, d, "labels").select("doc_id", F.col("quality").alias("outcome")), "doc_id")
    return x.select(F.col("doc_id").alias("id"), F.expr("left(text, 80)").alias("title"), F.array("lang", "source").alias("authors"), F.expr("substring(text, 81)").alias("abstract"), F.when(F.col("doc_id") % 2 == 0, F.expr("right(text, 700)")).alias("conclusions"), "outcome")


def by_size(primitive: str, states: list[str]) -> list[dict[str, float]]:
    """A stand-in scorer whose masses SQL can tell: they follow from a state's size."""
    return [{"must-read": len(x) % 97 / 96, "irrelevant": 1 - len(x) % 97 / 96} for x in states]


def _dump_bytes(x: str) -> str:
    """SQL: bytes of a text in JSON with escapes for all that isn't ASCII."""
    return f"(2 + length({x}) + len(regexp_extract_all({x}, '[\"\\\\\\n\\r\\t\\x08\\x0c]')) + 5 * len(regexp_extract_all({x}, '[^ -~\\n\\r\\t\\x08\\x0c]')) + 6 * len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


_LAB = "SELECT doc_id AS id, quality AS outcome, left(text, 80) AS title, substr(text, 81, 750) AS abstract, CASE WHEN doc_id % 2 = 0 AND text <> '' THEN left(right(text, 700), 600) END AS ends, lang, source FROM documents JOIN labels USING (doc_id)"


def _arms_sql(select: str, candidates: str = _LAB) -> str:
    """SQL with sized(arm, id, outcome, n: bytes of the state): sizes of states by arm, from sizes of their parts alone."""
    j = _dump_bytes
    fixed = "length('{\"candidate\": , \"researcher_taste\": {\"directives\": , \"recent_titles\": , \"terms\": {}, \"why_lines\": []}}')"
    greedy = "length('{\"candidate\": , \"researcher_taste\": {\"cards\": , \"directives\": , \"recent_titles\": , \"terms\": }}')"
    arms = ", ".join(f"('{n}', '{k}', {b}, {h}, {str(c).lower()})" for n, k, b, h, c in calibrate.ARMS)
    return f"""
tn AS (SELECT term, weight, {j('term')} + 2 + length(CAST(round(weight, 2) AS VARCHAR)) AS e FROM terms),
nn AS (SELECT left(text, 80) AS title, substr(text, 81, 200) AS abstract, substr(lang || ' ' || source || ' ' || right(text, 150), 1, 200) AS why, round(pow(0.5, age_days / 180.0::DOUBLE), 6) AS w, row_number() OVER (ORDER BY age_days, id) AS k FROM notes WHERE NOT staged ORDER BY k LIMIT 40),
dir AS (SELECT repeat('read widély "often"' || chr(10), 50) AS t),
base AS (SELECT (SELECT {j('t')} FROM dir) AS whole, (SELECT {j('substr(t, 1, 800)')} FROM dir) AS cut, (SELECT 2 + sum({j('title')}) + 2 * (count(*) - 1) FROM nn WHERE k <= 3) AS titles),
ft AS (SELECT list(e ORDER BY weight DESC, term) AS x FROM (SELECT * FROM tn ORDER BY weight DESC, term LIMIT 15)),
fw AS (SELECT list({j('why')} ORDER BY k) AS x FROM nn),
cuts AS (SELECT unnest([0, 5, 10, 15]) AS many),
by_terms AS (SELECT many, CASE WHEN many = 0 THEN 0 ELSE list_sum(x[1:many]) + 2 * (many - 1) END AS t FROM cuts, ft),
by_whys AS (SELECT r, CASE WHEN r = 0 THEN 0 ELSE list_sum(x[1:r]) + 2 * (r - 1) END AS y FROM (SELECT unnest(range(0, len(x) + 1)) AS r, x FROM fw)),
it AS (SELECT 't' AS kind, 't:' || term AS name, weight / max(weight) OVER () AS pr, e + 2 AS size FROM tn UNION ALL
       SELECT 'c', 'c:' || title, w / max(w) OVER (), 2 + length('"title": , "why": ') + {j('title')} + {j('why')} + CASE WHEN abstract = '' THEN 0 ELSE length('"abstract": , ') + {j('abstract')} END FROM nn),
fill AS (SELECT b, list_reduce(list_prepend({{'used': 0::BIGINT, 'kept': []::STRUCT(kind VARCHAR, size BIGINT)[], 'kind': '', 'size': 0::BIGINT}}, list({{'used': 0::BIGINT, 'kept': []::STRUCT(kind VARCHAR, size BIGINT)[], 'kind': kind, 'size': size::BIGINT}} ORDER BY pr DESC, name)),
         lambda a, x: CASE WHEN a.used + x.size <= b THEN {{'used': a.used + x.size, 'kept': list_append(a.kept, {{'kind': x.kind, 'size': x.size}}), 'kind': '', 'size': 0::BIGINT}} ELSE a END).kept AS kept FROM it, (SELECT unnest([2500, 8000, 12000]) AS b) GROUP BY b),
parts AS (SELECT b, list_transform(list_filter(kept, lambda x: x.kind = 'c'), lambda x: x.size) AS c, list_transform(list_filter(kept, lambda x: x.kind = 't'), lambda x: x.size - 2) AS t FROM fill),
cr AS (SELECT b, n, CASE WHEN n = 0 THEN 4 ELSE 2 + list_sum(c[1:n]) + 2 * (n - 1) END AS size FROM (SELECT b, c, unnest(range(0, len(c) + 1)) AS n FROM parts)),
tr AS (SELECT b, n, n = len(t) AS every, CASE WHEN n = 0 THEN 4 ELSE 2 + list_sum(t[1:n]) + 2 * (n - 1) END AS size FROM (SELECT b, t, unnest(range(0, len(t) + 1)) AS n FROM parts)),
rungs AS (SELECT cr.b, cr.size + tr.size AS size FROM cr JOIN tr ON cr.b = tr.b AND (tr.every OR cr.n = 0)),
lab AS ({candidates}),
cand AS (SELECT id, outcome, length('{{"abstract": , "arxiv": "", "authors": [, ], "title": }}') + length(id::VARCHAR) + {j('abstract')} + {j('lang')} + {j('source')} + {j('title')} AS c, coalesce(length('"conclusions": , ') + {j('ends')}, 0) AS more FROM lab),
arm AS (SELECT * FROM (VALUES {arms}) a(arm, kind, budget, hard, content)),
each AS (SELECT arm.*, id, outcome, c + CASE WHEN content THEN more ELSE 0 END AS c FROM cand, arm),
fx AS (SELECT e.*, c + {fixed} + cut + titles AS bare, (SELECT max(y) FROM by_whys) AS every FROM each e, base WHERE kind = 'fixed-15'),
fm AS (SELECT f.arm, f.id, f.outcome, f.hard, f.bare, coalesce(max(many) FILTER (many > 0 AND bare + t + every <= 3378), 0) AS many FROM fx f, by_terms GROUP BY ALL),
fs AS (SELECT f.arm, f.id, f.outcome, max(bare + t + y) AS n FROM fm f JOIN by_terms USING (many) LEFT JOIN by_whys ON bare + t + y <= hard GROUP BY ALL),
gs AS (SELECT e.arm, e.id, e.outcome, max(c + {greedy} + whole + titles + size) AS n FROM each e CROSS JOIN base LEFT JOIN rungs ON b = budget AND c + {greedy} + whole + titles + size <= hard WHERE kind <> 'fixed-15' GROUP BY ALL),
sized AS (SELECT * FROM fs UNION ALL SELECT * FROM gs) {select}"""


@query("agg_13_arm_metrics", with_views("notes terms", "").rstrip() + ", " + _arms_sql("SELECT arm, round(avg((p - outcome) * (p - outcome)) FILTER (greatest(p, 1 - p) >= 0.6), 6) AS brier, count(*) FILTER (greatest(p, 1 - p) >= 0.6) AS n, round(avg(n), 4) AS mean_bytes FROM (SELECT arm, outcome, n, n % 97 / 96.0::DOUBLE AS p FROM sized) GROUP BY arm"))
def _(s, d):
    """JOIN-22, 23, MDL-10: labelled documents, assembled and scored anew under every arm."""
    return calibrate.arm_metrics(calibrate.replay(_labelled(s, d), _taste(s, d), by_size))


@query("mdl_10_arm_states", with_views("notes terms", "").rstrip() + ", " + _arms_sql("SELECT arm, id::VARCHAR AS id, coalesce(n, -1)::BIGINT AS n FROM sized"))
def _(s, d):
    """PCK-1, PCK-2: bytes of each state, -1 where nothing fits."""
    got = pack.assembled(_labelled(s, d), _taste(s, d), calibrate.ARMS)
    return got.select("arm", "id", F.coalesce(F.length("state"), F.lit(-1)).cast("long").alias("n"))


@query("pck_03_arms", with_views("notes terms", "").rstrip() + ", " + _arms_sql("SELECT s.arm, budget AS taste_budget, hard AS hard_cap, count(n) AS fitting FROM sized s JOIN arm USING (arm) GROUP BY ALL"))
def _(s, d):
    """The arms, and how many labelled documents' states fit each."""
    fitting = pack.assembled(_labelled(s, d), _taste(s, d), calibrate.ARMS).groupBy("arm").agg(F.count("state").alias("fitting"))
    return calibrate.arms(s).select("arm", "taste_budget", "hard_cap").join(fitting, "arm")


@query("join_22_replay_set", "SELECT j.pos, j.paper, o.outcome FROM journal j JOIN outcomes o USING (paper) WHERE o.outcome IS NOT NULL", "journal outcomes")
def _(s, d):
    return calibrate.graded(views.journal(s, d), labels.by_paper(views.ledger(s, d))).select("pos", "paper", "outcome")


@query("win_08_last_runs", "SELECT run::VARCHAR AS run, n FROM (SELECT run, count(*) AS n FROM journal GROUP BY 1) ORDER BY run DESC LIMIT 7", "journal")
def _(s, d):
    r = views.journal(s, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return calibrate.last_runs(r.withColumn("line_no", F.col("run")), 7).select(F.col("run").cast("string").alias("run"), "n")


@query("join_13_in_runs", "SELECT pos FROM receipts WHERE run IN (SELECT DISTINCT run FROM journal ORDER BY run DESC LIMIT 7)", "receipts")
def _(s, d):
    runs = calibrate.last_runs(views.journal(s, d).select("run").distinct().withColumn("line_no", F.col("run")), 7)
    return calibrate.in_runs(views.receipts(s, d), runs).select("pos")


@query("prj_08_p_positive", "SELECT pos, CASE WHEN primitive = 'noul' THEN p ELSE p / 2 + p / 4 END AS p FROM receipts", "receipts")
def _(s, d):
    dist = F.when(F.col("primitive") == "noul", calibrate.noul_distribution(F.col("p"))).otherwise(F.create_map(F.lit("must-read"), F.col("p") / 2, F.lit("worth-reading"), F.col("p") / 4))
    return views.receipts(s, d).select("pos", calibrate.p_positive(F.col("primitive"), dist).alias("p"))


@query("prj_10_top", "SELECT pos, CASE WHEN p >= 0.5 THEN CASE WHEN p = 0.5 THEN 'false' ELSE 'true' END ELSE 'false' END AS top, round(greatest(p, 1 - p), 6) AS confidence FROM receipts", "receipts")
def _(s, d):
    dist = calibrate.noul_distribution(F.col("p"))
    return views.receipts(s, d).select("pos", numbers.top_key(dist).alias("top"), F.round(calibrate.confidence(dist), 6).alias("confidence"))


# --- days -------------------------------------------------------------------------------------------------------------

#: Attempts at the steps of a day, one an event; each user is a lane, every tenth one shared.
_STEP_OF = {"view": "digest", "click": "digest", "signup": "ingest", "purchase": "sync", "error": "calibrate"}
_DAYS = (
    "WITH attempt AS (SELECT user_id AS lane, user_id % 10 = 0 AS shared, CAST(ts AS DATE) AS day, ts, value > 60 AS ok, CASE event_type "
    + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in _STEP_OF.items())
    + """ END AS step FROM events),
    planned AS (SELECT * FROM (SELECT DISTINCT lane, shared, day FROM attempt), (VALUES (0, 'digest'), (1, 'ingest'), (2, 'sync'), (3, 'calibrate'), (4, 'review')) s(place, step)
        WHERE (shared OR step <> 'ingest') AND (isodow(day) = 7 OR step NOT IN ('calibrate', 'review'))),
    tried AS (SELECT lane, day, step, count(*) AS n, bool_or(ok) AS ok, max(ts) AS last FROM attempt GROUP BY ALL),
    stated AS (SELECT p.*, coalesce(n, 0) AS attempts, last + INTERVAL 10 MINUTE AS again, CASE WHEN ok THEN 'done' WHEN step = 'digest' AND isodow(day) >= 6 AND n >= 1 THEN 'quiet'
        WHEN n >= CASE WHEN step = 'digest' AND isodow(day) < 6 THEN 2 ELSE 1 END THEN 'failed' ELSE 'open' END AS status FROM planned p LEFT JOIN tried USING (lane, day, step)) """
)


def _states(s: SparkSession, d: str) -> DataFrame:
    step = F.create_map(*[F.lit(x) for pair in _STEP_OF.items() for x in pair])[F.col("event_type")]
    tried = table(s, d, "events").select(F.col("user_id").alias("lane"), F.to_date("ts").alias("day"), "ts", step.alias("step"), (F.col("value") > 60).alias("ok"))
    lanes = tried.select("lane", (F.col("lane") % 10 == 0).alias("shared"), "day").distinct()
    return daily.states(daily.plan(lanes), tried, retries=2)


@query("stm_05_step_states", _DAYS + "SELECT lane, CAST(day AS VARCHAR) AS day, step, attempts, status, CASE WHEN status = 'open' THEN strftime(again, '%Y-%m-%d %H:%M:%S') END AS next_try FROM stated")
def _(s, d):
    return _states(s, d).select("lane", F.col("day").cast("string").alias("day"), "step", "attempts", "status", F.date_format("next_try", "yyyy-MM-dd HH:mm:ss").alias("next_try"))


@query("stm_06_due", _DAYS + """SELECT lane, CAST(day AS VARCHAR) AS day, step FROM stated WHERE status = 'open' AND day <= DATE '2024-01-21' AND (again IS NULL OR again <= TIMESTAMP '2024-01-21 12:00:00')
    AND NOT EXISTS (SELECT 1 FROM stated e WHERE e.lane = stated.lane AND e.day = stated.day AND e.place < stated.place AND e.status = 'open')""")  # fmt: skip
def _(s, d):
    """What a timer would start at noon of a Sunday."""
    return daily.due(_states(s, d), F.expr("TIMESTAMP_NTZ '2024-01-21 12:00:00'")).select("lane", F.col("day").cast("string").alias("day"), "step")


@query("stm_06_reports", _DAYS + """SELECT lane, CAST(day AS VARCHAR) AS day, count(*) FILTER (status = 'open') AS open,
    coalesce('done with failures: ' || string_agg(step, ', ' ORDER BY place) FILTER (status = 'failed'), 'done') AS line FROM stated GROUP BY lane, day""")  # fmt: skip
def _(s, d):
    return daily.reports(_states(s, d)).select("lane", F.col("day").cast("string").alias("day"), "open", "line")


# --- review -----------------------------------------------------------------------------------------------------------


@query("flt_08_window", "SELECT pos FROM journal WHERE ts >= TIMESTAMP '2024-01-20'", "journal")
def _(s, d):
    return review.in_window(views.journal(s, d), F.expr("TIMESTAMP_NTZ '2024-01-27 15:00:00'"), 7).select("pos")


@query("prj_11_relevance", "SELECT pos, round(rel, 6) AS rel FROM journal", "journal")
def _(s, d):
    return views.journal(s, d).select("pos", F.round("rel", 6).alias("rel"))


def _answered(s: SparkSession, d: str) -> DataFrame:
    """The journal with every seventh row unanswered by the model and lexical scores in tens, so that ties are many."""
    return views.journal(s, d).withColumn("rel", F.when(F.col("pos") % 7 > 0, F.col("rel"))).withColumn("lexical", F.floor(F.col("lexical") / 10))


@query("win_03_ranks", "SELECT pos, row_number() OVER (PARTITION BY run ORDER BY rel DESC, paper, pos) AS model_rank, row_number() OVER (PARTITION BY run ORDER BY floor(lexical / 10) DESC, paper, pos) AS lexical_rank FROM journal WHERE pos % 7 > 0", "journal")
def _(s, d):
    return review.ranked(_answered(s, d)).select("pos", F.col("model_rank").cast("long").alias("model_rank"), F.col("lexical_rank").cast("long").alias("lexical_rank"))


_GAPS = "(SELECT paper, pos, row_number() OVER (PARTITION BY run ORDER BY floor(lexical / 10) DESC, paper, pos) - row_number() OVER (PARTITION BY run ORDER BY rel DESC, paper, pos) AS gap FROM journal WHERE pos % 7 > 0)"


@query("win_04_divergence_hot", f"SELECT paper, gap, pos FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY gap DESC, pos) AS rn FROM {_GAPS}) WHERE rn = 1 AND gap > 0 ORDER BY gap DESC, paper LIMIT 5", "journal")
def _(s, d):
    return review.divergences(_answered(s, d)).select("paper", F.col("gap").cast("long").alias("gap"), "pos")


@query("win_04_divergence_cold", f"SELECT paper, gap, pos FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY gap, pos) AS rn FROM {_GAPS}) WHERE rn = 1 AND gap < 0 ORDER BY gap, paper LIMIT 5", "journal")
def _(s, d):
    return review.divergences(_answered(s, d), hot=False).select("paper", F.col("gap").cast("long").alias("gap"), "pos")


@query("win_05_buried", "SELECT paper, round(rel, 6) AS rel, pos FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY rel DESC, pos) AS rn FROM journal WHERE NOT posted AND relevant) WHERE rn = 1 ORDER BY rel DESC, paper LIMIT 10", "journal")
def _(s, d):
    return review.buried(views.journal(s, d)).select("paper", F.round("rel", 6).alias("rel"), "pos")


@query("agg_14_week_counts", "SELECT (SELECT count(*) FROM journal WHERE posted) AS posted, count(DISTINCT paper) FILTER (label_type IN ('keep', 'read-later')) AS kept, count(DISTINCT paper) FILTER (label_type = 'skip') AS skipped, count(DISTINCT paper) FILTER (label_type IN ('keep', 'read-later')) + count(DISTINCT paper) FILTER (label_type = 'skip') AS labelled FROM ledger WHERE paper IN (SELECT paper FROM journal WHERE posted)", "ledger")
def _(s, d):
    return review.week_counts(views.journal(s, d), views.ledger(s, d))


@query("agg_15_buried_total", "SELECT count(DISTINCT paper) AS buried_total FROM journal WHERE NOT posted AND relevant", "journal")
def _(s, d):
    return review.buried_total(views.journal(s, d))


@query("agg_16_seen", "SELECT paper, bool_or(posted) AS posted, min(pos) AS first_pos FROM journal GROUP BY 1", "journal")
def _(s, d):
    return review.seen(views.journal(s, d))


@query("agg_19_by_rating", "SELECT rating, count(*) AS n FROM notes GROUP BY 1", "notes")
def _(s, d):
    return review.by_rating(views.notes(s, d))


@query("agg_21_roster_hits", "SELECT count(*) FILTER (doc_id % 4 = 0) AS hits FROM documents")
def _(s, d):
    return review.roster_hits(_docs(s, d).select(F.when(F.col("doc_id") % 4 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("hits")))


# --- text, numbers ----------------------------------------------------------------------------------------------------


@query("str_01_boundary_counts", r"SELECT doc_id, len(regexp_extract_all(lower(text), '(^|[^a-z0-9-])the([^a-z0-9-]|$)')) AS n FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.count_matches(F.lower("text"), F.lit("the")).cast("long").alias("n"))


@query("str_02_tokens", "SELECT term, count(*) AS n FROM tok GROUP BY 1", "tok")
def _(s, d):
    return views.notes(s, d).select(F.explode(text.tokens(F.col("text"), ())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("str_03_strip_tags", r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]*>', ' ', 'g'))) AS clean FROM pages".replace('\\"', '"'))
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("clean"))


@query("str_04_split_names", r"SELECT doc_id, 'Ann Lee|' || lang || '|' || source AS names FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.array_join(text.split_names(F.concat(F.lit("Ann Lee, "), "lang", F.lit(", and "), "source")), "|").alias("names"))


@query("str_05_ids", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2601.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') WHEN 1 THEN 'quant-ph/' || lpad(CAST(doc_id % 10000000 AS VARCHAR), 7, '0') WHEN 2 THEN '2602.' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') END AS id FROM documents")
def _(s, d):
    """Ids after a mark or in a link, amid whole texts without digits; numbers alone are none."""
    k, pad = F.col("doc_id"), lambda n: F.lpad((F.col("doc_id") % 10**n).cast("string"), n, "0")
    said = F.when(k % 4 == 0, F.concat(F.lit(" arXiv:2601."), pad(5))).when(k % 4 == 1, F.concat(F.lit(" https://arxiv.org/abs/Quant-PH/"), pad(7), F.lit("v2"))).when(k % 4 == 2, F.concat(F.lit(" ARXIV 2602."), pad(4), F.lit(" arXiv:2603.00001"))).otherwise(F.concat(F.lit(" 2601."), pad(5)))
    prose = F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)[0-9]|arxiv|abs/", "x")
    return _docs(s, d).select("doc_id", text.arxiv_in(F.concat(prose, said, F.lit(" "), prose)).alias("id"))


@query("str_06_arxiv", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '2601.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') ELSE 'Other ' || doc_id END AS id FROM documents")
def _(s, d):
    k = F.col("doc_id")
    raw = F.when(k % 2 == 0, F.concat(F.lit(" arXiv:2601."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("V3"))).otherwise(F.concat(F.lit(" Other "), k.cast("string")))
    return _docs(s, d).select("doc_id", text.normalize_arxiv(raw).alias("id"))


@query("str_07_doi", "SELECT doc_id, '10.1000/' || lang || doc_id AS doi FROM documents")
def _(s, d):
    k = F.col("doc_id")
    return _docs(s, d).select("doc_id", text.normalize_doi(F.concat(F.when(k % 3 == 0, "https://doi.org/").when(k % 3 == 1, "DOI: ").otherwise(" "), F.lit("10.1000/"), F.upper("lang"), k.cast("string"))).alias("doi"))


@query("str_08_norm_title", "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS title FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.md5(text.normalize_title(F.col("text"))).alias("title"))


@query("str_09_slug", "SELECT doc_id, trim(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') AS slug FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("str_10_fold_accents", "SELECT doc_id, md5(strip_accents(regexp_replace(text, '[^a-zA-ZÀ-ÿ ]', '', 'g'))) AS folded FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.md5(text.fold_accents(F.regexp_replace("text", "[^a-zA-ZÀ-ÿ ]", ""))).alias("folded"))


@query("str_15_abstract_section", r"SELECT doc_id, abstract FROM (SELECT doc_id, substr(trim(regexp_replace(regexp_split_to_array(chr(10) || text || chr(10) || '1. Introduction', '(?im)^[ \t]*(?:\(?[0-9]+[.)]?[ \t]+)?introduction\b')[1], '\s+', ' ', 'g')), 1, 400) AS abstract FROM documents) WHERE abstract <> ''")
def _(s, d):
    t = F.concat(F.lit("Title\nAbstract\n"), "text", F.lit("\n1. Introduction\nrest"))
    return _docs(s, d).select("doc_id", text.abstract_section(t).alias("abstract")).where("abstract IS NOT NULL")


@query("str_11_split_group", "SELECT doc_id, lang AS name, CASE WHEN doc_id % 2 = 0 THEN source END AS grp FROM documents")
def _(s, d):
    n, g = text.split_group(F.concat("lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" — "), "source")).otherwise("")))
    return _docs(s, d).select("doc_id", n.alias("name"), g.alias("grp"))


@query("str_12_wikilinks", "SELECT doc_id, lang || ',' || source AS links FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.array_join(text.wikilinks(F.concat(F.lit("a [["), "lang", F.lit("|x]] b [["), "source", F.lit("#h|y]] [["), "lang", F.lit("]]"))), ",").alias("links"))


@query("str_13_latex")
def _(s, d):
    return _docs(s, d).select("doc_id", parsers.latex_to_unicode(F.concat(F.lit("$\\sqrt{\\text{"), "lang", F.lit("}}$ \\alpha "), "source")).alias("title"))


@query("str_14_collapse", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS c FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.md5(text.collapse(F.col("text"))).alias("c"))


@query("str_16_conclusions_section")
def _(s, d):
    t = F.concat(F.lit("Intro\nSummary\nshort\nReferences\n5. Conclusions\n"), "text", F.lit("\nReferences\n[1] x"))
    return _docs(s, d).select("doc_id", text.conclusions_section(t).alias("conclusions"))


@query("str_17_affiliations", "SELECT doc_id, 'University of ' || lang || '|RIKEN, Wako|Academy of ' || lang || '|CNRS' AS a, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS more FROM documents")
def _(s, d):
    """Every third page has an institution in line 28, and its abstract's heading in one of the lines 29 to 39."""
    lines = lambda n: "".join(f"by {k}\n" for k in range(n))
    late = F.concat(F.lit(lines(18) + "6 Institute of Late Lines\n"), F.element_at(F.array(F.lit(""), F.lit(lines(9)), F.lit(lines(10))), (F.col("doc_id") % 2 + F.col("doc_id") % 5 % 2 + 1).cast("int")))
    page = F.concat(F.lit("T\nA. B\n1 Department of X, University of "), "lang", F.lit(", Germany\n2 RIKEN,\nWako, Japan and\n* riken,  Wako\n3 Academy of "), "lang", F.lit("\n4 CNRS\n5 National Centre\n"),
                    F.when(F.col("doc_id") % 3 == 0, late).otherwise(""), F.lit("Abstract\n"), "text", F.lit("\nInstitute of the Text"))
    shown, more = parsers.shown_affiliations(parsers.affiliations(page))
    return _docs(s, d).select("doc_id", F.array_join(shown, "|").alias("a"), more.cast("long").alias("more"))


@query("str_18_bibtex", r"""SELECT 'article' AS kind, title, 'A, B;C ' || lang AS authors, '2601.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS arxiv, '10.1/x' || doc_id AS doi FROM (SELECT *, trim(regexp_replace(regexp_replace(text, '[{}"@]', '', 'g'), '\s+', ' ', 'g')) AS title FROM documents) WHERE title <> ''""")
def _(s, d):
    """Entries whose titles are whole texts (without braces, quotes and at signs)."""
    key = F.col("doc_id").cast("string")
    e = _docs(s, d).select(F.concat(F.lit("@Article{k,\n title = {"), F.regexp_replace("text", r'[{}"@]', ""), F.lit("},\n author = {A, B and C "), "lang", F.lit("},\n eprint = {2601."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit("v2},\n doi = {10.1/X"), key, F.lit("}\n}\n")).alias("value"))
    return files.bibtex_entries(e).select("kind", "title", F.array_join("authors", ";").alias("authors"), "arxiv", "doi")


@query("str_19_who_line", "SELECT doc_id, '⭐ ' || lang || ' (G), b, c +1 — ⭐ zed · U' AS who FROM documents")
def _(s, d):
    hit = lambda n, g: F.struct(n.alias("name"), g.alias("group"))
    hits = F.array(hit(F.col("lang"), F.lit("G").cast("string")), hit(F.lit("zed"), F.lit(None).cast("string")))
    return _docs(s, d).select("doc_id", text.who_line(F.array("lang", F.lit("b"), F.lit("c"), F.lit("d")), hits, F.array(F.lit("U")), F.lit(0)).alias("who"))


@query("str_20_why_line", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'rescued by probe — no lexical match, relevance p=0.50' WHEN doc_id % 3 = 1 THEN 'rescued by near-miss match · `' || lang || '` (score 1.5)' ELSE '`' || lang || '` (score 1.5)' END AS why FROM documents")
def _(s, d):
    k = F.col("doc_id") % 3
    return _docs(s, d).select("doc_id", text.why_line(F.array("lang"), F.lit(1.5), F.when(k == 0, "probe").when(k == 1, "near-miss"), F.lit(0.5)).alias("why"))


@query("str_21_mrkdwn", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS m FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(text.mrkdwn(F.col("html"))).alias("m"))


@query("str_22_yaml_scalar", r"""SELECT page_id, md5(trim(regexp_replace(translate(html, '"\', '''/'), '\s+', ' ', 'g'))) AS y FROM pages""")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(text.yaml_scalar(F.col("html"))).alias("y"))


@query("str_23_sanitize", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<sanitized-secret>' WHEN 1 THEN 'C0000000SYN' WHEN 2 THEN 'X0000000SYN' ELSE md5(text) END AS value, '<dropped-secret>' AS field, '<dropped-secret>' AS deep, CASE WHEN doc_id % 4 = 0 THEN '<sanitized-secret>' ELSE md5(text) END AS listed,
'U0000000SYN' AS user, doc_id AS number, CASE WHEN doc_id % 2 = 0 THEN '<sanitized-secret>' ELSE 'not JSON' END AS loose FROM documents""")
def _(s, d):
    """Payloads with secrets and ids in values, lists and objects, fields that are named like secrets, and texts that aren't JSON."""
    value = F.element_at(F.array(F.concat(F.lit("it is Bearer  "), F.md5("text")), F.concat(F.lit("C0"), F.upper(F.substring(F.md5("text"), 1, 8))), F.lit("D0123456A"), F.md5("text")), (F.col("doc_id") % 4 + 1).cast("int"))
    secret = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("xoxb-"), "text")).otherwise(F.md5("text"))
    inner = F.struct(F.array(F.lit("plain"), secret).alias("list"), F.struct(F.lit(1).alias("a")).alias("passwordHint"), F.lit("U0ABCDEF1").alias("who"), F.col("doc_id").alias("n"))
    payload = F.to_json(F.struct(value.alias("value"), F.lit("harmless").alias("api_KEY"), F.array(inner).alias("inner")))
    loose = parsers.sanitize_json(F.when(F.col("doc_id") % 2 == 0, "sk-0123456789abc").otherwise("not JSON"))
    x = _docs(s, d).select("doc_id", parsers.sanitize_json(payload).alias("j"), F.btrim(loose, F.lit('"')).alias("loose"))
    at = lambda path: F.get_json_object("j", path)
    return x.select("doc_id", at("$.value").alias("value"), at("$.api_KEY").alias("field"), at("$.inner[0].passwordHint").alias("deep"), at("$.inner[0].list[1]").alias("listed"), at("$.inner[0].who").alias("user"), at("$.inner[0].n").cast("long").alias("number"), "loose")


@query("flt_19_unsafe", r"SELECT doc_id FROM documents WHERE doc_id % 5 IN (1, 2) OR (doc_id % 5 <> 3 AND regexp_matches(text, 'xox[baprs]-|Bearer\s+|sk-[A-Za-z0-9]{8,}|AIza[0-9A-Za-z_-]{10,}'))")
def _(s, d):
    """Of every five texts one is followed by a key, one is a workspace's id, and one an id's stand-in, which is safe."""
    k = F.col("doc_id") % 5
    value = F.when(k == 1, F.concat("text", F.lit(" AIza0123456789"))).when(k == 2, "G0ABCDEF12").when(k == 3, "U0000000SYN").otherwise(F.col("text"))
    return _docs(s, d).where(text.unsafe(value)).select("doc_id")


@query("flt_02_token_filter", f"SELECT id, count(*) AS n FROM tok WHERE term NOT IN ({', '.join(repr(w) for w in text.STOPWORDS)}) GROUP BY 1", "tok")
def _(s, d):
    return views.notes(s, d).select("id", F.explode(text.tokens(F.col("text"))).alias("t")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("flt_03_line_filter", r"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(trim(l), '(?i)^(\[?[0-9]+\]?|arxiv:|doi:|http|nat\.|nature|phys\.|science|\*|\||#)')), chr(10))) AS body FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.md5(text.clean_body(F.col("text"))).alias("body"))


@query("flt_16_exact_title", "SELECT doc_id, min(doc_id) OVER (PARTITION BY regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g')) AS first FROM documents")
def _(s, d):
    x = _docs(s, d).select("doc_id", F.sha2(text.normalize_title(F.coalesce("text", F.lit(""))), 256).alias("t"))
    return x.join(x.groupBy("t").agg(F.min("doc_id").alias("first")), "t").select("doc_id", "first")


@query("math_01_decay", "SELECT doc_id, round(pow(0.5, (doc_id % 400) / 180.0::DOUBLE), 6) AS w FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.round(numbers.decay(F.col("doc_id") % 400), 6).alias("w"))


@query("math_02_idf", "SELECT term, round(greatest(1.0::DOUBLE, ln(1000.0::DOUBLE / df) + 1), 6) AS w FROM prof", "prof")
def _(s, d):
    df = profile.document_frequency(profile.token_counts(views.notes(s, d), F.col("text"), ()))
    return df.select("term", F.round(numbers.idf(F.lit(1000.0), F.col("df")), 6).alias("w"))


@query("math_03_factors", "SELECT doc_id, 1 + least(1.0::DOUBLE, length(source) / 16) AS spec, CASE doc_id % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS rating, 1 + 0.5::DOUBLE * least(3, doc_id % 6) AS links FROM documents")
def _(s, d):
    k = F.col("doc_id")
    return _docs(s, d).select("doc_id", numbers.specificity(F.col("source")).alias("spec"), numbers.rating_factor(F.when(k % 3 == 0, "core").when(k % 3 == 1, "marginal").otherwise("useful")).alias("rating"), numbers.inlink_factor(k % 6).alias("links"))


@query("math_06_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * l_discount * 100, 0) / 100 AS v FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.half_even(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("v"))


@query("math_07_bins", "SELECT least(9, CAST(floor(p * 10) AS INT)) AS bin, count(*) AS n FROM receipts GROUP BY 1", "receipts")
def _(s, d):
    return views.receipts(s, d).groupBy(numbers.tenth(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("dt_01_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END::VARCHAR AS day FROM orders")
def _(s, d):
    raw = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" "), F.col("o_orderdate").cast("string"))).otherwise("next week")
    return table(s, d, "orders").select("o_orderkey", numbers.tolerant_date(raw).cast("string").alias("day"))


@query("dt_04_epoch", "SELECT event_id, CAST(ts AS DATE)::VARCHAR AS day FROM events")
def _(s, d):
    sec = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    return table(s, d, "events").select("event_id", numbers.epoch_date(F.concat(sec, F.lit(".000100"))).cast("string").alias("day"))


@query("dt_05_older", "SELECT event_id, TIMESTAMP '2024-02-10' >= ts + INTERVAL 30 DAY AS old, strftime(ts, '%b %-d') AS short, isodow(ts) >= 6 AS weekend FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", numbers.older_than(F.col("ts"), F.expr("TIMESTAMP_NTZ '2024-02-10'"), 30).alias("old"), numbers.short_date(F.col("ts")).alias("short"), numbers.is_weekend(F.col("ts")).alias("weekend"))


@query("map_01_get", "SELECT event_id, value / 2 AS a, 0.0::DOUBLE AS b FROM events")
def _(s, d):
    m = F.create_map(F.lit("a"), F.col("value") / 2)
    return table(s, d, "events").select("event_id", numbers.get_or(m, "a").alias("a"), numbers.get_or(m, "b").alias("b"))


# --- packing, resolution, sinks ---------------------------------------------------------------------------------------


@query("pck_02_greedy", """SELECT lang, u.used AS used, len(u.kept) AS n FROM (SELECT lang, list_reduce(list_prepend({'used': 0::BIGINT, 'kept': []::BIGINT[], 'n': 0::BIGINT, 'id': 0::BIGINT}, list({'used': 0::BIGINT, 'kept': []::BIGINT[], 'n': n_chars, 'id': doc_id} ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR))),
lambda a, x: CASE WHEN a.used + x.n <= 20000 THEN {'used': a.used + x.n, 'kept': list_append(a.kept, x.id), 'n': 0::BIGINT, 'id': 0::BIGINT} ELSE a END) AS u FROM documents GROUP BY lang)""")
def _(s, d):
    i = _docs(s, d).select("lang", F.col("doc_id").alias("id"), F.col("n_chars").alias("priority"), F.col("n_chars").alias("bytes"))
    return pack.packed(i, ["lang"], 20_000).select("lang", "used", F.size("kept").cast("long").alias("n"))


@query("pck_01_fixed", with_views("notes terms items", "").rstrip() + ", " + _arms_sql("SELECT id, coalesce(n, -1)::BIGINT AS bytes FROM sized WHERE arm = 'fixed-15/4KB'", "SELECT id, 0 AS outcome, title, substr(abstract, 1, 750) AS abstract, NULL::VARCHAR AS ends, lang, source FROM items"))
def _(s, d):
    """Every unlabelled document's state under the incumbent policy."""
    i, t = views.items(s, d).withColumn("authors", F.array("lang", "source")), _taste(s, d)
    got = pack.fixed_states(i, t.terms, t.whys, t.titles, t.directives)
    return got.select("id", F.coalesce(F.length("state"), F.lit(-1)).cast("long").alias("bytes"))


@query("json_01_bytes", "SELECT doc_id, 16 + length(lang) + length(CAST(doc_id AS VARCHAR)) AS n FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", pack.json_bytes(F.to_json(F.struct(F.col("lang").alias("b"), F.col("doc_id").alias("a")))).cast("long").alias("n"))


@query("er_01_components", "SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_custkey % 14) AS root FROM customer")
def _(s, d):
    """Every customer with a key of its own and one that a seventh share with a half: fourteen components that grow with the table."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("row"))
    shared = c.select("row", (F.lit(10**12) + F.col("row") % 7 * 3 + F.col("row") % 2).alias("key"))
    got = resolve.components(shared.unionByName(c.select("row", F.col("row").alias("key"))))
    return got.select(F.col("row").alias("node"), "root")


@query("er_01_chains", "SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_custkey // 300) AS root FROM customer")
def _(s, d):
    """Chains of 300 customers: each shares a key with the next one."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("row"))
    link = lambda k: F.lit(10**12) + k
    ahead = c.where("(row + 1) % 300 <> 0").select("row", link(F.col("row")).alias("key"))
    back = c.where("row % 300 <> 0").select("row", link(F.col("row") - 1).alias("key"))
    got = resolve.components(ahead.unionByName(back).unionByName(c.select("row", F.col("row").alias("key"))))
    return got.select(F.col("row").alias("node"), "root")


@query("er_01_dups", "SELECT doc_id AS row, min(doc_id) OVER (PARTITION BY text) AS root FROM documents")
def _(s, d):
    k = _docs(s, d).select(F.col("doc_id").alias("row"), F.md5("text").alias("h"))
    first = k.groupBy("h").agg(F.min("row").alias("root"))
    return k.join(first, "h").select("row", "root")


@query("join_18_new_works", "SELECT doc_id AS row FROM documents WHERE doc_id % 3 <> 0")
def _(s, d):
    w = _docs(s, d).select(F.col("doc_id").alias("row"), F.concat(F.lit("2601."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0")).alias("arxiv"), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"))
    known = w.where("row % 3 = 0").select(F.concat(F.lit("doi:"), "doi").alias("key"))
    return resolve.new_works(w, known).select("row")


@query("join_21_titled", "SELECT doc_id AS arxiv, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'arXiv:' || doc_id END AS title FROM documents")
def _(s, d):
    h = _docs(s, d).select(F.col("doc_id").cast("string").alias("arxiv"), F.lit("?").alias("title"))
    t = _docs(s, d).where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("arxiv"), F.col("lang").alias("title"))
    return resolve.titled(h, t).select(F.col("arxiv").cast("long").alias("arxiv"), "title")


@query("er_02_cited_by")
def _(s, d):
    """Every order as an own paper, every line as a reference to a part, every seventh part as a work that the vault has."""
    own = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("title"))
    # an order's line numbers repeat, so a reference is order, line and part; its place orders the citers too
    l = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("citer"), F.concat(F.lit("part "), "l_partkey").alias("title"), F.lit(None).cast("string").alias("arxiv"), F.concat(F.lit("10.1/"), F.col("l_partkey").cast("string")).alias("doi"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("row"))
    known = table(s, d, "part").where("p_partkey % 7 = 0").select(F.concat(F.lit("doi:10.1/"), F.col("p_partkey").cast("string")).alias("key"))
    return resolve.cited_by(own, l, known).select("root", "title", F.array_join("citers", ",").alias("citers"))


@query("snk_09_staged_notes", r"""SELECT 'paper-20261001-' || slug || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS file, md5('---' || chr(10) || 'type: paper' || chr(10) || 'status: staged' || chr(10) || 'arxiv: ' || doc_id || chr(10) || 'title: "' || title || '"' || chr(10) || 'why: "' || source || '"' || chr(10) || 'date: 2026-10-01' || chr(10) || '---' || chr(10)) AS note
FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id::VARCHAR) AS k FROM (SELECT doc_id, source, trim(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') AS slug, trim(regexp_replace(translate(text, '"\', '''/'), '\s+', ' ', 'g')) AS title FROM documents WHERE doc_id % 5 <> 0))""")
def _(s, d):
    """Whole notes, with whole texts as titles; copies of a text have equal slugs, and every document is hit twice."""
    h = _docs(s, d).select(F.col("doc_id").cast("string").alias("arxiv"), F.col("text").alias("title"), F.array("lang").alias("authors"), F.col("source").alias("why"))
    twice = h.unionByName(h.withColumn("why", F.concat("why", F.lit(" again"))))
    return sinks.staged_notes(twice, h.where("cast(arxiv AS long) % 5 = 0"), "2026-10-01").select("file", F.md5("value").alias("note"))


@query("snk_05_vault_note", """SELECT '---' || chr(10) || 'type: digest' || chr(10) || 'date: 2026-10-01' || chr(10) || 'feed: quant-ph' || chr(10) || 'mode: mode: model, full' || chr(10) || '---' || chr(10) || '# arXiv quant-ph picks — 2026-10-01' || chr(10) || chr(10) || '`mode: model, full`' || chr(10) || chr(10) ||
string_agg('- [ ] ' || title || ' — [arXiv:' || id || '](https://arxiv.org/abs/' || id || ') · ' || coalesce(terms, ''), chr(10) ORDER BY place) || chr(10) AS value FROM (SELECT p.id, terms, i.title, row_number() OVER (ORDER BY mass DESC, score DESC, p.id) AS place FROM pooled p JOIN items i ON i.id = p.id AND i.source = p.source) WHERE place <= 5""", "pooled items")
def _(s, d):
    place = F.row_number().over(Window.orderBy(F.desc("mass"), F.desc("score"), "id"))  # five picks
    p = rank.picks(_pooled(s, d)).select("id", "title", F.array_join("terms", ",").alias("why"), place.alias("place"))
    return sinks.vault_note(p.withColumn("id", F.col("id").cast("string")), "2026-10-01", "quant-ph", "mode: model, full")


@query("snk_13_upsert", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE lang END AS lang FROM documents")
def _(s, d):
    x = _docs(s, d).select("doc_id", "lang")
    return sinks.upsert(x, x.where("doc_id % 4 = 0").withColumn("lang", F.lit("new")), "doc_id")


@query("snk_17_titles", "SELECT doc_id AS arxiv, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'kept' END AS title FROM documents")
def _(s, d):
    x = _docs(s, d)
    n = x.select(F.col("doc_id").alias("arxiv"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("arXiv:"), F.col("doc_id").cast("string"))).otherwise("kept").alias("title"))
    return sinks.repaired_titles(n, x.select(F.col("doc_id").alias("arxiv"), F.col("lang").alias("title")))


# --- remote pages, small joins ----------------------------------------------------------------------------------------


def _page(body) -> list:
    return [body.alias("body"), F.lit(None).cast("string").alias("error")]


def _threads(s: SparkSession, d: str) -> DataFrame:
    """A page a conversation: its turns as a thread's messages, the last one by a bot."""
    c = table(s, d, "conversations").withColumn("ts", F.concat("conv_id", F.lit("."), "turn"))
    m = F.struct("ts", F.col("role").alias("user"), F.when(F.col("role") == "system", "B").alias("bot_id"), "text", "turn")
    return c.groupBy(F.col("conv_id").cast("string").alias("request")).agg(F.collect_list(m).alias("messages")).select("request", *_page(F.to_json(F.struct("messages"))))


@query("src_18_messages", "SELECT conv_id::VARCHAR AS request, conv_id || '.' || turn AS ts, role AS user, CASE WHEN role = 'system' THEN 'B' END AS bot_id, md5(text) AS text FROM conversations")
def _(s, d):
    return connectors.messages(_threads(s, d)).select("request", "ts", "user", "bot_id", F.md5("text").alias("text"))


@query("src_19_replies", "SELECT conv_id::VARCHAR AS parent, conv_id || '.' || turn AS ts FROM conversations WHERE turn <> 0")
def _(s, d):
    return connectors.replies(_threads(s, d), F.concat("request", F.lit(".0"))).select(F.col("request").alias("parent"), "ts")


@query("src_19_reactions", "SELECT event_id::VARCHAR AS request, event_type AS name, user_id::VARCHAR AS user FROM events WHERE event_id % 3 > 0")
def _(s, d):
    """Every third message has no reactions, and every hundredth page came as an error."""
    r = F.when(F.col("event_id") % 3 > 0, F.array(F.struct(F.col("event_type").alias("name"), F.array(F.col("user_id").cast("string")).alias("users"))))
    pages = table(s, d, "events").select(F.col("event_id").cast("string").alias("request"), *_page(F.to_json(F.struct(F.struct(r.alias("reactions")).alias("message")))))
    got = connectors.reactions(pages.unionByName(pages.limit(5).select("request", "body", F.lit("timeout").alias("error"))))
    return got.select("request", F.explode("reactions").alias("r")).select("request", "r.name", F.explode("r.users").alias("user"))


@query("src_20_metadata", "SELECT '2601.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS arxiv, lang || ' ' || source AS title, CASE WHEN doc_id % 3 > 0 THEN 'about ' || source END AS abstract FROM documents WHERE doc_id % 5 > 0")
def _(s, d):
    """Entries without a title have no row; a page that isn't XML has none."""
    k = F.col("doc_id")
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/2601."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v2</id><title>"), F.when(k % 5 > 0, F.concat("lang", F.lit("\n   "), "source")).otherwise(""), F.lit("</title><summary>"), F.when(k % 3 > 0, F.concat(F.lit(" about\n "), "source")).otherwise(" "), F.lit("</summary></entry>"))
    pages = _docs(s, d).select(F.lit("r").alias("request"), *_page(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), entry, F.lit("</feed>"))))
    return connectors.metadata(pages.unionByName(pages.limit(1).withColumn("body", F.lit("<feed"))))


@query("src_21_works", "SELECT l_orderkey::VARCHAR AS request, 'part ' || l_partkey AS title, '10.1/' || l_partkey AS doi, 'S' || l_suppkey AS authors FROM lineitem")
def _(s, d):
    paper = F.struct(F.concat(F.lit("part "), "l_partkey").alias("title"), F.struct(F.concat(F.lit("10.1/"), "l_partkey").alias("DOI")).alias("externalIds"), F.array(F.struct(F.concat(F.lit("S"), "l_suppkey").alias("name"))).alias("authors"))
    pages = table(s, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("request")).agg(F.collect_list(F.struct(paper.alias("citedPaper"))).alias("data"))
    return connectors.works(pages.select("request", *_page(F.to_json(F.struct("data"))))).select("request", "title", "doi", F.array_join("authors", ",").alias("authors"))


@query("join_14_pick_authors", "SELECT doc_id AS id, source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS authors FROM documents WHERE doc_id % 3 = 0")
def _(s, d):
    i = _docs(s, d).select(F.col("doc_id").alias("id"), "source", F.array("lang").alias("authors"))
    return rank.with_authors(i.where("id % 3 = 0").select("id", "source"), i.where("id % 2 = 0")).select("id", "source", F.array_join("authors", ",").alias("authors"))


@query("join_15_bound_receipts", "SELECT j.pos, coalesce(l.pos, -1) AS receipt_pos, coalesce(l.primitive, 'none') AS primitive FROM journal j LEFT JOIN latest l ON l.run = j.run AND l.paper = j.paper", "journal latest")
def _(s, d):
    named = lambda x: x.withColumnsRenamed({"run": "run_id", "paper": "id"})
    c = named(views.journal(s, d).select("run", "paper", F.col("pos").alias("at")))
    return scorer.bound(c, named(views.receipts(s, d))).select(F.col("at").alias("pos"), F.coalesce("receipt.pos", F.lit(-1)).alias("receipt_pos"), F.coalesce("receipt.primitive", F.lit("none")).alias("primitive"))


@query("set_06_token_set", "SELECT id, count(DISTINCT term) AS n FROM (SELECT id, term FROM tok UNION SELECT id, lang FROM notes WHERE length(lang) >= 3) GROUP BY 1", "tok")
def _(s, d):
    """Titles add their own tokens; the bodies are joined to one line, so that no line is left out as a citation."""
    n = views.notes(s, d)
    got = n.select("id", profile.token_set(F.col("lang"), F.concat(F.lit("x "), F.regexp_replace("text", r"\s+", " ")), ()).alias("t"))
    return got.where("size(t) > 0").select("id", F.size("t").cast("long").alias("n"))


@query("set_07_buckets", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'authored' ELSE 'cited' END AS kind FROM documents")
def _(s, d):
    x = _docs(s, d).select("doc_id")
    return resolve.buckets(x.where("doc_id % 2 = 0"), x.where("doc_id % 2 = 1"))


@query("prj_15_mode_line", "SELECT doc_id, 'mode: ' || lang || ', ' || source || CASE WHEN doc_id % 2 = 0 THEN ' · content: finalists' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' · fetch-warning: a; ' || lang ELSE '' END AS line, CASE doc_id % 4 WHEN 0 THEN 's' || doc_id WHEN 1 THEN lang || ':2026-01-02' ELSE 'feeds:2026-01-02' END AS seed FROM documents")
def _(s, d):
    k = F.col("doc_id")
    line = rank.mode_line(F.col("lang"), F.col("source"), F.when(k % 2 == 0, "finalists"), F.when(k % 3 == 0, F.array(F.lit("a"), "lang")).otherwise(F.array().cast("array<string>")))
    return _docs(s, d).select("doc_id", line.alias("line"), rank.seed(F.when(k % 4 == 0, F.concat(F.lit("s"), k.cast("string"))).when(k % 4 == 1, ""), F.when(k % 4 == 1, F.col("lang")).when(k % 4 == 2, ""), F.lit("2026-01-02").cast("date")).alias("seed"))


@query("flt_14_posted", "SELECT pos, posted FROM journal WHERE posted AND pos % 3 = 0 UNION ALL SELECT pos, posted FROM journal WHERE NOT posted", "journal")
def _(s, d):
    j = views.journal(s, d).withColumn("rescued", F.when(F.col("pos") % 3 == 0, "probe"))
    return review.rescued(j).select("pos", "posted").unionByName(review.posted(j, False).select("pos", "posted"))


@query("dt_03_iso", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN floor(epoch(ts))::BIGINT ELSE -1 END AS seconds, isodow(ts) = 7 AS sunday FROM events")
def _(s, d):
    """With Z, with an offset of an hour, and not a time stamp."""
    k = F.col("event_id") % 3
    z = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    hour = F.concat(F.lit(" "), F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00"))
    return table(s, d, "events").select("event_id", F.coalesce(F.unix_timestamp(numbers.iso_timestamp(F.when(k == 0, z).when(k == 1, hour).otherwise("soon"))), F.lit(-1)).alias("seconds"), numbers.is_sunday(F.col("ts")).alias("sunday"))


@query("join_08_wikilinks", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents) THEN 1 ELSE 0 END::BIGINT AS inlinks FROM documents")
def _(s, d):
    """Each odd document links the even one before it, twice and by another name too; links to itself don't exist."""
    k = F.col("doc_id")
    link = F.concat(F.lit("see [[d"), (k - 1).cast("string"), F.lit("|x]] and [[d"), (k - 1).cast("string"), F.lit("#part]] or [[none]]"))
    n = _docs(s, d).select(k.alias("id"), F.concat(F.lit("d"), k.cast("string")).alias("basename"), F.when(k % 2 == 1, link).otherwise("no link").alias("body"))
    return profile.inlinks(profile.wikilink_edges(n), n).select("id", "inlinks")


# --- files: written to the shared folder from the bundled tables, read back by the readers ---------------------------


def _written(rows: DataFrame, form: str = "text", **options) -> str:
    path = storage.folder(rows.sparkSession)
    rows.write.format(form).options(**options).save(path)
    return path


def _feed(items: DataFrame) -> str:
    """An RSS feed of documents; every fifth one's link names no paper."""
    k = F.col("doc_id")
    link = F.concat(F.lit("http://arxiv.org/"), F.when(k % 5 > 0, F.concat(F.lit("abs/2601."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v1"))).otherwise("help"))
    rows = items.select(F.concat("lang", F.lit("\n   "), "source").alias("title"), link.alias("link"), F.concat(F.lit("<p>about &amp; "), "source", F.lit("</p>")).alias("description"), F.concat(F.lit("A "), "lang", F.lit(", C D")).alias("creator"))
    return _written(rows, "xml", rowTag="item", rootTag="rss")


@query("src_01_rss", "SELECT '2601.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS id, lang || ' ' || source AS title, 'about & ' || source AS abstract, 'A ' || lang || ';C D' AS authors FROM documents WHERE doc_id % 5 > 0")
def _(s, d):
    return files.rss(s, _feed(_docs(s, d)), "q").select("id", "title", "abstract", F.array_join("authors", ";").alias("authors"))


@query("src_04_feeds", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS feed, count(*) AS items FROM documents WHERE doc_id % 5 > 0 GROUP BY 1 UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'gone', 0")
def _(s, d):
    """A feed without papers and one that can't be read don't keep the others from being read."""
    x = _docs(s, d)
    paths = {"even": _feed(x.where("doc_id % 2 = 0")), "empty": _feed(x.where("doc_id % 5 = 0")), "gone": storage.folder(s), "odd": _feed(x.where("doc_id % 2 = 1"))}
    return files.feed_health(files.feeds(s, paths), list(paths))


def _note_files(rows: DataFrame) -> str:
    """A file for each row of one text column."""
    return _written(rows, maxRecordsPerFile=1)


def _as_notes(s: SparkSession, d: str) -> list[str]:
    """Two roots: a note a nation with fields, a note a region without."""
    n = table(s, d, "nation").select(F.concat(F.lit("---\ntype: nation\nname: "), "n_name", F.lit("\nrating: "), F.col("n_regionkey").cast("string"), F.lit("\n---\nof "), F.col("n_regionkey").cast("string")))
    r = table(s, d, "region").select(F.concat(F.lit("no fields: "), "r_name"))
    return [_note_files(n), _note_files(r)]


@query("src_05_notes", "SELECT 0 AS root, 'nation' AS type, n_name AS name, 'of ' || n_regionkey || chr(10) AS body FROM nation UNION ALL SELECT 2, NULL, NULL, 'no fields: ' || r_name || chr(10) FROM region")
def _(s, d):
    """The root between the two isn't there."""
    n, r = _as_notes(s, d)
    return files.notes(s, n, storage.folder(s), r, glob="*.txt").select(F.col("root_pos").alias("root"), files.note_field("type").alias("type"), files.note_field("name").alias("name"), "body")


@query("src_07_directives", "SELECT 'be brief' AS body, 'R,S' AS labs, '' AS topics")
def _(s, d):
    """An unrelated note, then two roots with directives: the first of them counts."""
    found = [_note_files(s.range(1).select(F.lit(f"---\ntype: directives\nlabs: {labs}\n---\n be brief "))) for labs in ("[R, S]", "[T]")]
    return files.directives(s, _as_notes(s, d)[0], *found, glob="*.txt").select(F.regexp_replace("body", r"\s+$", "").alias("body"), F.array_join("labs", ",").alias("labs"), F.array_join("topics", ",").alias("topics"))


def _runs(s: SparkSession, d: str) -> DataFrame:
    c = F.struct(F.col("paper").cast("string").alias("arxiv"), F.col("lexical").alias("lexical_score"), "posted", F.col("top").alias("title"))
    return views.journal(s, d).groupBy(F.when(F.dayofmonth("run") % 2 == 0, "main").otherwise("side").alias("lane"), F.col("run").cast("string").alias("run_id")).agg(F.collect_list(c).alias("candidates"))


@query("src_08_journal", "SELECT CASE WHEN day(run) % 2 = 0 THEN 'main' ELSE 'side' END AS lane, run::VARCHAR AS run_id, paper::VARCHAR AS arxiv, lexical, posted FROM journal", "journal")
def _(s, d):
    """SNK-1 in two appends, SRC-8; a line that isn't JSON is left out."""
    path, runs = storage.folder(s), _runs(s, d)
    sinks.append_log(runs.where("lane = 'main'"), path)
    sinks.append_log(runs.where("lane = 'side'"), path)
    s.range(1).select(F.lit('{"run_id": "cut').alias("value"), F.lit("side").alias("lane")).write.mode("append").partitionBy("lane").text(f"{path}/epoch=0")
    return files.journal(s, path).select("lane", "run_id", F.explode("candidates").alias("c")).select("lane", "run_id", "c.arxiv", F.col("c.lexical_score").alias("lexical"), "c.posted")


def _appended(s: SparkSession, d: str) -> str:
    """A journal of eight appends: days whose number leaves 7 when divided by 8 came first, 0 last; days in order within one."""
    c = F.struct("pos", F.struct(F.col("paper").cast("string").alias("arxiv"), F.concat_ws(" ", "top", "pos").alias("title")).alias("c"))
    runs = views.journal(s, d).groupBy("run").agg(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["c"]).alias("candidates")).select(F.lit("main").alias("lane"), F.col("run").cast("string").alias("run_id"), "candidates", F.dayofmonth("run").alias("day"))
    path, runs = storage.folder(s), storage.saved(runs)
    for k in range(7, -1, -1):
        sinks.append_log(runs.where(F.col("day") % 8 == k).drop("day").orderBy("run_id"), path)
    return path


@query("src_24_candidate", "SELECT paper::VARCHAR AS arxiv, top || ' ' || pos AS title FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY day(run) % 8, run DESC, pos DESC) AS k FROM journal) WHERE k = 1", "journal")
def _(s, d):
    """SNK-1, SRC-24: the last append has the newest rows, whatever the run's day and the files' names are."""
    return files.candidates(files.journal(s, _appended(s, d))).select("arxiv", "title")


@query("win_08_appended_runs", "SELECT run::VARCHAR AS run, count(*) AS n FROM journal GROUP BY run, day(run) % 8 ORDER BY day(run) % 8, run DESC LIMIT 7", "journal")
def _(s, d):
    """SNK-1, WIN-8: the last seven runs of a log, by the order of appends."""
    rows = files.journal(s, _appended(s, d)).select(F.col("run_id").alias("run"), F.size("candidates").cast("long").alias("n"), "line_no")
    return calibrate.last_runs(rows, 7).select("run", "n")


@query("src_09_receipts", "SELECT 'main' AS lane, paper::VARCHAR AS paper, run::VARCHAR AS run, primitive, CASE WHEN pos % 3 = 0 THEN -1 ELSE p END::DOUBLE AS p FROM receipts", "receipts")
def _(s, d):
    """SNK-2, SRC-9: every third answer is an error."""
    r = views.receipts(s, d)
    told = F.when(F.col("pos") % 3 == 0, F.create_map(F.lit("error"), F.lit("outage"))).otherwise(F.create_map(F.lit("true"), F.col("p").cast("string")))
    rows = r.select(F.lit("main").alias("lane"), F.col("paper").cast("string").alias("candidate_arxiv"), F.col("run").cast("string").alias("run_id"), F.to_timestamp("run").alias("ts"), "primitive", F.lit(10).alias("state_bytes"),
                    told.alias("distribution"), F.lit(0.5).alias("confidence"), F.lit(1).alias("latency_ms"), F.lit("m").alias("model_version"))
    path = storage.folder(s)
    sinks.append_receipts(rows, path)
    return files.receipts(s, path).select("lane", F.col("candidate_arxiv").alias("paper"), F.col("run_id").alias("run"), "primitive", F.coalesce(F.col("distribution")["true"], F.lit(-1.0)).alias("p"))


@query("src_10_ledger", "SELECT 'main' AS lane, paper::VARCHAR AS arxiv_id, label_type FROM ledger", "ledger")
def _(s, d):
    rows = views.ledger(s, d).select(F.lit("main").alias("lane"), F.col("paper").cast("string").alias("arxiv_id"), "label_type", F.lit("cli-keep").alias("source"))
    path = storage.folder(s)
    sinks.append_log(rows, path)
    return files.ledger(s, path).select("lane", "arxiv_id", "label_type")


@query("src_11_posted", "SELECT row_number() OVER (ORDER BY odd, doc_id) - 1 AS pos, doc_id::VARCHAR AS id FROM (SELECT doc_id, doc_id % 2 AS odd FROM documents ORDER BY 2 DESC, 1 DESC LIMIT 2000)")
def _(s, d):
    """SNK-4, SRC-11: even documents' ids were posted, all are posted now; the state keeps the newest 2000."""
    x = _docs(s, d).select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"))
    path = storage.folder(s)
    old = x.where("pos % 2 = 0")
    sinks.write_posted(labels.posted_append(old.limit(0), old), path, 0, "2026-01-01T00:00:00Z")
    sinks.write_posted(labels.posted_append(old, x), path, 1, "2026-01-02T00:00:00Z")
    return files.posted(s, path).select(F.col("pos").cast("long").alias("pos"), "id")


@query("src_12_sections", "SELECT '2601.' || n_nationkey AS arxiv, n_name AS abstract, 'ends ' || n_regionkey AS conclusions FROM nation WHERE n_nationkey % 5 > 0")
def _(s, d):
    """A file for each paper; one without an id has no row."""
    arxiv = F.when(F.col("n_nationkey") % 5 > 0, F.concat(F.lit("2601."), F.col("n_nationkey").cast("string")))
    rows = table(s, d, "nation").select(arxiv.alias("arxiv"), F.col("n_name").alias("abstract"), F.concat(F.lit("ends "), F.col("n_regionkey").cast("string")).alias("conclusions"))
    return files.sections(s, _written(rows, "json", maxRecordsPerFile=1)).select("arxiv", "abstract", "conclusions")


@query("src_16_bibtex", "SELECT 'article' AS kind, p_name || ' ' || p_partkey AS title, 'Doe, J,Roe ' || p_size AS authors, CASE WHEN p_partkey % 2 = 0 THEN '2601.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') END AS arxiv, CASE WHEN p_partkey % 2 = 1 THEN '10.1000/p' || p_partkey END AS doi FROM part WHERE p_partkey % 7 > 0")
def _(s, d):
    """Entries of one part each; every seventh has no title."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    title = F.when(k % 7 > 0, F.concat(F.lit("  title = {"), "p_name", F.lit(" {"), key, F.lit("}},\n"))).otherwise("")
    ident = F.when(k % 2 == 0, F.concat(F.lit("  eprint = {2601."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("}\n}"))).otherwise(F.concat(F.lit('  doi = "https://doi.org/10.1000/p'), key, F.lit('"\n}')))
    rows = table(s, d, "part").select(F.concat(F.lit("@Article{p"), key, F.lit(",\n"), title, F.lit("  author = {Doe, J and Roe "), F.col("p_size").cast("string"), F.lit("},\n"), ident))
    return files.bibtex(s, _written(rows)).select("kind", "title", F.array_join("authors", ",").alias("authors"), "arxiv", "doi")


@query("src_23_proposals", "SELECT '2601.' || n_nationkey AS arxiv, n_name AS rating, n_nationkey / 32.0::DOUBLE AS confidence FROM nation")
def _(s, d):
    p = F.struct(F.col("n_name").alias("rating"), (F.col("n_nationkey") / 32).alias("confidence"))
    whole = table(s, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("2601."), F.col("n_nationkey").cast("string")), p))).alias("m"))
    return files.proposals(s, _written(whole.select(F.to_json("m")).coalesce(1))).select("arxiv", "rating", "confidence")


@query("src_25_users", "SELECT 'U' || n_nationkey AS user, n_name AS name FROM nation")
def _(s, d):
    whole = table(s, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("U"), F.col("n_nationkey").cast("string")), "n_name"))).alias("m"))
    return files.users(s, _written(whole.select(F.to_json("m")).coalesce(1)))


@query("snk_07_digest", "SELECT '*arXiv q picks for 2026-01-02* (' || count(*) || ')' || chr(10) || '_m_' || chr(10) || string_agg((n_nationkey + 1) || '. <http://arxiv.org/abs/' || n_nationkey || '|' || n_name || '>' || chr(10) || '   _why:_ ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS value FROM nation")
def _(s, d):
    p = table(s, d, "nation").select((F.col("n_nationkey") + 1).alias("place"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("string").alias("why"))
    return sinks.digest_text(p, "2026-01-02", "q", "m")
