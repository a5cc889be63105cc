"""String functions as columns: tokens, ids, titles, names, sections (STR-1 to STR-24)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that never become taste.
STOPWORDS = tuple("""
the and for with that this from are was were has have had not but its into about over under between through which their
these those such than then them they our one two can may also more most other paper note using based synthetic benchmark
abstract summary citation exercise exercises fixture deliberately via while all when just must both each give gives new
any many only how use way here still first type study provides shows show including among even within important requires
require general complete method methods approach approaches results result existing setting natural standard previous
work time length small large high low number numbers order key makes make tools address space present turn run against
across during longer family sets ability side probability scheme manner after version measured matching property
properties analogue until since because without instead toward towards well once whether where would could should does
did done being been very same later back own part parts what why there thus hence however
""".split())
#: Signs trimmed from a token's ends; lines that cite or structure rather than say.
TRIM = ".,;:!?()[]{}\"'"
CITATION_LINE = r"(?i)^(\[?[0-9]+\]?|arxiv:|doi:|http|nat\.|nature|phys\.|science|\*|\||#)"
ARXIV_FORM = r"(?i)^(?:arxiv:)?([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})(v[0-9]+)?$"
ARXIV_TEXT = r"(?i)(?:arxiv[:\s/]*|abs/)([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})"
WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"


def count_matches(text: Column, term: Column) -> Column:
    """STR-1: places where term stands between characters other than a-z, 0-9 and "-" (each boundary is used up by one match)."""
    pattern = F.concat(F.lit(r"(^|[^a-z0-9-])\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E([^a-z0-9-]|$)"))
    return F.regexp_count(text, pattern)


def tokens(text: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """STR-2, FLT-2: lower-case words of three letters or digits at least that aren't stop words."""
    words = F.transform(F.split(F.replace(F.lower(text), F.lit("|"), F.lit(" ")), r"(?U)\s+"), lambda t: F.btrim(t, F.lit(TRIM)))
    kept = F.filter(words, lambda t: (F.length(t) >= 3) & t.rlike(r"^[\p{L}\p{N}]+$"))
    return F.filter(kept, lambda t: ~t.isin(*stop)) if stop else kept


def runs(text: Column) -> Column:
    """Distinct runs of a-z, 0-9 and "-": what count_matches can match at."""
    return F.array_remove(F.array_distinct(F.split(text, "[^a-z0-9-]+")), "")


def clean_body(body: Column) -> Column:
    """FLT-3: body without citation and scaffold lines."""
    return F.array_join(F.filter(F.split(body, "\n"), lambda x: ~F.trim(x).rlike(CITATION_LINE)), "\n")


def strip_tags(html: Column) -> Column:
    """STR-3: common entities resolved, tags replaced by a space, ends trimmed."""
    out = html
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, "<[^>]*>", " "))


def split_names(blob: Column) -> Column:
    """STR-4: an author blob split at commas and "and"."""
    parts = F.transform(F.split(blob, r",\s*|\s+and\s+"), lambda x: F.trim(F.regexp_replace(x, r"^\s*and\s+", "")))
    return F.array_remove(parts, "")


def arxiv_in(text: Column) -> Column:
    """STR-5: the first id in a link or text, null if there is none."""
    found = F.regexp_extract(text, ARXIV_TEXT, 1)
    return F.when(found != "", F.lower(found))


def normalize_arxiv(value: Column) -> Column:
    """STR-6: id without prefix and version, lower-case; other values only trimmed."""
    t = F.trim(value)
    found = F.regexp_extract(t, ARXIV_FORM, 1)
    return F.when(found != "", F.lower(found)).otherwise(t)


def normalize_doi(value: Column) -> Column:
    """STR-7: DOI without resolver or prefix, lower-case; null if empty."""
    out = F.lower(F.trim(F.regexp_replace(F.trim(value), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", "")))
    return F.when(out != "", out)


def arxiv_of_doi(doi: Column) -> Column:
    """The arXiv id that an arXiv DOI stands for."""
    return F.when(F.lower(doi).startswith("10.48550/arxiv."), F.substring(F.lower(doi), 16, 200))


def normalize_title(title: Column) -> Column:
    """STR-8, FLT-16: letters and digits only."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")


def slug(title: Column, cap: int = 40) -> Column:
    """STR-9."""
    return F.btrim(F.substring(F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-")), 1, cap), F.lit("-"))


@F.pandas_udf(T.StringType())
def fold_accents(names: pd.Series) -> pd.Series:
    """STR-10: compatibility decomposition without combining marks (Spark has no such function)."""
    return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def name_parts(name: Column) -> Column:
    """Lower-case parts of a name, dots as spaces."""
    return F.array_remove(F.split(F.trim(F.replace(F.lower(name), F.lit("."), F.lit(" "))), r"\s+"), "")


def split_group(entry: Column) -> tuple[Column, Column]:
    """STR-11: ("Name", "Group" or null) of "Name — Group"."""
    group = F.trim(F.split_part(entry, F.lit(" — "), F.lit(2)))
    return F.trim(F.split_part(entry, F.lit(" — "), F.lit(1))), F.when(group != "", group)


def wikilinks(body: Column) -> Column:
    """STR-12: distinct link targets, alias and heading dropped."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x)))


def collapse(text: Column) -> Column:
    """STR-14."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def abstract_section(text: Column, cap: int = 400) -> Column:
    """STR-15: what follows an abstract heading up to the introduction; null if there is none."""
    head = r"(?im)^[ \t]*abstract[ \t]*(?:[:.\-—]?[ \t]*$|[:.\-—][ \t]*)"
    rest = F.get(F.split(text, head, 2), 1)
    body = F.substring(collapse(F.get(F.split(rest, r"(?im)^[ \t]*(?:\(?[0-9]+[.)]?[ \t]+)?introduction\b", 2), 0)), 1, cap)
    return F.when(body != "", body)


def conclusions_section(text: Column, cap: int = 450) -> Column:
    """STR-16, FLT-18: the first section under a closing heading with 40 characters at least, up to the references."""
    number = r"(?:\(?[0-9]+[.)]?[ \t]*|[IVX]+\.?[ \t]*|•[ \t]*)?"
    head = rf"(?im)^[ \t]*{number}(?:conclusions?|concluding remarks|summary[ \t]+and[ \t]+outlook|summary|outlook|discussion|perspectives?)[ \t]*[:.\-—]?[ \t]*$"
    stop = rf"(?im)^[ \t]*{number}(?:references|acknowledge?ments?|appendix|bibliography|supplementary)\b"
    parts = F.split(text, head)
    # a heading's body runs over later headings of the same kind to the end mark
    bodies = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: collapse(F.get(F.split(F.array_join(F.slice(parts, i, F.greatest(F.size(parts) - i + 1, F.lit(0))), " "), stop, 2), 0)))
    return F.when(F.size(parts) > 1, F.substring(F.get(F.filter(bodies, lambda x: F.length(x) >= 40), 0), 1, cap))


def who_line(authors: Column, hits: Column, affiliations: Column, more: Column) -> Column:
    """STR-19: three authors and "+N", starred hits (name, group), affiliations."""
    star = lambda h: F.concat(F.lit("⭐ "), h["name"], F.coalesce(F.concat(F.lit(" ("), h["group"], F.lit(")")), F.lit("")))
    first = F.slice(authors, 1, 3)
    shown = F.transform(first, lambda a: F.coalesce(F.get(F.transform(F.filter(hits, lambda h: h["name"] == a), star), 0), a))
    extra = F.transform(F.filter(hits, lambda h: ~F.array_contains(first, h["name"])), star)
    return F.concat(F.array_join(shown, ", "), F.when(F.size(authors) > 3, F.concat(F.lit(" +"), F.size(authors) - 3)).otherwise(""), F.when(F.size(extra) > 0, F.concat(F.lit(" — "), F.array_join(extra, ", "))).otherwise(""),
                    F.when(F.size(affiliations) > 0, F.concat(F.lit(" · "), F.array_join(affiliations, ", "), F.when(more > 0, F.concat(F.lit(" +"), more)).otherwise(""))).otherwise(""))


def why_line(terms: Column, score: Column, rescued: Column, mass: Column, style: str = "terms") -> Column:
    """STR-20."""
    shown = F.array_join(F.transform(F.slice(terms, 1, 5), lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", ")
    number = F.concat(F.lit("(score "), score.cast("string"), F.lit(")"))
    base = F.when(F.size(terms) > 0, F.concat(shown, F.lit(" "), number)).otherwise("(no terms)")
    if style == "opaque":
        base = F.concat(F.lit("profile match "), number)
    elif style != "terms":
        base = F.concat(F.lit("score "), score.cast("string"))
    p = F.format_string("%.2f", mass)
    return (F.when(rescued == "probe", F.concat(F.lit("rescued by probe — no lexical match, relevance p="), p)).when((mass > 0) & (F.size(terms) == 0), F.concat(F.lit("picked by the model — no lexical match, relevance p="), p))
            .when(rescued == "near-miss", F.concat(F.lit("rescued by near-miss match · "), base)).otherwise(base))


def mrkdwn(text: Column) -> Column:
    """STR-21: characters that a chat's markup gives a meaning."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def yaml_scalar(text: Column) -> Column:
    """STR-22: one line without quotes or backslashes."""
    return collapse(F.translate(text, '"\\', "'/"))


#: Shapes of secrets and of workspace ids.
SECRET_VALUE = r"xox[baprs]-|Bearer\s+|sk-[A-Za-z0-9]{8,}|AIza[0-9A-Za-z_-]{10,}"
SECRET_FIELD = r"(?i)key|token|secret|password"
WORKSPACE_ID = r"^[CUGDWT]0[0-9A-Z]{6,}$"
#: What stands for them.
SECRET_STAND_IN, FIELD_STAND_IN = "<sanitized-secret>", "<dropped-secret>"
ID_STAND_INS, OTHER_STAND_IN = {"C": "C0000000SYN", "U": "U0000000SYN"}, "X0000000SYN"


def sanitize(value: Column) -> Column:
    """STR-23: a secret or an id replaced by a stand-in."""
    id_ = F.when(value.startswith("C"), "C0000000SYN").when(value.startswith("U"), "U0000000SYN").otherwise("X0000000SYN")
    return F.when(value.rlike(SECRET_VALUE), "<sanitized-secret>").when(value.rlike(WORKSPACE_ID), id_).otherwise(value)


def unsafe(value: Column) -> Column:
    """FLT-19: true where a value still looks like a secret or an id."""
    return value.rlike(SECRET_VALUE) | (value.rlike(WORKSPACE_ID) & ~value.endswith("SYN"))
