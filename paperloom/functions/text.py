"""Scalar text functions, columns in and columns out; no I/O."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import lexicon as L

ASCII = r"^[\x00-\x7F]*$"


def words_in(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def collapse_whitespace(x: Column) -> Column:
    """Runs of white space become one blank; blank texts null."""
    return F.nullif(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""))


def strip_markup(x: Column) -> Column:
    """Tags become blanks, then seven entities are decoded in order, then white space collapses."""
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for entity, char in L.ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return collapse_whitespace(x)


def normalize_doi(x: Column) -> Column:
    """The bare lower-case DOI in a text, or null."""
    bare = F.trim(x)
    for prefix in reversed(L.DOI_PREFIXES):
        bare = F.when(F.lower(F.trim(x)).startswith(prefix), F.substring(F.trim(x), F.lit(len(prefix) + 1), F.length(x))).otherwise(bare)
    found = F.nullif(F.regexp_extract(bare, f"({L.DOI})", 1), F.lit(""))
    return F.lower(F.regexp_replace(found, r"[.,;)]+$", ""))


@pandas_udf(StringType())
def _unaccented(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no such function."""
    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def unaccented(x: Column) -> Column:
    """ASCII rows stay in the JVM; the UDF sees nulls in their place."""
    plain = x.rlike(ASCII)
    return F.when(plain, x).otherwise(_unaccented(F.when(~plain, x)))


def normalize_title(x: Column) -> Column:
    """The comparison key of a title: unaccented, lower case, letters and digits."""
    folded = F.regexp_replace(F.lower(unaccented(x)), "[^a-z0-9 ]+", " ")
    return F.coalesce(F.trim(F.regexp_replace(folded, r"(?U)\s+", " ")), F.lit(""))


def ascii_fold(x: Column) -> Column:
    return F.regexp_replace(unaccented(x), r"[^\x00-\x7F]", "")


def truncate(x: Column, limit: int, suffix: str = "…") -> Column:
    """Cut at the last blank before the limit."""
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(F.left(x, F.lit(limit)), "(?s) [^ ]*$", ""), F.lit(suffix)))


def tokens(x: Column) -> Column:
    """Lower-case words of two and more signs but for closed-class ones."""
    found = F.regexp_extract_all(F.lower(x), F.lit(f"({L.TOKEN})"), 1)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(L.RANKING_STOPWORDS))


def pairs(t: Column, sign: str = "_") -> Column:
    """Neighbours of an array, joined."""
    n = F.size(t)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(sign), b))
    )


def content_words(x: Column) -> Column:
    found = F.regexp_extract_all(F.lower(x), F.lit(f"({L.TOKEN})"), 1)
    return F.array_except(F.filter(found, lambda t: F.length(t) > 2), words_in(L.RANKING_STOPWORDS))


def document_text(title: Column, abstract: Column, keywords: Column, journal: Column) -> Column:
    """The title twice, then the abstract, or keywords and journal where there is none."""
    some = F.coalesce(abstract, F.lit("")) != ""
    rest = F.when(some, F.array(abstract)).otherwise(F.concat(F.coalesce(keywords, F.array().cast("array<string>")), F.array(journal)))
    parts = F.concat(F.array(title, title), rest)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def normalize_number(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, ",% ", ""), r"\.+$", "")


def numbers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({L.NUMBER})"), 1)


def count_sentences(x: Column) -> Column:
    for a in L.COUNT_ABBREVIATIONS:
        x = F.replace(x, F.lit(a), F.lit(a.replace(".", "")))
    return F.size(F.filter(F.split(x, r"[.!?](?:\s|$)"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != ""))


def split_sentences(x: Column) -> Column:
    for a in L.SPLIT_ABBREVIATIONS:
        x = F.replace(x, F.lit(a), F.lit(a.replace(".", "\x00")))
    parts = F.transform(F.split(_stripped(x), r"(?<=[.!?])\s+(?=[A-Z(])"), lambda p: _stripped(F.replace(p, F.lit("\x00"), F.lit("."))))
    return F.filter(parts, lambda p: p != "")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def abstract_sentences(x: Column) -> Column:
    """Sentences without guards for abbreviations, less stacked section labels before them."""
    label = L.SECTION_PREFIX[1:]
    parts = F.split(_stripped(x), r"(?<=[.!?])\s+(?=[A-Z(])")
    return F.filter(F.transform(parts, lambda p: _stripped(F.regexp_replace(_stripped(p), f"^(?:{label})+", ""))), lambda p: p != "")


def strip_markdown(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?m)^\s*(?:[-*+]\s+|#{1,6}\s+|>\s+)", "")
    x = F.regexp_replace(x, r"(?s)\*{1,3}(?=\S)(.+?)(?<=\S)\*{1,3}", "$1")
    x = F.regexp_replace(x, r"(?s)`{1,3}(?=\S)(.+?)(?<=\S)`{1,3}", "$1")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def reconstruct_abstract(index: Column) -> Column:
    """The text of an inverted index, map<string, array<int>>: words by position, the last writer of one wins."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("w")))))
    ordered = F.array_sort(F.filter(placed, lambda p: p["at"].isNotNull()))
    return F.nullif(F.array_join(F.transform(ordered, lambda p: p["w"]), " "), F.lit(""))


def reconstruct_json_abstract(payload: Column) -> Column:
    """As reconstruct_abstract() of a JSON object; values that aren't arrays of integers are skipped one by one."""
    entries = F.from_json(payload, "map<string,string>")
    typed = F.transform_values(F.map_filter(entries, lambda _, v: v.startswith("[")), lambda _, v: F.from_json(v, "array<int>"))
    return reconstruct_abstract(typed)


def safe_stem(x: Column) -> Column:
    """A file name's stem: letters, digits and -_. alone, up to 80."""
    clean = F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}\-_.]", "-"), r"^[-.]+|[-.]+$", "")
    return F.left(clean, F.lit(80))


def paper_id(doi: Column, source: Column, source_id: Column) -> Column:
    local = F.concat(source, F.lit(":"), F.left(F.sha1(F.concat_ws(":", source, source_id)), F.lit(16)))
    return F.coalesce(F.concat(F.lit("doi:"), doi), local)


def fingerprint(title: Column, abstract: Column) -> Column:
    return F.left(F.sha1(F.concat(title, F.lit("\x00"), F.coalesce(abstract, F.lit("")))), F.lit(16))


def format_authors(names: Column, limit: int = 3) -> Column:
    more = F.size(names) - limit
    head = F.array_join(F.slice(names, 1, limit), ", ")
    return F.when(more > 0, F.concat(head, F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(head)


def format_date(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "MMM yyyy"), F.lit("no date"))


def initials(given: Column, dot: str, between: str) -> Column:
    parts = F.filter(F.split(F.trim(given), r"\s+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.left(p, F.lit(1)), F.lit(dot))), between)


def author_from_parts(given: Column, family: Column) -> Column:
    """name, given and family of an author; null where both are blank."""
    g, f = F.nullif(F.trim(given), F.lit("")), F.nullif(F.trim(family), F.lit(""))
    name = F.nullif(F.concat_ws(" ", g, f), F.lit(""))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), g.alias("given"), f.alias("family")))


def author_from_display(name: Column) -> Column:
    """A display name split at its last blank; a single word is a family name."""
    clean = collapse_whitespace(name)
    given = F.nullif(F.regexp_extract(clean, "^(.*) ([^ ]+)$", 1), F.lit(""))
    family = F.when(given.isNotNull(), F.regexp_extract(clean, "^(.*) ([^ ]+)$", 2)).otherwise(clean)
    return F.when(clean.isNotNull(), F.struct(clean.alias("name"), given.alias("given"), family.alias("family")))


def completeness(p: str = "") -> Column:
    """How much of a record is filled: 10 abstract, 4 DOI, 3 authors, 2 date, 1 each journal, PDF, keywords."""
    c = lambda name: F.col(p + name)
    filled = [
        (F.length(F.trim(c("abstract"))) > 0, 10), (c("doi").isNotNull(), 4), (F.size("authors") > 0 if not p else F.size(c("authors")) > 0, 3),
        (c("published_date").isNotNull(), 2), (c("journal").isNotNull(), 1), (c("pdf_url").isNotNull(), 1), (F.size(c("keywords")) > 0, 1),
    ]
    return sum((F.when(F.coalesce(test, F.lit(False)), n).otherwise(0) for test, n in filled), F.lit(0))


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """A date of text parts: months by number, name or season, 1 by default, days clamped to 28."""
    table = F.create_map(*[F.lit(x) for n, m in enumerate(L.MONTHS, 1) for x in (m, n)])
    seasons = F.create_map(*[F.lit(x) for kv in L.SEASONS.items() for x in kv])
    token = F.lower(F.trim(month))
    number = F.coalesce(F.when(token.rlike("^[0-9]+$"), F.expr("cast(null as int)")), F.try_element_at(table, F.left(token, F.lit(3))), F.try_element_at(seasons, token))
    number = F.coalesce(F.when(token.rlike("^[0-9]{1,9}$"), token.try_cast("int")), number, F.lit(1))
    d = F.coalesce(F.when(F.trim(day).rlike("^[0-9]{1,9}$"), F.trim(day).try_cast("int")), F.lit(1))
    y = F.when(F.trim(year).rlike("^[0-9]{1,4}$"), F.trim(year).try_cast("int"))
    return F.when(y >= 1, F.make_date(y, F.least(F.greatest(number, F.lit(1)), F.lit(12)), F.least(F.greatest(d, F.lit(1)), F.lit(28))))
