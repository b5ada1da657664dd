"""Query interpretation, retrieval, fan-out and interleaving. Many queries at once, keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import lexicon as L
from ..functions import text as T
from ..tables import sized

#: Sources or other small tables up to this number of rows are broadcast; with more, Spark joins without.
BROADCAST_ROWS = 10_000


def identifier(x: Column) -> Column:
    """struct(kind, value) of the identifier that a whole input is, or null."""
    doi = T.normalize_doi(x)
    single = ~F.trim(x).rlike(r"\s")
    arxiv_url = F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"(?i)arxiv\.org/(?:abs|pdf)/([^\s?#]+)", 1), r"\.pdf$", ""), r"(?i)v\d+$", "")
    pubmed_url = F.regexp_extract(x, r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", 1)
    packed = F.when(F.lower(x).rlike("^(arxiv:|pmid)"), F.replace(x, F.lit(" "), F.lit(""))).otherwise(x)
    new = F.regexp_extract(packed, r"(?i)^(?:arxiv:)?(\d{4}\.\d{4,5})(?:v\d+)?$", 1)
    old = F.regexp_extract(packed, r"(?i)^(?:arxiv:)?([a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?$", 1)
    pmid = F.regexp_extract(packed, r"(?i)^(?:pmid:?\s*)?(\d{1,8})$", 1)
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return (
        F.when(doi.isNotNull() & single, one("doi", doi))
        .when(arxiv_url != "", one("arxiv", arxiv_url))
        .when(pubmed_url != "", one("pmid", pubmed_url))
        .when(new != "", one("arxiv", new))
        .when(old != "", one("arxiv", old))
        .when(pmid != "", one("pmid", pmid))
    )


def keyword_tokens(x: Column) -> Column:
    """The words of a text that may be keywords, in order."""
    found = F.transform(F.regexp_extract_all(x, F.lit(f"({L.KEYWORD})"), 1), lambda w: F.regexp_replace(F.lower(w), "^-+|-+$", ""))
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(L.QUERY_STOPWORDS))


def keywords(queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, kw_rank and keyword: by frequency, then first place. Needs query_id and raw."""
    placed = queries.select("query_id", F.posexplode(keyword_tokens(F.col("raw"))).alias("at", "keyword"))
    counted = placed.groupBy("query_id", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "first")
    return counted.withColumn("kw_rank", F.row_number().over(order)).where(F.col("kw_rank") <= limit).select("query_id", "kw_rank", "keyword")


def parse(queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Queries (query_id, raw) with intent, search terms, identifier and keywords; blank ones are left out."""
    clean = queries.select("query_id", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw")).where("raw <> ''")
    found = keywords(clean).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("kw_rank", "keyword"))).alias("found"))
    words = F.split("raw", r"\s+")
    met = clean.join(found, "query_id", "left").withColumn("i", identifier(F.col("raw"))).withColumn("k", F.coalesce(F.transform("found", lambda s: s["keyword"]), F.array().cast("array<string>")))
    intent = (
        F.when(F.col("i").isNotNull(), "identifier").when(F.size(words) > settings.snippet_words, "abstract_snippet")
        .when(F.size(words) <= settings.keyword_words, "keyword").otherwise("topic")
    )
    met = met.withColumn("intent", intent)
    fallback = F.when((F.size("k") == 0) & (F.col("intent") != "abstract_snippet"), F.transform(words, F.lower)).otherwise(F.col("k"))
    terms = F.when(F.col("intent") == "identifier", F.col("i.value")).when(F.col("intent") == "abstract_snippet", F.array_join("k", " ")).otherwise(F.col("raw"))
    return met.select(
        "query_id", "raw", "intent", terms.alias("search_terms"), F.col("i.kind").alias("identifier_kind"), F.col("i.value").alias("identifier"),
        F.when(F.col("intent") == "identifier", F.array("i.value")).otherwise(fallback).alias("keywords"),
    )


def strict_term(k: Column, raw: Column, most: int = 8) -> Column:
    return F.when(F.size(k) > 0, F.array_join(F.slice(k, 1, most), " AND ")).otherwise(raw)


def relaxed_term(k: Column, most: int = 5) -> Column:
    return F.when(F.size(k) >= 2, F.array_join(F.slice(k, 1, most), " OR "))


def field_query(terms: Column, operator: str = "AND", most: int = 12) -> Column:
    """all:"t" for each word, joined by the operator; blank terms ask for everything."""
    words = F.filter(F.split(F.trim(terms), r"(?U)\s+"), lambda t: t != "")
    clean = F.filter(F.transform(F.slice(words, 1, most), lambda t: F.translate(t, '"\\', "")), lambda t: t != "")
    return F.when(F.size(words) == 0, F.lit("all:*")).otherwise(F.array_join(F.transform(clean, lambda t: F.concat(F.lit('all:"'), t, F.lit('"'))), f" {operator} "))


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, source and each distinct keyword-shaped word of a text. Needs doc_id, source and text."""
    return docs.select("doc_id", "source", F.explode(F.array_distinct(keyword_tokens(F.col("text")))).alias("keyword"))


def retrieve(terms: DataFrame, docs: DataFrame, strict: int = 8, relaxed: int = 5) -> DataFrame:
    """query_id, source, doc_id, hits and mode: documents with all of a query's first `strict` keywords; in sources
    that have none, with any of the first `relaxed`. terms: query_id, kw_rank, keyword."""
    asked = terms.where(F.col("kw_rank") <= strict)
    wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    met = postings(docs).join(asked, "keyword").groupBy("query_id", "source", "doc_id")
    met = met.agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("kw_rank") <= relaxed).alias("any_hits")).join(wanted, "query_id")
    every = met.where("hits = wanted").select("query_id", "source", "doc_id", "hits", F.lit("and").alias("mode"))
    some = met.where("any_hits > 0 and wanted >= 2").join(every.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")
    return every.unionByName(some.select("query_id", "source", "doc_id", F.col("any_hits").alias("hits"), F.lit("or").alias("mode")))


def limit_per_source(found: DataFrame, limit: int) -> DataFrame:
    """The first rows of each query and source, by hits and then doc_id, with their place `pos` (from 1)."""
    order = Window.partitionBy("query_id", "source").orderBy(F.desc("hits"), "doc_id")
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def interleave(found: DataFrame, order: Column) -> DataFrame:
    """Round robin over a query's sources: by place in the source, then by the source's order."""
    turn = Window.partitionBy("query_id").orderBy("pos", order)
    return found.withColumn("merged_pos", F.row_number().over(turn))


def dispatch(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, source, action and argument: searches go to all sources, identifiers where they can be looked up.

    sources: source, has_doi, has_arxiv, has_pmid."""
    both = parsed.crossJoin(sized(sources, BROADCAST_ROWS))
    arxiv_doi = F.concat(F.lit("10.48550/arxiv."), F.col("identifier"))
    action = (
        F.when(F.col("intent") != "identifier", F.lit("search"))
        .when((F.col("identifier_kind") == "doi") & F.col("has_doi"), F.lit("by_doi"))
        .when((F.col("identifier_kind") == "arxiv") & F.col("has_arxiv"), F.lit("by_arxiv_id"))
        .when((F.col("identifier_kind") == "arxiv") & F.col("has_doi"), F.lit("by_doi"))
        .when((F.col("identifier_kind") == "pmid") & F.col("has_pmid"), F.lit("by_pmid"))
        .otherwise(F.lit("skipped"))
    )
    argument = F.when((F.col("identifier_kind") == "arxiv") & (action == "by_doi"), arxiv_doi).otherwise(F.col("search_terms"))
    return both.select("query_id", "source", action.alias("action"), argument.alias("argument"))


def source_reports(asked: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, source, status and returned for every (query_id, source) asked; failures come from the readers."""
    counts = found.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("returned"))
    met = asked.join(counts, ["query_id", "source"], "left").withColumn("returned", F.coalesce("returned", F.lit(0)).cast("int"))
    return met.withColumn("status", F.when(F.col("returned") > 0, "ok").otherwise("empty"))


def degraded(reports: DataFrame) -> DataFrame:
    """query_id and whether any of its sources failed."""
    failed = ~F.col("status").isin("ok", "empty", "skipped")
    return reports.groupBy("query_id").agg(F.bool_or(failed).alias("degraded"))


def summary_line(reports: DataFrame) -> DataFrame:
    """query_id and `source=status(n), …` in source order."""
    one = F.struct("source", F.concat("source", F.lit("="), "status", F.lit("("), F.col("returned").cast("string"), F.lit(")")).alias("said"))
    return reports.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["said"]), ", ").alias("line"))


def rate_limited_starts(requests: DataFrame, interval: float, key: str = "source", at: str = "ts") -> DataFrame:
    """When each request may start if those of a key stand at least `interval` seconds apart, in order of arrival.

    requests: the key, an id and `at` in seconds. start(n) = max over i <= n of at(i) + (n - i) * interval."""
    order = Window.partitionBy(key).orderBy(at, "id")
    step = F.col("_n") * F.lit(float(interval))
    numbered = requests.withColumn("_n", F.row_number().over(order)).withColumn("_spaced", F.col(at) - step)
    latest = F.max("_spaced").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("start_at", latest + step).drop("_n", "_spaced")


def backoff(attempt: Column) -> Column:
    """Seconds before a retry, without the random part."""
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(4.0))


def retry_after(x: Column) -> Column:
    """A Retry-After header in seconds, within 0 and 10; null if it's no number."""
    return F.least(F.greatest(F.trim(x).try_cast("double"), F.lit(0.0)), F.lit(10.0))
