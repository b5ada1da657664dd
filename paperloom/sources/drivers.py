"""The three searches, over any way to fetch: a strict request for each query, and a relaxed one where that found nothing.

A fetch is a function from (query_id, url) to (query_id, status, payload), such as over_http(). What it gives is
kept, so that no request is sent twice. Each search gives papers and reports (query_id, source, status, returned);
status is ok, empty, parse_error, or why the last request failed (timeout, rate_limited, not_found, unavailable)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import lexicon as L
from ..operators import query
from ..tables import keep
from . import http, records

Fetch = Callable[[DataFrame], DataFrame]

ARXIV = "https://export.arxiv.org/api/query?sortBy=relevance&sortOrder=descending&start=0"
EUTILS = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
WORKS = "https://api.crossref.org/works?sort=relevance&order=desc"
#: The columns of a work that the reader reads.
WORK_FIELDS = "DOI title author abstract issued published-print published-online created container-title URL type publisher volume issue page subject is-referenced-by-count link".split()


def over_http(interval: float, settings: Settings = DEFAULTS) -> Fetch:
    """Requests one after another, `interval` seconds apart, from one task, so that a host's limit holds. What doesn't
    begin within source_budget seconds is a timeout."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spacer, began = http.Spacer(interval), time.monotonic()
        for part in batches:
            got = []
            for url in part["url"]:
                if time.monotonic() - began > settings.source_budget:
                    got.append(("timeout", None))
                    continue
                spacer.wait()
                got.append(http.fetch(url, settings))
            yield pd.DataFrame({"query_id": part["query_id"], "status": [s for s, _ in got], "payload": [p for _, p in got]})

    def fetch(asked: DataFrame) -> DataFrame:
        kind = asked.schema["query_id"].dataType.simpleString()
        return asked.select("query_id", "url").coalesce(1).mapInPandas(ask, f"query_id {kind}, status string, payload string")

    return fetch


def _url(base: str, **parts: Column | str | int) -> Column:
    sign = "&" if "?" in base else "?"
    return F.concat(F.lit(base + sign), *[F.concat(F.lit(("&" if n else "") + name.replace("__", ".") + "="), F.url_encode(v if isinstance(v, Column) else F.lit(str(v)))) for n, (name, v) in enumerate(parts.items())])


def _relaxed(strict: DataFrame, relaxed: DataFrame, fetch: Fetch, found: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What `found` reads of the payloads, and (query_id, status) of each query's last request. Queries whose strict
    request went well and found nothing are asked again as `relaxed` (query_id, url) says, if it does."""
    first = keep(fetch(strict), "payloads")
    met = keep(found(first.where("status = 'ok'")), "found")
    none = first.where("status = 'ok'").join(met.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    again = keep(fetch(relaxed.where("url is not null").join(none, "query_id", "left_semi")), "payloads")
    more = keep(found(again.where("status = 'ok'")), "found")
    status = first.select("query_id", "status").join(again.select("query_id", F.col("status").alias("last")), "query_id", "left")
    return met.unionByName(more), status.select("query_id", F.coalesce("last", "status").alias("status"))


def _reports(status: DataFrame, papers: DataFrame, source: str, broken: DataFrame | None = None) -> DataFrame:
    counts = papers.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("returned"))
    met = status.join(counts, "query_id", "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    if broken is not None:
        met = met.join(broken.select("query_id", F.lit(True).alias("broken")).distinct(), "query_id", "left")
    said = F.when(F.col("returned") > 0, "ok").when(F.col("status") != "ok", F.col("status"))
    said = said.when(F.coalesce("broken", F.lit(False)), "parse_error") if broken is not None else said
    return met.select("query_id", F.lit(source).alias("source"), said.otherwise("empty").alias("status"), "returned")


def arxiv(parsed: DataFrame, fetch: Fetch, limit: int = DEFAULTS.limit_per_source) -> tuple[DataFrame, DataFrame]:
    """All words of the search terms, else any of them. parsed: query_id, search_terms."""
    terms = F.col("search_terms")
    asked = lambda operator: parsed.select("query_id", _url(ARXIV, search_query=query.field_query(terms, operator), max_results=limit).alias("url"), terms.alias("terms"))
    several = asked("OR").where(F.size(F.split(F.trim("terms"), r"\s+")) > 1)
    seen: list[DataFrame] = []

    def read(payloads: DataFrame) -> DataFrame:
        seen.append(payloads)
        return records.arxiv(payloads)

    papers, status = _relaxed(asked("AND"), several, fetch, read)
    broken = records.feed_errors(seen[0]).unionByName(records.feed_errors(seen[1]))
    return papers, _reports(status, papers, "arxiv", broken)


def pubmed(parsed: DataFrame, fetch: Fetch, limit: int = DEFAULTS.limit_per_source) -> tuple[DataFrame, DataFrame]:
    """Ids first, of all keywords or else any; then their records, in the order of the ids. A query without ids asks for
    no records. parsed: query_id, keywords, raw."""
    asked = lambda term: parsed.select("query_id", _url(EUTILS + "esearch.fcgi", db="pubmed", retmode="json", sort="relevance", retmax=limit, term=term).alias("url"))
    k = F.col("keywords")
    ids, status = _relaxed(asked(query.strict_term(k, F.col("raw"))), asked(query.relaxed_term(k)), fetch, records.esearch_ids)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pmid"))), lambda x: x["pmid"]), ",")
    wanted = ids.groupBy("query_id").agg(joined.alias("ids")).select("query_id", _url(EUTILS + "efetch.fcgi", db="pubmed", retmode="xml", id=F.col("ids")).alias("url"))
    got = keep(fetch(wanted), "payloads")
    papers = records.in_search_order(records.pubmed(got.where("status = 'ok'")), ids)
    last = status.join(got.select("query_id", F.col("status").alias("last")), "query_id", "left").select("query_id", F.coalesce("last", "status").alias("status"))
    return papers, _reports(last, papers, "pubmed")


def crossref(parsed: DataFrame, fetch: Fetch, limit: int = DEFAULTS.limit_per_source) -> tuple[DataFrame, DataFrame]:
    """One request, of the allowed types and needed columns alone. parsed: query_id, search_terms."""
    types = ",".join(f"type:{t}" for t in L.ALLOWED_TYPES)
    asked = parsed.select("query_id", _url(WORKS, query__bibliographic=F.col("search_terms"), rows=limit, filter=types, select=",".join(WORK_FIELDS)).alias("url"))
    got = keep(fetch(asked), "payloads")
    good = got.where("status = 'ok'")
    papers = records.crossref(good)
    return papers, _reports(got.select("query_id", "status"), papers, "crossref", records.malformed(good))
