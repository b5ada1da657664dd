"""Sources, their capabilities, pruning, and reading many of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import records

#: source, order, lookups by DOI, arXiv id and PMID, least seconds between requests.
CAPABILITIES = [("pubmed", 0, True, False, True, 0.4), ("arxiv", 1, True, True, False, 3.0), ("crossref", 2, True, False, False, 0.05)]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "source string, ord int, has_doi boolean, has_arxiv boolean, has_pmid boolean, interval double")


def select(known: DataFrame, names: list[str] | None) -> DataFrame:
    """The named sources in stable order; all if none are named; unknown names are ignored."""
    return known if not names else known.where(F.col("source").isin(names))


def fan_out(spark: SparkSession, payloads: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Papers of all sources, and reports of those that could not be read. payloads: source to (query_id, payload)."""
    found, failed = None, []
    for name, rows in payloads.items():
        try:
            papers = records.READERS[name](rows)
        except KeyError:
            failed.append((name, "unavailable", "no reader"))
            continue
        found = papers if found is None else found.unionByName(papers)
    report = spark.createDataFrame(failed, "source string, status string, reason string")
    return (found if found is not None else spark.createDataFrame([], schema.PAPER)), report


def by_doi(papers: DataFrame, dois: DataFrame) -> DataFrame:
    """query_id and the first paper of each DOI asked for (query_id, doi); without one, no row."""
    return papers.drop("query_id").join(dois, "doi")


def by_source_id(papers: DataFrame, ids: DataFrame, source: str) -> DataFrame:
    return papers.where(F.col("source") == source).drop("query_id").join(ids, "source_id")
