"""Recovery of missing abstracts from a lookup table of inverted indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T


def gaps(papers: DataFrame) -> DataFrame:
    """Papers with a DOI and no abstract."""
    return papers.where("doi is not null and coalesce(trim(abstract), '') = ''")


def works(payloads: DataFrame) -> DataFrame:
    """doi and abstract of lookup results (column payload, JSON with results[])."""
    kind = "results ARRAY<STRUCT<doi:STRING,abstract_inverted_index:STRING>>"
    each = payloads.select(F.explode(F.from_json("payload", kind)["results"]).alias("w"))
    return each.select(T.normalize_doi(F.col("w.doi")).alias("doi"), T.reconstruct_json_abstract(F.col("w.abstract_inverted_index")).alias("abstract"))


def fill(papers: DataFrame, found: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """papers with gaps filled by DOI from found (doi, abstract); stubs are refused, abstracts at hand stay."""
    usable = found.where(F.length("abstract") >= settings.backfill_min_chars).groupBy("doi").agg(F.min("abstract").alias("_found"))
    met = papers.join(usable, "doi", "left")
    own = F.nullif(F.trim("abstract"), F.lit(""))
    return met.withColumn("abstract", F.when(own.isNull(), F.col("_found")).otherwise(F.col("abstract"))).select(papers.columns)


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """missing, still_missing and filled."""
    a = gaps(before).agg(F.count(F.lit(1)).alias("missing"))
    b = gaps(after).agg(F.count(F.lit(1)).alias("still_missing"))
    return a.crossJoin(b).withColumn("filled", F.col("missing") - F.col("still_missing"))
