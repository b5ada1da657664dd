"""The data tables in the roles of papers, queries, judgments and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..shipping import ship


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def papers(spark: SparkSession, d: str) -> DataFrame:
    """documents as papers: title up to the first full stop or line feed, the rest as abstract unless it's a stub."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    title = F.regexp_extract("text", r"^([^.\n]*)", 1)
    rest = F.trim(F.substring("text", F.length("title") + 2, F.length("text")))
    return docs.withColumn("title", title).withColumn("abstract", F.when(F.length(rest) >= DEFAULTS.backfill_min_chars, rest))


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.col("text").alias("raw"))


def users(spark: SparkSession, d: str) -> DataFrame:
    """What users typed, as queries: every fifth turn also as an identifier in one of several spellings."""
    rows = table(spark, d, "conversations").where("role = 'user'")
    number = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    made = (
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("https://doi.org/10.1234/CONV."), number)).when(F.col("conv_id") % 5 == 1, F.concat(F.lit("PMID: "), F.col("conv_id").cast("string")))
        .when(F.col("conv_id") % 5 == 2, F.regexp_extract("text", r"^(\S+(?: \S+)?)", 1)).otherwise(F.col("text"))
    )
    return rows.select(F.concat("conv_id", F.lit("-"), "turn").alias("query_id"), made.alias("raw"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and grade: 3 for good and not toxic, 2 for good, else 0."""
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, 3 - F.col("toxic")).otherwise(0).alias("grade"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """documents as full records for citations: nations are the authors, 0 to 24 of them."""
    names = table(spark, d, "nation").groupBy().agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("names"))
    given = lambda x: F.when(x["n_nationkey"] % 4 != 0, F.when(x["n_nationkey"] % 4 == 1, "Ann").otherwise("Bo C."))
    author = lambda x: F.struct(F.concat_ws(" ", given(x), x["n_name"]).alias("name"), given(x).alias("given"), F.when(x["n_nationkey"] % 5 != 0, x["n_name"]).alias("family"))
    rows = papers(spark, d).crossJoin(F.broadcast(names))
    i = F.col("doc_id")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (i % n + 1).cast("int"))
    return rows.select(
        "doc_id", F.lit(0).alias("export_id"), i.cast("int").alias("pos"), F.concat(F.lit("doc:"), i.cast("string")).alias("id"), "title", "abstract",
        F.when(i % 3 != 0, F.concat(F.lit("10.1234/doc_"), i.cast("string"))).alias("doi"), pick(["pubmed", "arxiv", "crossref"], 3).alias("source"), i.cast("string").alias("source_id"),
        F.transform(F.slice("names", F.lit(1), (i % 25).cast("int")), author).alias("authors"),
        F.when(i % 5 != 0, F.concat(F.lit("Annals of DNA & "), "lang")).alias("journal"), F.when(i % 4 != 0, (i % 40).cast("string")).alias("volume"), F.when(i % 2 == 0, (i % 12).cast("string")).alias("issue"),
        pick(["10-20", "7", "100--110", " 3 - 9 "], 4).alias("pages"), pick(["journal-article", "book-chapter", "Preprint", "report", "", "other"], 6).alias("publication_type"),
        F.when(i % 7 != 0, F.make_date((i % 30 + 1990).cast("int"), (i % 12 + 1).cast("int"), (i % 28 + 1).cast("int"))).alias("published_date"),
        F.array("lang", F.concat(F.lit("100%_"), "source")).alias("keywords"), F.concat(F.lit("https://example.org/a_"), i.cast("string")).alias("url"), F.lit(None).cast("string").alias("publisher"),
        F.lit(None).cast("string").alias("pdf_url"), (i % 90).alias("citation_count"), F.when(i % 6 == 0, F.array(F.lit("crossref"), F.lit("arxiv"))).otherwise(F.array().cast("array<string>")).alias("also_found_in"),
    )
