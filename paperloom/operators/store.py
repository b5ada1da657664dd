"""Keyed stores and caches as tables: latest by key, time to live, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS


def cache_key(query: Column, limit: Column, sources: Column, fingerprint: Column) -> Column:
    """A digest of all that changes a search's result; the query in lower case with collapsed white space."""
    words = F.lower(F.trim(F.regexp_replace(query, r"(?U)\s+", " ")))
    names = F.when(F.size(F.coalesce(sources, F.array().cast("array<string>"))) == 0, F.lit("all")).otherwise(F.array_join(F.array_sort(sources), ","))
    end = F.lit("\x00")
    parts = [x for part in (words, limit.cast("string"), names, fingerprint) for x in (part, end)]
    return F.left(F.sha2(F.concat(*parts).cast("binary"), 256), F.lit(32))


def upsert(stored: DataFrame, new: DataFrame, key: list[str], at: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """The latest row of each key; of equal times the new one, of those the least by the columns of tie, which go."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy(F.desc(at), F.desc("_new"), *tie)
    return both.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_new", *tie)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def fresh(probes: DataFrame, stored: DataFrame, key: list[str], ttl: int = DEFAULTS.cache_ttl) -> DataFrame:
    """probes (key, asked_at) with hit: whether the stored row (key, created_at) is younger than ttl whole seconds."""
    met = probes.join(stored.select(*key, "created_at"), key, "left")
    age = F.unix_timestamp("asked_at") - F.unix_timestamp("created_at")
    return met.withColumn("hit", F.coalesce((age >= 0) & (age < ttl), F.lit(False)))


def simulate_ttl(asked: DataFrame, key: list[str], at: str, ttl: int) -> DataFrame:
    """key, n and hits of requests in order: a hit doesn't renew the entry, the next miss does.

    Each key's sorted times are folded; a time is the seconds in column `at`."""
    times = asked.groupBy(*key).agg(F.array_sort(F.collect_list(F.col(at).cast("bigint"))).alias("t"))
    start = F.struct(F.lit(None).cast("bigint").alias("made"), F.lit(0).cast("bigint").alias("hits"))

    def step(s: Column, t: Column) -> Column:
        hit = s["made"].isNotNull() & (t - s["made"] < ttl)
        return F.struct(F.when(hit, s["made"]).otherwise(t).alias("made"), (s["hits"] + F.when(hit, 1).otherwise(0)).alias("hits"))

    return times.select(*key, F.size("t").cast("bigint").alias("n"), F.aggregate("t", start, step)["hits"].alias("hits"))


def history(searches: DataFrame, size: int = DEFAULTS.history) -> DataFrame:
    """user_id, query, ts and pos of each user's latest different queries. searches: user_id, query, ts, id."""
    last = latest(searches, ["user_id", "query"], [F.desc("ts"), F.desc("id")])
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    return last.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= size).select("user_id", "query", "ts", "pos")


def ordered_fetch(requested: DataFrame, papers: DataFrame, key: str = "id") -> DataFrame:
    """Rows of papers in the requested order (export_id, pos, id); unknown ids are left out."""
    return requested.join(papers, key)


def missing_ids(requested: DataFrame, papers: DataFrame, key: str = "id") -> DataFrame:
    return requested.join(papers.select(key), key, "left_anti")


def cacheable(answers: DataFrame, degraded: DataFrame) -> DataFrame:
    """The answers that may be cached: those of queries (query_id, degraded) none of whose sources failed."""
    return answers.join(degraded.where("degraded").select("query_id"), "query_id", "left_anti")


#: The columns of a paper that a frozen pool of candidates holds.
POOL = ["id", "doi", "title", "abstract", "keywords", "journal", "source", "publication_type", "published_date", "citation_count"]


def write_pool(papers: DataFrame, path: str) -> None:
    """Freeze the candidates of each query (query_id, pos and POOL) as JSON lines, one folder for each query."""
    papers.select("query_id", "pos", *POOL).write.partitionBy("query_id").json(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """What write_pool() froze; query_id as text."""
    kind = "pos int, id string, doi string, title string, abstract string, keywords array<string>, journal string, source string, publication_type string, published_date date, citation_count bigint, query_id string"
    return spark.read.schema(kind).json(path)


class Table:
    """A keyed table in a folder of Parquet versions: put, get, count, clear. The newest version is read."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], at: str):
        self.spark, self.path, self.schema, self.key, self.at = spark, path.rstrip("/"), schema, key, at

    def _versions(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [n for n in found if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(done)

    def get(self) -> DataFrame:
        versions = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{versions[-1]}") if versions else self.spark.createDataFrame([], self.schema)

    def put(self, rows: DataFrame) -> None:
        versions = self._versions()
        number = int(versions[-1][1:]) + 1 if versions else 0
        upsert(self.get(), rows, self.key, self.at).select(self.get().columns).write.parquet(f"{self.path}/v{number:08d}")

    def count(self) -> int:
        return self.get().count()

    def clear(self) -> None:
        versions = self._versions()
        number = int(versions[-1][1:]) + 1 if versions else 0
        self.spark.createDataFrame([], self.schema).write.parquet(f"{self.path}/v{number:08d}")
