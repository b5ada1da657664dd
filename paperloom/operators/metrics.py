"""Retrieval metrics, macro averages, tallies and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings


def graded(ranked: DataFrame, judged: DataFrame, key: list[str]) -> DataFrame:
    """ranked with grade, 0 where judged (key, grade) has none."""
    return ranked.join(judged, key, "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def missing_profile(rows: DataFrame, column: str) -> DataFrame:
    """n, missing and share: how many rows have no value."""
    missing = F.count_if(F.col(column).isNull())
    return rows.agg(F.count(F.lit(1)).alias("n"), missing.alias("missing"), F.round(missing / F.count(F.lit(1)), 9).alias("share"))


def stage_counters(requests: DataFrame, flags: dict[str, Column], user: str) -> DataFrame:
    """requests, how many of them have each flag, and the different users."""
    return requests.agg(F.count(F.lit(1)).alias("requests"), *[F.count_if(f).alias(name) for name, f in flags.items()], F.count_distinct(user).alias("users"))


def evaluate(ranked: DataFrame, judged: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per key and k: recall, ceiling, attainment, precision, ndcg, mrr, n_relevant, n_retrieved.

    ranked: query_id, doc_id, rank; judged: query_id, doc_id, grade, or doc_id, grade if all queries share the
    judgments. Documents without a judgment have grade 0; the ideal order is over all judged ones, of which only the
    first max(ks) places count."""
    met = graded(ranked, judged, ["doc_id"] if "query_id" not in judged.columns else ["query_id", "doc_id"])
    found = [F.count_if((F.col("rank") <= k) & (F.col("grade") >= settings.relevant_grade)).alias(f"hits{k}") for k in settings.ks]
    found += [F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"dcg{k}") for k in settings.ks]
    first = F.coalesce(F.lit(1.0) / F.min(F.when(F.col("grade") >= settings.relevant_grade, F.col("rank"))), F.lit(0.0))
    return ratios(met.groupBy("query_id").agg(*found, first.alias("mrr"), F.count(F.lit(1)).alias("n_retrieved")), judged, settings)


def _gain(grade: Column, at: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(at + F.lit(1.0))


def ratios(rows: DataFrame, judged: DataFrame, settings: Settings = DEFAULTS, more: list[str] | None = None) -> DataFrame:
    """evaluate()'s metrics of rows (query_id, mrr, n_retrieved, and for each k hits and dcg); more: columns that stay."""
    kept = ["query_id", *(more or [])]
    shared = "query_id" not in judged.columns
    most = max(settings.ks)
    if shared:
        # One group of all judgments: places come from counts by grade, as equal grades gain alike.
        before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        some = judged.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).select("grade", before.alias("b"), "n").where(F.col("b") < most)
        ideal = some.select("grade", F.explode(F.sequence(F.col("b") + 1, F.least(F.col("b") + F.col("n"), F.lit(most)))).alias("at"))
    else:
        ideal = judged.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).where(F.col("at") <= most)
    key = [] if shared else ["query_id"]
    relevant = judged.groupBy(*key).agg(F.count_if(F.col("grade") >= settings.relevant_grade).alias("n_relevant"))
    best = ideal.groupBy(*key).agg(*[F.sum(F.when(F.col("at") <= k, _gain(F.col("grade"), F.col("at"))).otherwise(0.0)).alias(f"idcg{k}") for k in settings.ks])
    for other in (best, relevant):
        rows = rows.crossJoin(F.broadcast(other)) if shared else rows.join(other, "query_id", "left")  # shared: one row
    rows = rows.withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits{k}").alias("hits"), F.col(f"dcg{k}").alias("dcg"), F.col(f"idcg{k}").alias("idcg")) for k in settings.ks]))
    rows = rows.select(*kept, "n_relevant", "n_retrieved", "mrr", each.alias("x")).select(*kept, "n_relevant", "n_retrieved", "mrr", "x.*")
    r = F.nullif(F.col("n_relevant"), F.lit(0))
    recall, ceiling = F.coalesce(F.col("hits") / r, F.lit(0.0)), F.coalesce(F.least("k", "n_relevant") / r, F.lit(0.0))
    return rows.select(
        *kept, "k", recall.alias("recall"), ceiling.alias("ceiling"), F.coalesce(recall / F.nullif(ceiling, F.lit(0.0)), F.lit(0.0)).alias("attainment"),
        (F.col("hits") / F.col("k")).alias("precision"), F.coalesce(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"),
        "mrr", "n_relevant", "n_retrieved",
    )


def macro(metrics: DataFrame, key: list[str]) -> DataFrame:
    """Means over queries of evaluate()'s ratios by key and k; counts are summed."""
    means = [F.avg(c).alias(c) for c in ("recall", "ceiling", "attainment", "precision", "ndcg", "mrr")]
    return metrics.groupBy(*key, "k").agg(*means, F.sum("n_relevant").alias("n_relevant"), F.sum("n_retrieved").alias("n_retrieved"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def confusion(cases: DataFrame) -> DataFrame:
    """label, total, caught, rate of rows (label, caught)."""
    return cases.groupBy("label").agg(F.count(F.lit(1)).alias("total"), F.count_if("caught").alias("caught")).withColumn("rate", F.col("caught") / F.col("total"))


def sweep(rows: DataFrame, value: str, thresholds: list[float], key: list[str]) -> DataFrame:
    """By key and threshold, n and the share of rows whose value is below it."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return rows.select(*key, value, each).groupBy(*key, "threshold").agg(F.count(value).alias("n"), F.avg((F.col(value) < F.col("threshold")).cast("double")).alias("rate"))


def paired_bootstrap(scores: DataFrame, samples: int = 200, seed: int = 7) -> DataFrame:
    """Mean difference of two strategies over queries (query_id, a, b) with a 95 % interval from seeded resamples.

    Each query's weight in a sample is a Poisson(1) draw from a hash, so that resampling needs no join."""
    diff = scores.select("query_id", (F.col("a") - F.col("b")).alias("d"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("s"))
    u = F.pmod(F.xxhash64("query_id", "s", F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    cut, p, total = [], 0.36787944117144233, 0.0
    for k in range(9):
        total += p
        cut.append((total, k))
        p /= k + 1
    weight = F.lit(9)
    for bound, k in reversed(cut):
        weight = F.when(u < bound, k).otherwise(weight)
    means = diff.withColumn("w", weight).groupBy("s").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def table_row(columns: list[str], markdown: bool = False):
    """A column that renders a row of numbers, three decimals each."""
    cells = [F.format_number(c, 3) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")) if markdown else F.concat_ws(" ", *[F.lpad(c, 8, " ") for c in cells])
