"""Topic clusters of each query's papers, their terms and labels, and the silhouette of given labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T

LEAST_TERM = 3


def ward(x: np.ndarray) -> list[tuple[int, int]]:
    """Merges of Ward's linkage in order, by the Lance-Williams update of squared distances."""
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    size, alive, merges = np.ones(n), np.ones(n, bool), []
    for _ in range(n - 1):
        masked = np.where(alive[:, None] & alive[None, :], d, np.inf)
        a, b = sorted(divmod(int(np.argmin(masked)), n))
        merges.append((a, b))
        others = alive.copy()
        others[[a, b]] = False
        total = size[a] + size[b] + size[others]
        new = ((size[a] + size[others]) * d[a, others] + (size[b] + size[others]) * d[b, others] - size[others] * d[a, b]) / total
        d[a, others] = d[others, a] = new
        size[a] += size[b]
        alive[b] = False
    return merges


def cut(merges: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    """Labels 0.. of the k clusters left before the last k - 1 merges, numbered by first member."""
    root = np.arange(n)
    for a, b in merges[: n - k]:
        root[root == root[b]] = root[a]
    _, first, labels = np.unique(root, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[labels]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean cosine silhouette; members of clusters of one count 0."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, 0)
    member = labels[:, None] == np.unique(labels)[None, :]
    sums, sizes = d @ member, member.sum(0)
    own = member.argmax(1)
    at = np.arange(len(x))
    a = sums[at, own] / np.maximum(sizes[own] - 1, 1)
    other = np.where(member, np.inf, sums / sizes[None, :])
    b = other.min(1)
    s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def partition(x: np.ndarray, settings: Settings = DEFAULTS) -> tuple[np.ndarray | None, int, float | None, str]:
    """Labels, k, silhouette and reason: the best usable number of clusters, or none."""
    n = len(x)
    if n < settings.min_papers:
        return None, 0, None, "too few papers"
    best: tuple[np.ndarray | None, int, float] = (None, 0, -1.0)
    merges = ward(x)
    for k in range(2, min(settings.max_clusters, n // settings.min_cluster) + 1):
        labels = cut(merges, n, k)
        sizes = np.bincount(labels)
        usable = sizes.min() >= settings.min_cluster and sizes.max() / n <= settings.dominance
        score = silhouette(x, labels)
        if usable and score > best[2]:
            best = labels, k, score
    if best[0] is None:
        return None, 0, None, "no usable partition"
    if best[2] < settings.min_silhouette:
        return None, best[1], best[2], "clusters are not distinct"
    return best[0], best[1], best[2], ""


def cluster(papers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, doc_id, cluster_id (null if not applied), k, silhouette and reason.

    papers: query_id, pos, doc_id, vector (array). A query's candidates, a few hundred at most, are one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        labels, k, score, reason = partition(np.array(rows["vector"].tolist(), float), settings)
        out = rows[["query_id", "doc_id"]].copy()
        out["cluster_id"] = pd.array(labels if labels is not None else [None] * len(rows), dtype="Int32")
        return out.assign(k=k, silhouette=score, reason=reason)

    kinds = {f.name: f.dataType.simpleString() for f in papers.schema}
    return papers.select("query_id", "pos", "doc_id", "vector").groupBy("query_id").applyInPandas(
        run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, cluster_id int, k int, silhouette double, reason string"
    )


def class_terms(docs: DataFrame, top: int = DEFAULTS.cluster_terms) -> DataFrame:
    """query_id, grp, rk, term and score: tf * log(1 + groups / groups with the term) * share of the term's uses here.

    docs: query_id, grp, text."""
    words = docs.select("query_id", "grp", F.explode(T.tokens(F.col("text"))).alias("term"))
    counts = words.groupBy("query_id", "grp", "term").agg(F.count(F.lit(1)).alias("n"))
    size = counts.groupBy("query_id", "grp").agg(F.sum("n").alias("size"))
    groups = docs.groupBy("query_id").agg(F.count_distinct("grp").alias("groups"))
    uses = counts.groupBy("query_id", "term").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("within"))
    met = counts.where((F.length("term") >= LEAST_TERM) & ~F.col("term").rlike("^[0-9]+$")).join(uses, ["query_id", "term"])
    met = met.join(F.broadcast(groups), "query_id").join(F.broadcast(size), ["query_id", "grp"])
    score = F.col("n") / F.col("size") * F.log(F.lit(1.0) + F.col("groups") / F.col("within")) * F.col("n") / F.col("all")
    met = met.withColumn("score", F.round(score, 9))
    order = Window.partitionBy("query_id", "grp").orderBy(F.desc("score"), "term")
    return met.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= top).select("query_id", "grp", "rk", "term", "score")


def label(terms: Column) -> Column:
    return F.when(F.size(terms) == 0, F.lit("Miscellaneous")).otherwise(F.array_join(F.slice(terms, 1, 3), " · "))


def build(assigned: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, cluster_id, place, label, terms and doc_ids in order, by size and then id."""
    named = terms.groupBy("query_id", F.col("grp").alias("cluster_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "term"))), lambda s: s["term"]).alias("terms"))
    members = assigned.where("cluster_id is not null").groupBy("query_id", "cluster_id").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    met = members.join(named, ["query_id", "cluster_id"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.size("doc_ids")), "cluster_id")
    return met.select("query_id", "cluster_id", F.row_number().over(order).alias("place"), label(F.col("terms")).alias("label"), "terms", "doc_ids")


def usable(sizes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id and whether its clusters (query_id, cluster_id, n) are neither too small nor dominant."""
    test = (F.min("n") >= settings.min_cluster) & (F.max("n") / F.sum("n") <= settings.dominance)
    return sizes.groupBy("query_id").agg(test.alias("usable"))


def label_silhouette(vectors: DataFrame) -> DataFrame:
    """The mean cosine silhouette of unit vectors with given labels, by label: label, n, silhouette.

    The mean distance of a row to a group follows from the group's sum of vectors, so no pairs are made.
    vectors: vec_id, label, embedding."""
    unit = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    unit = unit.withColumn("len", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)))
    unit = unit.withColumn("e", F.transform("e", lambda x: x / F.col("len")))
    flat = unit.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    sums = flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    sums = sums.join(unit.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select(F.col("label").alias("other"), "total", "n")
    met = unit.select("vec_id", "label", "e").crossJoin(F.broadcast(sums))
    near = F.aggregate(F.zip_with("e", "total", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    same = F.col("other") == F.col("label")
    far = F.when(same, (F.col("n") - near) / F.nullif(F.col("n") - 1, F.lit(0))).otherwise((F.col("n") - near) / F.col("n"))
    met = met.select("vec_id", "label", same.alias("same"), "n", far.alias("d"))
    rows = met.groupBy("vec_id", "label").agg(F.max(F.when(F.col("same"), F.col("d"))).alias("a"), F.min(F.when(~F.col("same"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("silhouette"))


def within(papers: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """The papers of the chosen clusters (key)."""
    return papers.join(chosen.select(*key).distinct(), key, "left_semi")
