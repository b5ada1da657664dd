"""Entity resolution: exact and fuzzy matches, the greedy fold, components at scale, and field-wise merges."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..config import DEFAULTS, Settings
from ..functions import lexicon as L
from ..functions import text as T
from ..tables import keep, release, sized
from .query import BROADCAST_ROWS

#: Parts that a block of titles is dealt to.
SALTS = 8
#: Signs of a title from which on no edit distance is computed, and signs of a run that two titles may share.
LONG_KEY, GRAM = 400, 4
_PREPRINTS = tuple(L.PREPRINT_PREFIXES)


def preprint_pair(doi_a: Column, doi_b: Column, title_a: Column, title_b: Column) -> Column:
    """Both have a DOI, at least one of a preprint server, and the same title key."""
    is_preprint = lambda d: F.exists(T.words_in(L.PREPRINT_PREFIXES), lambda p: d.startswith(p))
    return doi_a.isNotNull() & doi_b.isNotNull() & (is_preprint(doi_a) | is_preprint(doi_b)) & (title_a == title_b) & (title_a != "")


def _most(x: str, y: str) -> float:
    """An upper bound of the matching-blocks ratio, from signs in common and runs of GRAM signs in common.

    A sign without a partner spoils at most GRAM of the runs, whichever title it is in, so that u such signs leave at
    least (runs of the longer - GRAM * u) runs in common. For titles of one byte a sign."""
    a, b = (np.frombuffer(t.encode("latin-1"), np.uint8) for t in (x, y))
    both = len(a) + len(b)
    most = 2.0 * int(np.minimum(np.bincount(a, minlength=256), np.bincount(b, minlength=256)).sum()) / both
    if min(len(a), len(b)) < GRAM:
        return most
    runs = []
    for t in (a, b):
        code = np.zeros(len(t) - GRAM + 1, np.uint64)
        for i in range(GRAM):
            code = code * np.uint64(256) + t[i : len(code) + i]
        runs.append(np.unique(code, return_counts=True))
    (ca, na), (cb, nb) = runs
    _, i, j = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    common, longer = int(np.minimum(na[i], nb[j]).sum()), max(len(a), len(b)) - GRAM + 1
    unmatched = -(-(longer - common) // GRAM)
    return min(most, 2.0 * ((both - unmatched) // 2) / both)


def _ratio(least: float):
    """The matching-blocks ratio of two titles, which no built-in function gives; null where a bound tells that it is
    under least."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None or (len(x) + len(y) > 400 and _most(x, y) < least):
            return None
        return difflib.SequenceMatcher(None, x, y).ratio()

    @pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


def keyed(papers: DataFrame) -> DataFrame:
    """papers with key, the comparison key of the title."""
    return papers.withColumn("key", T.normalize_title(F.col("title")))


def fuzzy_pairs(papers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, left_id and right_id of different title keys that are nearly the same.

    Keys meet within blocks of equal first signs and of lengths that leave the ratio within reach, and are compared
    once each: equal keys are one row before the join, and those alone in their block take no part. A ratio of r leaves
    at most (1 - r) * (both lengths) signs unmatched, so no pair with a greater edit distance reaches the ratio; of long
    keys, for which the distance takes the product of their lengths, common signs and runs of signs are counted
    instead. A block's rows are dealt to SALTS parts, so that many titles with one start don't meet in one task.
    papers: query_id, id, title."""
    keys = keyed(papers).where("key <> ''").groupBy("query_id", "key").agg(F.min("id").alias("id"))
    keys = keep(keys.withColumn("block", F.left("key", F.lit(settings.block_prefix))).where(F.length("key") >= settings.block_prefix), "titles")
    shared = keys.groupBy("query_id", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keys = keys.join(sized(shared, BROADCAST_ROWS), ["query_id", "block"], "left_semi").withColumn("size", F.length("key"))
    # Both lengths' sum bounds the ratio: steps of the least quotient of lengths, so that pairs are of one or of neighbouring steps.
    quotient = min(max(settings.title_similarity / (2 - settings.title_similarity), settings.length_ratio, 1e-9), 0.999)
    keys = keys.withColumn("step", F.floor(F.log(F.col("size")) / F.lit(-math.log(quotient) * 1.0001)).cast("int"))
    salt = {"short": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"), "long": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))}
    step = {"short": F.col("step"), "long": F.explode(F.array(F.col("step"), F.col("step") - 1))}
    a, b = (
        keys.withColumn("salt", salt[side]).select("query_id", "block", "salt", step[side].alias("step"), F.col("id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key"), F.col("size").alias(f"{side}_size"))
        for side in ("short", "long")
    )
    shorter, longer = F.col("short_size"), F.col("long_size")
    near = a.join(b, ["query_id", "block", "salt", "step"]).where((shorter < longer) | ((shorter == longer) & (F.col("short_id") < F.col("long_id"))))
    near = near.where((shorter >= longer * F.lit(settings.length_ratio)) & (F.lit(2.0) * shorter / (shorter + longer) >= settings.title_similarity))
    unmatched = F.floor((shorter + longer) * F.lit(1 - settings.title_similarity) + F.lit(1e-9)).cast("int")
    near = near.where((longer > LONG_KEY) | (F.levenshtein("short_key", "long_key") <= unmatched))
    # The ratio depends on which title comes first.
    first = F.col("short_id") < F.col("long_id")
    left, right = ({"id": F.when(first, F.col(f"{x}_id")).otherwise(F.col(f"{y}_id")), "key": F.when(first, F.col(f"{x}_key")).otherwise(F.col(f"{y}_key"))} for x, y in (("short", "long"), ("long", "short")))
    near = near.select("query_id", left["id"].alias("left_id"), right["id"].alias("right_id"), _ratio(settings.title_similarity)(left["key"], right["key"]).alias("ratio"))
    return near.where(F.col("ratio") >= settings.title_similarity).select("query_id", "left_id", "right_id")


def _vetoes(doi: str | None, key: str, other: str | None, other_key: str) -> bool:
    """Whether two DOIs speak against the same work: they differ, and are no preprint and its publication."""
    if doi is None or other is None or doi == other:
        return False
    return key != other_key or not key or not (doi.startswith(_PREPRINTS) or other.startswith(_PREPRINTS))


def _similar(key: str, other: str, settings: Settings) -> bool:
    if not key or not other or min(len(key), len(other)) < settings.length_ratio * max(len(key), len(other)):
        return False
    return difflib.SequenceMatcher(None, key, other).ratio() >= settings.title_similarity


def assign(records: list[tuple[str | None, str]], settings: Settings = DEFAULTS) -> list[int]:
    """Clusters of records (doi, title key) in order of arrival; each goes to the first that one of these rules names:

    the cluster of the first record with its DOI; that of the first record with its key, unless a member's DOI vetoes;
    of the clusters with a member whose key begins alike, in the order in which they got one, the first without a veto
    and with any member of a similar key; a new one."""
    placed: list[tuple[str | None, str, int]] = []
    clusters: list[list[tuple[str | None, str]]] = []
    for doi, key in records:
        at = next((c for d, _, c in placed if doi is not None and d == doi), None)
        if at is None and key:
            clear = lambda c: not any(_vetoes(doi, key, *m) for m in clusters[c])  # noqa: B023, E731
            at = next((c for _, k, c in placed if k == key), None)
            if at is None or not clear(at):
                start = key[: settings.block_prefix]
                alike = dict.fromkeys(c for _, k, c in placed if k and k[: settings.block_prefix] == start)
                at = next((c for c in alike if clear(c) and any(_similar(key, k, settings) for _, k in clusters[c])), None)
        if at is None:
            at = len(clusters)
            clusters.append([])
        clusters[at].append((doi, key))
        placed.append((doi, key, at))
    return [c for _, _, c in placed]


def greedy_clusters(papers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, id, pos and cluster (from 0, in order of arrival) by the sequential fold.

    The result depends on the order of pos, so a query's records, at most sources x limit, are one group.
    papers: query_id, id, pos, doi, title."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pos", "id"])
        rows["cluster"] = assign([(d if isinstance(d, str) and d else None, k or "") for d, k in zip(rows["doi"], rows["key"], strict=True)], settings)
        return rows[["query_id", "id", "pos", "cluster"]]

    source = keyed(papers).select("query_id", "id", F.col("pos").cast("int").alias("pos"), "doi", "key")
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.groupBy("query_id").applyInPandas(fold, f"query_id {kinds['query_id']}, id {kinds['id']}, pos int, cluster int")


def linked_clusters(papers: DataFrame) -> DataFrame:
    """query_id, id and cluster (the smallest id reachable) over equal DOIs and equal title keys without DOI conflict.

    For record sets of any size: labels spread through DOI and title groups by aggregation, without pairs, until
    none changes. Unlike the fold it merges clusters that a later record connects. Records without a DOI and a
    title key stay alone."""
    source = keyed(papers).select("query_id", "id", "doi", F.nullif("key", F.lit("")).alias("key"))
    clear = source.where("key is not null").groupBy("query_id", "key").agg(F.min("doi").alias("lo"), F.max("doi").alias("hi")).where("lo <=> hi")
    title = source.join(clear.select("query_id", "key", F.lit(True).alias("clear")), ["query_id", "key"], "left")
    state = keep(title.select("query_id", "id", "doi", F.when(F.col("clear"), F.col("key")).alias("title_key"), F.col("id").alias("cluster")), "linked")
    while True:
        after = state.withColumn("before", F.col("cluster"))
        for key in ("doi", "title_key"):
            least = after.where(F.col(key).isNotNull()).groupBy("query_id", key).agg(F.min("cluster").alias("least"))
            after = after.join(least, ["query_id", key], "left").withColumn("cluster", F.least("cluster", "least")).drop("least")
        after = keep(after, "linked")
        moved = after.where("cluster <> before").limit(1).count()
        release(state)
        state = after.select("query_id", "id", "doi", "title_key", "cluster")
        state._kept = after._kept
        if not moved:
            return state.select("query_id", "id", "cluster")


SCALARS = ["doi", "abstract", "published_date", "journal", "publisher", "volume", "issue", "pages", "publication_type", "pdf_url", "citation_count"]


def merge(clustered: DataFrame, key: list[str], scalars: list[str], lists: list[str], order: list[Column]) -> DataFrame:
    """One record per key: of each scalar the first that isn't null, of each list the first that isn't empty, in order."""
    at = F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)])
    rows = clustered.withColumn("_at", at)
    some = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in scalars]
    some += [F.coalesce(F.min_by(c, F.when(F.size(c) > 0, F.col("_at"))), F.min_by(c, "_at")).alias(c) for c in lists]
    return rows.groupBy(*key).agg(*some, F.count(F.lit(1)).alias("n_merged"))


def merge_papers(clustered: DataFrame) -> DataFrame:
    """Papers with a cluster column, merged: the most complete record wins, then source priority, then pos."""
    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.SOURCE_PRIORITY.items() for x in kv]), F.col("source")), F.lit(0))
    rows = clustered.withColumn("_c", T.completeness())
    order = [-F.col("_c"), -priority, F.col("pos")]
    plain = merge(rows, ["query_id", "cluster"], ["source", "source_id", "title", "url", *SCALARS], ["authors", "keywords"], order)
    at = F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)])
    origin = rows.select("query_id", "cluster", "pos", F.struct(at.alias("at"), F.concat(F.array("source"), F.coalesce("also_found_in", F.array().cast("array<string>"))).alias("s")).alias("x"))
    origin = origin.groupBy("query_id", "cluster").agg(F.min("pos").alias("pos"), F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["s"])).alias("_all"))
    met = plain.join(origin, ["query_id", "cluster"])
    also = F.array_distinct(F.filter("_all", lambda s: s != F.col("source")))
    return met.withColumn("also_found_in", also).withColumn("id", T.paper_id(F.col("doi"), F.col("source"), F.col("source_id"))).drop("_all")


def duplicates_merged(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("query_id").agg((F.count(F.lit(1)) - F.count_distinct("cluster")).alias("duplicates_merged"))
