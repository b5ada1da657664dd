"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

The vectors are packed into blocks. Each block keeps one list of its rows for every dimension, sorted by
that component. A query walks all lists at once (from the top where its own component is positive, from
the bottom where it is negative), scores in full the rows that it meets for the first time, and stops as
soon as the best score that a row not yet met could have is below its k-th best: nothing unseen can then
enter, so the result is exact. A task carries the k best of its blocks along, so that the next block starts with
their bound; the k best of all tasks are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch

#: Vectors in a block, which bounds a task's memory.
BLOCK_ROWS = 8192
#: Components of queries sent to the executors at once (8 bytes each); more queries go in further blocks.
BLOCK_COMPONENTS = 1_000_000


class SortedLists:
    """One block of integer vectors with its per-dimension lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        # A list in each column, from the smallest component to the largest; read from the end for the reverse.
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)

    def _rows(self, used: np.ndarray, down: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Rows at places start to stop of the lists of dimensions `used`, from the top where `down` says so."""
        n = len(self.ids)
        upper, lower = self.order[n - stop : n - start, used[down]], self.order[start:stop, used[~down]]
        return np.concatenate((upper.ravel(), lower.ravel()))

    def best(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but `own`, by score and then smaller id; of those below `floor`, the k-th best
        score of other blocks, any may be missing."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        weight = query[used]
        down = weight > 0
        seen = np.zeros(n, bool)
        seen[self.ids == own] = True
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, max(k, 16)
        while depth < n:
            if not len(used):
                met, depth = np.flatnonzero(~seen), n
            else:
                new = np.zeros(n, bool)
                stop = min(n, depth + step)
                new[self._rows(used, down, depth, stop)] = True
                met = np.flatnonzero(new & ~seen)
                depth, step = stop, step * 2
            seen[met] = True
            if len(met):
                score = self.vectors[met] @ query
                least = scores[-1] if len(ids) == k else floor
                if least is not None:
                    met, score = met[score >= least], score[score >= least]
                ids, scores = np.concatenate((ids, self.ids[met])), np.concatenate((scores, score))
                first = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[first], scores[first]
            least = max((x for x in (scores[-1] if len(ids) == k else None, floor) if x is not None), default=None)
            if depth < n and least is not None:
                # No row not yet met has more in any dimension than the places where the lists were left.
                at = np.where(down, self.order[n - depth, used], self.order[depth - 1, used])
                if int((self.vectors[at, used] * weight).sum()) < least:
                    break
        return ids, scores


def _query_blocks(rows) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of queries: by number of components, their ids and vectors."""

    def packed(held):
        return {d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64).reshape(len(x), d)) for d, x in held.items()}

    held, size = {}, 0
    for vec_id, v in rows:
        held.setdefault(len(v), []).append((vec_id, v))
        size += len(v) + 1
        if size >= BLOCK_COMPONENTS:
            yield packed(held)
            held, size = {}, 0
    if held:
        yield packed(held)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    vectors: vec_id, embedding; further columns are ignored. A component x counts as floor(scale * x).
    Queries are the rows whose vec_id is divisible by `every`; candidates all rows but those with the
    query's own vec_id. Ties go to the smaller vec_id. Rows take no part if vec_id or the vector is null
    or a component is null or not finite; vectors of different length don't meet, empty ones score 0.
    Fewer than k candidates give fewer rows. Repeated rows each count as candidates; of the rows with one
    query id the smallest vector asks. An empty table gives no rows.
    Queries are read in blocks of BLOCK_COMPONENTS, each broadcast and put to all rows in one pass; the k
    best of each task are merged by a window over (query, task) results. Rows with a score equal to the k-th best are
    met before a search stops, so ties are exact.
    """
    spark = vectors.sparkSession
    usable = vectors.where("vec_id is not null and embedding is not null").where(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    whole = usable.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"),
    )
    asked = whole.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    kind = "query_id bigint, vec_id bigint, score bigint"
    found = None
    for block in _query_blocks(asked.toLocalIterator()):
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            held: dict[int, tuple[list[np.ndarray], list[np.ndarray], list[int]]] = {}
            #: Of each query the k best of the task's blocks, whose k-th the next block has to reach.
            best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

            def answer(dims):
                ids, rows, _ = held.pop(dims)
                if dims not in shared.value:
                    return
                ids = np.concatenate(ids)
                lists = SortedLists(ids, np.concatenate(rows).reshape(len(ids), dims))
                asked = list(zip(*shared.value[dims], strict=True))
                own = best.setdefault(dims, [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(asked))
                for at, (q, v) in enumerate(asked):
                    ids, scores = own[at]
                    more = lists.best(v, int(q), k, int(scores[-1]) if len(ids) == k else None)
                    ids, scores = np.concatenate((ids, more[0])), np.concatenate((scores, more[1]))
                    first = np.lexsort((ids, -scores))[:k]
                    own[at] = ids[first], scores[first]

            for part in batches:
                values = part.column(1)
                flat = values.flatten().to_numpy(zero_copy_only=False)
                size = np.diff(values.offsets.to_numpy())
                start = np.concatenate(([0], np.cumsum(size)[:-1]))
                vec_ids = part.column(0).to_numpy(zero_copy_only=False)
                for dims in np.unique(size).tolist():
                    mine = np.flatnonzero(size == dims)
                    for at in range(0, len(mine), BLOCK_ROWS):
                        some = mine[at : at + BLOCK_ROWS]
                        ids, rows, count = held.setdefault(dims, ([], [], [0]))
                        ids.append(vec_ids[some])
                        rows.append(flat[(start[some][:, None] + np.arange(dims)).ravel()])
                        count[0] += len(some)
                        if count[0] >= BLOCK_ROWS:
                            answer(dims)
            for dims in list(held):
                answer(dims)
            for dims, own in best.items():
                for q, (ids, scores) in zip(shared.value[dims][0], own, strict=True):
                    if len(ids):
                        yield batch({"query_id": np.full(len(ids), q), "vec_id": ids, "score": scores}, schema)

        part = whole.mapInArrow(search, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
