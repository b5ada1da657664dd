"""Strategies compared over whole corpora: every document scored for every query, in little disk.

The scores of all pairs are made once, a slice of documents against all queries at a time, and dealt by query as packed
arrays of some 15 bytes a pair after compression; no table of pairs is written or sorted. A task then holds the pairs of
one query at a time, about 60 bytes each at its peak, ranks them by every strategy and gives back what the metrics need.
The queries, a stated set, are on the driver and broadcast. NumPy does what joins on 256 buckets and a window for each
strategy would do in rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T
from . import metrics, rank

#: Documents of a slice, and words that a worker remembers the bucket of.
SLICE, CACHE_WORDS = 256, 200_000
_PAIRS = "query_id long, docs int, grades boolean, ids binary, lexical binary, semantic binary, tokens binary"


def _codes(lists: pa.ListArray, known: dict, make) -> tuple[np.ndarray, np.ndarray]:
    """The row and the code of each word of lists; make gives a word's code."""
    coded = lists.flatten().dictionary_encode()
    if len(known) > CACHE_WORDS:
        known.clear()
    words = coded.dictionary.to_pylist()
    for w in words:
        if w not in known:
            known[w] = make(w)
    code = np.array([known[w] for w in words], np.int64)
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return rows, code[coded.indices.to_numpy()] if len(code) else np.empty(0, np.int64)


def _bucket(word: str) -> tuple[int, float]:
    """As rank.hash_embedding() has it: bucket before the modulo, and sign."""
    digest = hashlib.md5(word.encode()).digest()
    return int.from_bytes(digest[:4], "little"), 1.0 if digest[4] % 2 else -1.0


def _micro(x: np.ndarray) -> np.ndarray:
    """Millionths, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x)


def _pairs(queries: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Packed scores of the documents that share a term or a bucket with a query: rows of up to SLICE documents."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.tokens(F.col("text")).alias("t"), "text")
    size = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean_dl"))
    df = split.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(size)).withColumn("raw", F.log(F.col("n") - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5)))
    asked = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).collect()
    names = sorted({r.query_id for r in queries.select("query_id").collect()})
    vectors = rank.hash_embedding(queries, ["query_id"], settings.hashing_dim).collect()
    terms = queries.sparkSession.createDataFrame([(t,) for t in sorted({r.term for r in asked})], "term string")
    # One pass: the mean over all terms, and the asked ones.
    wanted = idf.join(F.broadcast(terms.withColumn("asked", F.lit(True))), "term", "left")
    found = wanted.agg(F.avg("raw").alias("mean_raw"), F.first("mean_dl").alias("mean_dl"), F.collect_list(F.when(F.col("asked"), F.struct("term", "raw"))).alias("terms")).first()
    weight = {r.term: found.mean_raw * rank.EPSILON if r.raw < 0 else r.raw for r in found.terms}
    number = {t: i for i, t in enumerate(sorted(weight))}
    at = {q: i for i, q in enumerate(names)}
    uses = sorted((number[r.term], at[r.query_id], r.times) for r in asked if r.term in number)
    width, dim = len(names), settings.hashing_dim
    where = np.zeros((dim, width), np.float32)
    aimed = np.zeros((dim, width))
    for r in vectors:
        aimed[r.bucket, at[r.query_id]], where[r.bucket, at[r.query_id]] = r.w, 1
    many = np.bincount([u[0] for u in uses], minlength=len(number)).astype(np.int64)
    shared = queries.sparkSession.sparkContext.broadcast(
        (number, np.array([weight[t] for t in sorted(weight)]), many, np.cumsum(many) - many, np.array([u[1] for u in uses], np.int64), np.array([u[2] for u in uses], float), aimed, where, found.mean_dl or 1.0, names)
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weight, many, first, who, times, aimed, where, mean_dl, names = shared.value
        buckets: dict = {}
        ids_of: dict = {}
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                part = whole.slice(begin, SLICE)
                n = part.num_rows
                ids = part.column(0).to_numpy()
                length = part.column(2).fill_null(0).to_numpy()
                rows, term = _codes(part.column(1), ids_of, lambda w: number.get(w, -1))
                key, tf = np.unique((rows * len(number) + term)[term >= 0], return_counts=True)
                row, term = (key // len(number), key % len(number)) if len(number) else (key, key)
                value = weight[term] * tf * (rank.K1 + 1) / (tf + rank.K1 * (1 - rank.B + rank.B * length[row] / mean_dl))
                n_uses = many[term]
                use = np.arange(int(n_uses.sum())) - np.repeat(np.cumsum(n_uses) - n_uses - first[term], n_uses)
                cell = np.repeat(row, n_uses) * width + who[use]
                lexical = np.bincount(cell, np.repeat(value, n_uses) * times[use], n * width).reshape(n, width)
                met = np.bincount(cell, minlength=n * width).reshape(n, width) > 0
                coded = part.column(3).flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                if len(buckets) > CACHE_WORDS:
                    buckets.clear()
                for w in words:
                    if w not in buckets:
                        buckets[w] = _bucket(w)
                place = np.array([buckets[w][0] % dim for w in words], np.int64)
                sign = np.array([buckets[w][1] for w in words])
                rows = np.repeat(np.arange(n), np.diff(part.column(3).offsets.to_numpy()))
                key, tf = np.unique(rows * max(len(words), 1) + coded.indices.to_numpy(), return_counts=True)
                row, word = key // max(len(words), 1), key % max(len(words), 1)
                cell = row * dim + place[word] if len(word) else key
                vector = np.bincount(cell, sign[word] * np.sqrt(tf) if len(word) else None, n * dim).reshape(n, dim)
                norm = np.sqrt((vector * vector).sum(1, keepdims=True))
                semantic = np.divide(vector, norm, out=np.zeros_like(vector), where=norm > 0) @ aimed
                met |= (np.bincount(cell, minlength=n * dim).reshape(n, dim) > 0).astype(np.float32) @ where > 0
                lexical, semantic = _micro(lexical), _micro(semantic).astype("<i4")
                out: list[list] = [[], [], [], [], [], [], []]
                for q, name in enumerate(names):
                    some = np.flatnonzero(met[:, q])
                    if len(some):
                        packed = (np.diff(ids[some], prepend=0).astype("<i8"), lexical[some, q].astype("<f8"), semantic[some, q], length[some].astype("<i4"))
                        for column, x in zip(out, (name, len(some), False, *[p.tobytes() for p in packed]), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES, strict=True)], schema=_SCHEMA)

    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) > 2)
    none = F.array().cast("array<string>")
    rows = split.where("text is not null").select("doc_id", F.coalesce("t", none).alias("t"), F.size("t").alias("dl"), F.coalesce(words, none).alias("w"))
    return rows.mapInArrow(scored, _PAIRS)


_TYPES = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_SCHEMA = pa.schema(list(zip(["query_id", "docs", "grades", "ids", "lexical", "semantic", "tokens"], _TYPES, strict=True)))


def _scaled(x: np.ndarray) -> np.ndarray:
    """As rank.min_max()."""
    low, high = x.min(), x.max()
    return (x - low) / (high - low) if high - low >= 1e-9 else np.full(len(x), 0.0 if high <= 0 else 1.0)


def _value(strategy: str, ids: np.ndarray, lexical: np.ndarray, semantic: np.ndarray, tokens: np.ndarray, settings: Settings) -> np.ndarray:
    """As rank.fuse(), in millionths. ids are in ascending order."""
    if strategy == "retrieval":
        return _micro(1.0 / (ids + 1))
    if strategy == "rrf":
        x = np.zeros(len(ids))
        for score in (semantic, lexical):
            place = np.empty(len(ids), np.int32)
            place[np.argsort(-score, kind="stable")] = np.arange(1, len(ids) + 1, dtype=np.int32)
            x += 1.0 / (settings.rrf_k + place)
        x = _scaled(x)
    elif strategy in ("lexical", "semantic"):
        x = _scaled((lexical if strategy == "lexical" else semantic) / 1e6)
    else:
        x = settings.alpha * _scaled(semantic / 1e6) + (1 - settings.alpha) * _scaled(lexical / 1e6)
    if strategy != "unweighted" and settings.evidence_k > 0:
        x = x * (tokens / (tokens + settings.evidence_k))
    return _micro(np.clip(x, 0.0, 1.0))


def evaluate(queries: DataFrame, docs: DataFrame, judged: DataFrame, strategies: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """metrics.evaluate() of rank.rank() by each strategy, with a column strategy, over all pairs that share a term or
    a bucket; pos is doc_id.

    queries: query_id (whole number), text; docs: doc_id, text; judged: doc_id, grade. doc_ids are unique in both."""
    ks, most, least = settings.ks, max(settings.ks), settings.relevant_grade
    names = F.explode(F.array(*[F.lit(r.query_id).cast("long") for r in queries.select("query_id").distinct().collect()]))
    grade = judged.where("grade > 0").select(F.col("doc_id").cast("long"), F.col("grade").cast("double"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, SLICE):
                some = part.slice(at, SLICE)
                x = [some.num_rows, True, np.diff(some.column(0).to_numpy(), prepend=0).astype("<i8").tobytes(), some.column(1).to_numpy().astype("<f8").tobytes(), b"", b""]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, _TYPES[1:], strict=True)], schema=pa.schema(list(_SCHEMA)[1:]))

    grades = grade.mapInArrow(packed, _PAIRS.split(", ", 1)[1]).select(names.alias("query_id"), "*")
    kind = "strategy string, query_id long, n_retrieved long, mrr double, " + ", ".join([f"hits{k} long" for k in ks] + [f"dcg{k} double" for k in ks])

    def ranked(name: int, held: list[tuple]) -> list[tuple]:
        read = lambda n, kind, graded: np.frombuffer(b"".join([h[n] for h in held if h[1] == graded]), kind)

        def ids_of(graded: bool) -> np.ndarray:
            own = [np.cumsum(np.frombuffer(h[2], "<i8")) for h in held if h[1] == graded]
            return np.concatenate(own) if own else np.empty(0, np.int64)

        ids, known = ids_of(False), ids_of(True)
        if not len(ids):
            return []
        order, grade, sort = np.argsort(ids), read(3, "<f8", True), np.argsort(known)
        ids, known, grade = ids[order], known[sort], grade[sort]
        lexical, semantic, tokens = read(3, "<f8", False)[order], read(4, "<i4", False)[order], read(5, "<i4", False)[order]
        held.clear()
        at = np.searchsorted(ids, known)
        here = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == known)
        good = at[here & (grade >= least)]
        marks = dict(zip(at[here].tolist(), grade[here].tolist(), strict=True))
        out = []
        for strategy in strategies:
            value = _value(strategy, ids, lexical, semantic, tokens, settings)
            cut = np.partition(value, len(value) - most)[len(value) - most] if len(value) > most else -np.inf
            top = np.flatnonzero(value >= cut)
            top = top[np.argsort(-value[top], kind="stable")][:most].tolist()
            first = 0.0
            if len(good):
                best = value[good].max()
                place = int(good[value[good] == best].min())
                first = 1.0 / (1 + int((value > best).sum()) + int((value[:place] == best).sum()))
            gains = [(marks.get(d, 0.0), 1 / np.log2(n + 1.0)) for n, d in enumerate(top, 1)]
            hits = [sum(g >= least for g, _ in gains[:k]) for k in ks]
            out.append((strategy, name, len(ids), first, *hits, *[float(sum((2.0**g - 1) * w for g, w in gains[:k])) for k in ks]))
        return out

    types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * len(ks), *[pa.float64()] * len(ks)]
    schema = pa.schema(list(zip([c.split()[0] for c in kind.split(", ")], types, strict=True)))

    def by_query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query_id; one query is held at a time."""
        name, held = None, []

        def made() -> Iterator[pa.RecordBatch]:
            rows = ranked(name, held)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

        for part in batches:
            columns = [part.column(i).to_pylist() for i in range(7)]
            for row in zip(*columns, strict=True):
                if row[0] != name:
                    if held:
                        yield from made()
                    name, held = row[0], []
                held.append(row[1:])
        if held:
            yield from made()

    pairs = _pairs(queries, docs, settings).unionByName(grades)
    rows = pairs.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(by_query, kind)
    return metrics.ratios(rows, judged, settings, ["strategy"])
