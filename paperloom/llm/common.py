"""Helpers shared by the training-data operators: word and shingle hashes, besides the working tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import sized

#: Entries kept in a worker's word cache before it starts anew; bounds memory, not results.
CACHE_WORDS = 100_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) only, so that further columns of the input can't clash; null texts are empty."""
    return docs.select(F.col(key), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Groups of at least so many rows aren't dealt out by their key, as long as there are no more than HOT_GROUPS.
HOT_GROUP, HOT_GROUPS = 200, 100_000


def spread_join(rows: DataFrame, groups: DataFrame, key: list[str], members: str, bound: int = HOT_GROUPS) -> DataFrame:
    """rows joined with groups, a kept table, by its unique key. members: the column of groups that says how many rows a
    group may have.

    The groups of HOT_GROUP rows and more, of which there are few, are broadcast (if no more than `bound`), and their
    rows dealt out by their other columns; the rest is joined by a shuffle. rows are computed once."""
    hot = groups.where(F.col(members) >= HOT_GROUP)
    if not 0 < hot.limit(bound + 1).count() <= bound:
        return rows.join(groups, key)
    own = F.struct(*[c for c in groups.columns if c not in key])
    met = rows.join(F.broadcast(hot.select(*key, own.alias("_hot"))), key, "left")
    met = met.withColumn("_part", F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("bigint")))
    cold = groups.where(F.col(members) < HOT_GROUP).select(*key, own.alias("_cold"), F.lit(0).cast("bigint").alias("_part"))
    met = met.join(cold, [*key, "_part"], "left").withColumn("_group", F.coalesce("_hot", "_cold")).where("_group is not null")
    return met.select(*key, *[c for c in rows.columns if c not in key], "_group.*")


def spread_lookup(rows: DataFrame, table: DataFrame, key: str, asked: DataFrame, bound: int) -> DataFrame:
    """rows joined with table by its unique key. asked: the rows' keys.

    The table's rows that HOT_GROUP rows and more ask for are broadcast (if no more than `bound`), so that they don't
    meet in one task; the others are joined by a shuffle."""
    often = asked.groupBy(key).agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= HOT_GROUP).select(key)
    if not 0 < often.limit(bound + 1).count() <= bound:
        return rows.join(table, key)
    often = F.broadcast(often)
    hot = F.broadcast(table.join(often, key, "left_semi"))
    return rows.join(hot, key).unionByName(rows.join(often, key, "left_anti").join(table, key))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to CACHE_WORDS entries."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ascii_lower_words(text: str) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes; with fewer words, one of the whole sequence. Not distinct."""
    n = len(words)
    if n == 0:
        return words
    wide = min(width, n)
    acc = words[: n - wide + 1].copy()
    for i in range(1, wide):
        acc = acc * _STEP + words[i : n - wide + 1 + i]
    acc ^= acc >> np.uint64(32)
    acc *= _MIX
    acc ^= acc >> np.uint64(29)
    return acc if wide == width else acc ^ np.uint64(wide)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def shingle_set(words: list[bytes], cache: WordHashes, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a document's words."""
    hashed = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    return distinct(sequence_hashes(hashed, width))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, to bound what a task makes of a batch at once."""
    for part in batches:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


#: The one large structure that a Python worker remembers between tasks, such as a vocabulary's codec, by its key.
_REMEMBERED: dict[str, object] = {}


def remembered(key: str, build: Callable[[], object]):
    """What build() made for this key in this worker; what was remembered for another key is dropped first."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = build()
    return _REMEMBERED[key]


def give_back() -> None:
    """Memory that is free in this process goes back to the system; the C library and Arrow would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable, remembers: bool = False) -> Callable:
    """run, a function over a task's batches, such that its worker, which waits beside the JVM for more tasks, holds no
    memory that it doesn't need: what other operators have remembered goes first, what is free at the end."""

    def leaning(batches):
        if not remembers:
            _REMEMBERED.clear()
        yield from run(batches)
        give_back()

    return leaning
