"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are grouped by the size of their shingle set. Of each item the sketch holds its smallest hash
values under one hash function, as many as make a miss impossible: a document that holds at least the
share t of an item's m shingles holds at least one of any m - ceil(t*m) + 1 of them. So, unlike a banded
sketch of the long document, whose Jaccard similarity with a short item is near zero, no match is lost.
A document looks up its own shingle hashes in the sketches of those size groups that it is large enough
to contain; each hit is verified by the exact containment of the item's full shingle set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batch, distinct, lean, sequence_hashes

WIDTH = 5
THRESHOLD = 0.8
#: Shingles of benchmark items sent to the executors at once (8 bytes each, twice); more items go in further blocks.
BLOCK_SHINGLES = 1_000_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and underscores: case and punctuation don't hide a passage."""
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text.lower())]


def _needed(size: int, percent: int) -> int:
    return -(-percent * size // 100)


class Index:
    """The sketches and full sets of one block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], percent: int):
        """items: id, distinct shingle hashes, and the words in each of its shingles."""
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, s, _ in items]
        self.need = [_needed(len(s), percent) for s in self.sets]
        groups: dict[tuple[int, int], list[int]] = {}
        for k, (_, s, wide) in enumerate(items):
            groups.setdefault((wide, len(s).bit_length()), []).append(k)
        #: (words in a shingle, least shingles a document needs, sorted sketch values, their items)
        self.parts = []
        for (wide, _), members in sorted(groups.items()):
            value = np.concatenate([self.sets[k][: len(self.sets[k]) - self.need[k] + 1] for k in members])
            owner = np.concatenate([np.full(len(self.sets[k]) - self.need[k] + 1, k, np.int64) for k in members])
            order = np.argsort(value, kind="stable")
            self.parts.append((wide, min(self.need[k] for k in members), value[order], owner[order]))

    def matches(self, hashed: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """id, shared and all shingles of each item that a document with these word hashes contains."""
        own: dict[int, np.ndarray] = {}
        found: set[int] = set()
        for wide, least, value, owner in self.parts:
            if wide not in own:
                enough = len(hashed) >= wide or wide == WIDTH and len(hashed) > 0
                own[wide] = distinct(sequence_hashes(hashed, wide)) if enough else hashed[:0]
            mine = own[wide]
            if len(mine) < least:
                continue
            first, last = np.searchsorted(value, mine), np.searchsorted(value, mine, side="right")
            for a, b in zip(first[hit := first < last], last[hit], strict=True):
                found.update(((wide, k) for k in owner[a:b].tolist()))
        for wide, k in sorted(found, key=lambda x: x[1]):
            mine, full = own[wide], self.sets[k]
            at = np.minimum(np.searchsorted(mine, full), len(mine) - 1)
            shared = int((mine[at] == full).sum())
            if shared >= self.need[k]:
                yield self.ids[k], shared, len(full)


def _blocks(rows, percent: int) -> Iterator[Index]:
    cache, block, held = WordHashes(), [], 0
    for row in rows:
        words = words_of(row[1] or "")
        if not words or row[0] is None:
            continue
        hashed = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        wide = min(WIDTH, len(words))
        found = distinct(sequence_hashes(hashed, wide))
        block.append((row[0], found, wide))
        held += len(found)
        if held >= BLOCK_SHINGLES:
            yield Index(block, percent)
            block, held = [], 0
    if block:
        yield Index(block, percent)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and benchmark item that it contains: doc_id, item_id, n_shared, n_item, containment.

    docs: doc_id, text; items: item_id, text; further columns are ignored. Words are lower-cased runs of
    letters, digits and underscores; an item is the set of its distinct five-word shingles, or the one
    sequence of its words if it has fewer. A document contains an item if at least `threshold` (in whole
    per cents) of them occur in it, wherever they stand. Null and empty texts, and items without words or
    with a null id, match nothing; repeated rows give repeated matches; empty tables give no rows.
    The items are read in blocks of BLOCK_SHINGLES, each broadcast and searched in one pass over docs
    that shuffles nothing; memory is bounded by a block and the longest text.
    """
    spark = docs.sparkSession
    percent = round(threshold * 100)
    out = pa.schema([("at", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])
    kind = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint"
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    result = None
    for index in _blocks(items.select(F.col("item_id").cast("bigint"), "text").toLocalIterator(), percent):
        shared = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            cache = WordHashes()
            for part in batches:
                rows: list[tuple[int, int, int, int]] = []
                for at, text in enumerate(part.column(1)):
                    words = words_of(text.as_py())
                    hashed = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                    rows += [(at, *m) for m in shared.value.matches(hashed)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                found = batch(dict(zip(out.names, cols, strict=True)), out)
                ids = part.column(0).take(found.column(0))
                yield pa.RecordBatch.from_arrays([ids, *found.columns[1:]], names=["doc_id", *out.names[1:]])

        part = source.mapInArrow(lean(search), kind)
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = spark.createDataFrame([], kind)
    return result.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that contain no item, with all their columns. Rows with a null doc_id stay."""
    return docs.join(contaminated(docs, items, threshold).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
