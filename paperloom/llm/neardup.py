"""MinHash near-duplicates: bottom-k sketches from one hash function, inverted lists, exact Jaccard.

A document is the set of its five-word shingles. One hash function orders all shingles, and each document
retains a bottom-k sketch of its set. k grows with the set so that nothing is lost: of two sets with a
Jaccard similarity of t or more, any n - ceil(t*n) + 1 values of the one hold a value of the other.

1. Equal sets are one class; its smallest doc_id stands for it.
2. Inverted lists of the retained values tell which occur in one class only. A class with k of those can't
   be similar to any other, and is done. Most are.
3. Of the classes left, the full sets are ordered by how many of these classes hold a value, then by hash,
   and the first k values kept; inverted lists of these give the overlaps. First, each member of a list is
   compared with its most central one alone (fewest values of its own), which joins most of a large group
   without its pairs. A pair is dropped if what follows the shared value is too little in either set.
   Then pairs of a list whose members are still in different components are compared, so that no link
   between components is missed.
4. Pairs pass if the common values in the sketch of their union, with all that may follow in either set, could
   still reach t, and are verified on the full sets. No pair above t fails that.
5. Components of the links by large-star and small-star rounds.

All tables between the steps are written to the shared folder; nothing grows on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import keep, release, sized
from .common import HOT_GROUP, WordHashes, ascii_lower_words, batch, lean, shingle_set, sliced, spread_join, spread_lookup, texts

WIDTH = 5
PERCENT = 85
#: Values of either set in the sketch of a union. Sets of up to so many are compared exactly by it.
SKETCH = 256
#: Candidates up to this number (8 bytes each) are broadcast to the documents; with more, texts are shuffled.
JOIN_ROWS = 2_000_000

#: At most so many sets that very many pairs ask for are broadcast.
HOT_SETS = 500

_TOP = 1 << 63


def _set(text: str, cache: WordHashes) -> np.ndarray:
    """Sorted 63-bit hashes of a text's distinct shingles."""
    return (shingle_set(ascii_lower_words(text), cache, WIDTH) >> np.uint64(1)).astype(np.int64)


def _first(n: int, percent: int) -> int:
    """How many of n values a sketch needs."""
    return n - -(-percent * n // 100) + 1


def _k(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / F.lit(100)) + 1


def _sketched(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, a fingerprint of the set, and the sketch: all values of the lowest share of the hash range, and
    the k smallest if those are fewer."""
    low = int(_TOP * min(1.0, (100 - percent) / 100 * 1.6 + 0.01))
    schema = pa.schema([("n", pa.int64()), ("fp", pa.binary()), ("n_low", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        cache = WordHashes()
        for part in sliced(batches):
            rows = []
            for text in part.column(1):
                s = _set(text.as_py(), cache)
                below = int(np.searchsorted(s, low)) if len(s) else 0
                fp = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                rows.append((len(s), fp, below, s[: max(below, _first(len(s), percent))].copy() if len(s) else s))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([part.column(0), *batch(dict(zip(schema.names, cols, strict=True)), schema).columns], names=["doc_id", *schema.names])

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, fp binary, n_low bigint, sketch array<bigint>")


def _full(docs: DataFrame) -> DataFrame:
    """doc_id, n and the whole set of each text."""
    schema = pa.schema([("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        cache = WordHashes()
        for part in sliced(batches):
            sets = [_set(text.as_py(), cache) for text in part.column(1)]
            made = batch({"n": [len(s) for s in sets], "s": sets}, schema)
            yield pa.RecordBatch.from_arrays([part.column(0), *made.columns], names=["doc_id", "n", "s"])

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, s array<bigint>")


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """The classes with fewer than k retained values that no other class retains."""
    lists = classes.select("doc_id", F.explode(F.slice("sketch", F.lit(1), F.col("n_low"))).alias("v"))
    often = lists.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("v")
    shared = lists.join(often, "v", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))
    sizes = classes.select("doc_id", "n", "n_low")
    left = sizes.join(shared, "doc_id", "left").where(F.col("n_low") - F.coalesce("shared", F.lit(0)) < _k(F.col("n"), percent))
    return left.select("doc_id")


def _lists(full: DataFrame, percent: int) -> DataFrame:
    """v, doc_id, n, alone and left: the inverted lists of the first k values of each set, rare ones before common ones.

    alone is how many values of the set no other set holds, left how many values from v on the set has."""
    lists = full.select("doc_id", "n", F.explode("s").alias("v"))
    often = lists.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = lists.join(often, "v").groupBy("doc_id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("at"))
    alone = F.col("n") - F.size("at")  # values that no other set holds come first and pair with nothing
    first = F.slice("at", F.lit(1), F.greatest(_k(F.col("n"), percent) - alone, F.lit(0)).cast("int"))
    shared = shared.select("doc_id", "n", alone.cast("bigint").alias("alone"), F.posexplode(F.transform(first, lambda x: x["v"])).alias("i", "v"))
    return shared.select("v", "doc_id", "n", "alone", (F.col("n") - F.col("alone") - F.col("i")).alias("left"))


def _may_link(percent: int) -> Column:
    """Whether sets of na and nb values can be similar if the first value they share has la and lb from it on."""
    most = F.least("la", "lb")
    return most * 100 >= (F.col("na") + F.col("nb") - most) * percent


def _links(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a kept table, whose sets are similar: by the sketch of their union first, then exactly."""
    sides = [full.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.slice("s", 1, SKETCH).alias(f"k{x}")) for x in "ab"]
    met = spread_lookup(spread_lookup(pairs, sides[0], "a", pairs, HOT_SETS), sides[1], "b", pairs, HOT_SETS)
    # Both sketches are complete up to the smaller of their last values, so the union's sketch ends there.
    whole = lambda x: F.when(F.col(f"n{x}") <= SKETCH, F.lit(_TOP - 1)).otherwise(F.element_at(f"k{x}", -1))
    met = met.withColumn("end", F.least(whole("a"), whole("b")))
    ka, kb = (F.filter(f"k{x}", lambda v: v <= F.col("end")) for x in "ab")
    # What the sketches don't show may be the same at best; so many common values are needed.
    most = F.size(F.array_intersect(ka, kb)) + F.least(F.col("na") - F.size(ka), F.col("nb") - F.size(kb))
    likely = keep(met.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b"), "likely")
    sides = [full.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab"]
    met = spread_lookup(spread_lookup(likely, sides[0], "a", likely, HOT_SETS), sides[1], "b", likely, HOT_SETS).withColumn("same", F.size(F.array_intersect("sa", "sb")))
    return met.where(F.col("same") * 100 >= (F.col("na") + F.col("nb") - F.col("same")) * percent).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest id reachable) of the ids in links (a, b) but the smallest of each."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
        seen = mark
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = keep(small.union(least).distinct(), "edges")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept.

    docs: doc_id, text; further columns are ignored. A-Z are lower-cased; words stand between ASCII white
    space. Documents are linked if 100 * (common shingles) >= percent * (shingles of both together); with
    fewer than five words the whole sequence is the one shingle; null, empty and blank texts have none and
    are linked with nothing. component_id is the smallest doc_id reachable, itself included; kept is true for
    that one. Rows with a null doc_id take no part: component_id null, kept true. Rows that repeat a doc_id
    are separate texts under one id. An empty table gives no rows.
    """
    source = texts(docs)
    sketched = keep(_sketched(source, percent), "sketches")
    linked = sketched.where("n > 0 and doc_id is not null")
    classes = linked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("n_low").alias("n_low"), F.first("sketch").alias("sketch"))
    left = keep(_candidates(classes, percent), "candidates")
    full = keep(_full(source.join(sized(left, JOIN_ROWS), "doc_id", "left_semi")), "sets")
    lists = keep(_lists(full, percent), "lists")
    hubs = lists.groupBy("v").agg(F.min(F.struct("alone", "doc_id", "n", "left")).alias("h"), F.count(F.lit(1)).alias("df")).where("df > 1")
    hubs = keep(hubs, "hubs")
    first = spread_join(lists, hubs, ["v"], "df").select(
        F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"),
        F.col("h.doc_id").alias("b"), F.col("h.n").alias("nb"), F.col("h.left").alias("lb"),
    )
    first = keep(first.where((F.col("a") != F.col("b")) & _may_link(percent)).select("a", "b").distinct(), "pairs")
    links = keep(_links(first, full, percent), "links")
    release(hubs, first)
    placed = lists.join(components(links), "doc_id", "left").withColumn("c", F.coalesce("component_id", "doc_id")).select("v", "doc_id", "n", "left", "c")
    every = placed = keep(placed, "placed")
    release(lists)
    mixed = keep(placed.groupBy("v").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count(F.lit(1)).alias("df")).where("least < most").select("v", "df"), "mixed")
    # With nothing but a join between its shuffles, Spark itself splits the lists that are long.
    placed = spread_join(placed, mixed, ["v"], "df").select("v", "doc_id", "n", "left", "c")
    sides = [placed.select("v", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("left").alias(f"l{x}"), F.col("c").alias(f"c{x}")) for x in "ab"]
    rest = keep(sides[0].join(sides[1], "v").where((F.col("ca") > F.col("cb")) & _may_link(percent)).select("a", "b").distinct(), "pairs")
    reached = components(links.union(_links(rest, full, percent)))
    ids = linked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    ids = ids.join(reached.withColumnRenamed("doc_id", "first_id"), "first_id", "left").select("fp", "copies", F.coalesce("component_id", "first_id").alias("c"))
    ids = keep(ids, "classes")
    release(full, every, mixed, links, rest, left)
    rows = sketched.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"))
    # A class with very many copies would meet in one task; such classes are few, and go to all tasks instead. Rows
    # without words have no class to meet.
    none = rows.where("fp is null").withColumn("c", F.lit(None).cast(rows.schema["doc_id"].dataType))
    placed = spread_join(rows.where("fp is not null"), ids, ["fp"], "copies").drop("copies").unionByName(none)
    component = F.coalesce("c", "doc_id")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component.eqNullSafe(F.col("doc_id"))).alias("kept"))
