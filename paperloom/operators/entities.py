"""Entities: pattern matches with places, the trust guard, merging of occurrences, highlighting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions import lexicon as L
from ..functions import text as T

_PATTERNS = [re.compile(p) for p in (L.SEQ_ASSAY, L.ACRONYM, L.PREFIXED_SYMBOL)]
_SKIPPED = set(L.SECTION_LABELS) | set(L.ACRONYM_STOPWORDS)


def spans_of(text: str | None) -> list[dict]:
    """Matches of the three patterns in order of pattern; a later one yields where it overlaps an earlier one."""
    found: list[dict] = []
    claimed: list[tuple[int, int]] = []
    for pattern in _PATTERNS:
        for m in pattern.finditer(text or ""):
            start, end = m.span()
            if m[0] in _SKIPPED or any(start < b and a < end for a, b in claimed):
                continue
            claimed.append((start, end))
            found.append({"text": m[0], "start": start, "end": end})
    return found


@pandas_udf(ArrayType(StructType().add("text", StringType()).add("start", IntegerType()).add("end", IntegerType())))
def entity_spans(x: pd.Series) -> pd.Series:
    """No built-in function tells where a pattern matches."""
    return x.map(spans_of)


def occurrences(papers: DataFrame) -> DataFrame:
    """id, field, text, label, raw_label, start, end of pattern entities in title and abstract."""
    fields = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("title").alias("field"), F.col("title").alias("t")), F.struct(F.lit(1).alias("n"), F.lit("abstract").alias("field"), F.col("abstract").alias("t"))))
    each = papers.select("id", fields.alias("f")).where("f.t is not null").select("id", "f.n", "f.field", F.posexplode(entity_spans("f.t")).alias("i", "s"))
    return each.select("id", "n", "i", "field", "s.text", F.lit("technical_term").alias("label"), F.lit("PATTERN").alias("raw_label"), "s.start", "s.end")


def trusted(raw_label: Column, text: Column, field: Column) -> Column:
    """Whether a general tagging model is believed: organisations and people, outside titles, not term-shaped; a
    single-word organisation needs a telling ending."""
    shaped = F.lit(False)
    for p in (L.ACRONYM, L.PREFIXED_SYMBOL, L.SEQ_ASSAY):
        shaped = shaped | text.rlike(p)
    one_word = ~F.trim(text).rlike(r"\s")
    ending = F.exists(T.words_in(L.ORG_SUFFIXES), lambda s: F.lower(text).endswith(s))
    return raw_label.isin("ORG", "PERSON") & (field != "title") & ~shaped & (~((raw_label == "ORG") & one_word) | ending)


def entity_label(raw_label: Column) -> Column:
    """The entity label of a model's label; null for those that are dropped."""
    table = F.create_map(*[F.lit(x) for kv in L.RAW_LABELS.items() for x in kv])
    return F.when(~raw_label.isin(L.DISCARDED_LABELS), F.coalesce(F.try_element_at(table, raw_label), F.lit("other")))


def merge_occurrences(found: DataFrame) -> DataFrame:
    """id, pos, text, label, raw_label, count, in_title and spans, by lower-case text.

    The label is the one that is scientific, then frequent, then last by name; the surface the most frequent,
    then earliest one. Order: in titles first, then count, then scientific, then first place."""
    rows = found.withColumn("key", F.lower("text")).withColumn("at", F.struct("n", "start", "i")).withColumn("sci", F.col("label").isin(L.SCIENTIFIC_LABELS).cast("int"))
    label = rows.groupBy("id", "key", "label").agg(F.max("sci").alias("sci"), F.count(F.lit(1)).alias("c"), F.min_by("raw_label", "at").alias("raw_label"))
    label = label.groupBy("id", "key").agg(F.max(F.struct("sci", "c", "label", "raw_label")).alias("best"))
    surface = rows.groupBy("id", "key", "text").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("at"))
    surface = surface.groupBy("id", "key").agg(F.min_by("text", F.struct(-F.col("c"), "at")).alias("text"))
    spans = rows.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("field", "start", "end"))).alias("spans"), F.bool_or(F.col("field") == "title").alias("in_title"), F.min("at").alias("first"))
    met = spans.join(label, ["id", "key"]).join(surface, ["id", "key"]).withColumn("count", F.size("spans"))
    order = Window.partitionBy("id").orderBy(F.desc("in_title"), F.desc("count"), F.desc("best.sci"), "first", "key")
    return met.select("id", F.row_number().over(order).alias("pos"), "text", F.col("best.label").alias("label"), F.col("best.raw_label").alias("raw_label"), "count", "in_title", "spans")


def surfaces(text: Column, pattern: str = L.ACRONYM) -> Column:
    """What one pattern matches in a text, without places."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda s: ~s.isin(sorted(_SKIPPED)))


def highlight(text: Column, spans: Column) -> Column:
    """array<struct<part, marked>>: a text cut at its spans (start, end) in order; overlaps and spans outside are skipped."""
    piece = "array<struct<part:string,marked:boolean>>"
    usable = F.array_sort(F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["start"] < s["end"])))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(piece).alias("parts"))

    def step(state: Column, s: Column) -> Column:
        cut = lambda a, b, mark: F.struct(F.substring(text, a + 1, b - a).alias("part"), F.lit(mark).alias("marked"))
        plain = F.when(s["start"] > state["at"], F.array(cut(state["at"], s["start"], False))).otherwise(F.array().cast(piece))
        taken = F.struct(s["end"].alias("at"), F.concat(state["parts"], plain, F.array(cut(s["start"], s["end"], True))).alias("parts"))
        return F.when(s["start"] >= state["at"], taken).otherwise(state)

    def finish(state: Column) -> Column:
        rest = F.struct(F.substring(text, state["at"] + 1, F.length(text)).alias("part"), F.lit(False).alias("marked"))
        return F.when(state["at"] < F.length(text), F.concat(state["parts"], F.array(rest))).otherwise(state["parts"])

    return F.aggregate(usable, start, step, finish)


def labels_present(entities: Column) -> Column:
    return F.array_distinct(F.transform(entities, lambda e: e["label"]))
