"""Models from outside, where there are any: embedders, entity taggers and text providers, with their fallbacks.

A model is a name and a function that loads it. It is loaded once in each Python worker, and once on the driver to
see whether it can be: if not, the next one is taken, and the choice and its reason are reported."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..config import DEFAULTS
from .entities import entity_label, trusted
from .summaries import _Terms, _vectors

#: Texts that a model is given at once.
BATCH = 32


@dataclass(frozen=True)
class Model:
    """name: what reports and caches call it; load: gives the function that does the work."""

    name: str
    load: Callable[[], Callable]


@dataclass(frozen=True)
class Choice:
    """The model in use, and what was wrong with those before it."""

    model: Model
    reasons: tuple[str, ...]


def choose(models: list[Model], fallback: Model, probe: object, wanted: str | None = None) -> Choice:
    """The first model that loads and answers the probe, of the wanted name if one is; else the fallback."""
    reasons = []
    for model in models:
        if wanted is not None and model.name != wanted:
            continue
        try:
            model.load()(probe)
        except Exception as error:  # whatever a model may raise, the search goes on without it
            reasons.append(f"{model.name}: {type(error).__name__}")
            continue
        return Choice(model, tuple(reasons))
    return Choice(fallback, tuple(reasons) or ((f"{wanted}: unknown",) if wanted else ()))


def _hashing() -> Callable[[list[str]], np.ndarray]:
    known = _Terms(DEFAULTS.hashing_dim)
    return lambda texts: _vectors(texts, known)


#: The embedder that is always there.
HASHING = Model(f"hashing-{DEFAULTS.hashing_dim}", _hashing)


def embed(texts: DataFrame, choice: Choice) -> DataFrame:
    """texts (with a column text; null is empty) with vector and embedder. Row by row, BATCH texts at once."""
    load, name = choice.model.load, choice.model.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for part in batches:
            encode = encode or load()
            own = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            made = [row for at in range(0, len(own), BATCH) for row in np.asarray(encode(own[at : at + BATCH]), float).tolist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.float64())), pa.array([name] * len(own))], names=[*part.schema.names, "vector", "embedder"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, f"{kinds}, vector array<double>, embedder string")


#: The tagger that is always there finds nothing; the pattern pass stands for itself.
PATTERNS = Model("patterns", lambda: lambda texts: [[] for _ in texts])

_TAGS = "id {id}, field string, text string, raw_label string, start int, end int"


def tagged(papers: DataFrame, choice: Choice) -> DataFrame:
    """id, field, text, label, raw_label, start and end of what a tagging model finds in title and abstract and is
    believed. The model gives (start, end, raw label) for each of many texts. Leading articles go."""
    load = choice.model.load
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in ("title", "abstract")]))
    each = papers.select("id", fields.alias("f")).where("f.t is not null").select("id", "f.field", F.col("f.t").alias("t"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = None
        for part in parts:
            tag = tag or load()
            own = part["t"].tolist()
            spans = [s for at in range(0, len(own), BATCH) for s in tag(own[at : at + BATCH])]
            rows = [(i, f, t[a:b], raw, a, b) for i, f, t, found in zip(part["id"], part["field"], own, spans, strict=True) for a, b, raw in found]
            yield pd.DataFrame(rows, columns=["id", "field", "text", "raw_label", "start", "end"])

    found = each.mapInPandas(run, _TAGS.format(id=papers.schema["id"].dataType.simpleString()))
    article = F.regexp_extract("text", r"(?i)^((?:the|a|an)\s+)", 1)
    found = found.withColumns({"text": F.regexp_replace("text", r"(?i)^(?:the|a|an)\s+", ""), "start": F.col("start") + F.length(article), "label": entity_label(F.col("raw_label"))})
    found = found.where(F.col("label").isNotNull() & (F.col("text") != "") & trusted(F.col("raw_label"), F.col("text"), F.col("field")))
    return found.select("id", "field", "text", "label", "raw_label", "start", "end")


@dataclass(frozen=True)
class Provider:
    """A text provider. ask: gives status, headers and text for a prompt."""

    name: str
    ask: Callable[[str], tuple[int, dict[str, str], str | None]]


def choose_provider(name: str | None, key: str | None, known: dict[str, Callable[[str], Provider]]) -> Provider | None:
    """The provider of that name, opened with the key; None for no name, "none", an unknown one, or without a key."""
    make = known.get((name or "none").strip().lower())
    return make(key) if make and key else None


def no_quota(headers: Column) -> Column:
    """Whether a map of headers says that nothing is left: any remaining-… count of 0."""
    return F.exists(F.map_entries(headers), lambda h: F.lower(h["key"]).rlike("ratelimit.*remaining|remaining.*ratelimit") & (F.trim(h["value"]) == "0"))


def _left(headers: dict[str, str]) -> bool:
    return not any("ratelimit" in k.lower() and "remaining" in k.lower() and v.strip() == "0" for k, v in headers.items())


def completion(provider: Provider, retries: int = 2) -> Callable[[Column], Column]:
    """A column function from prompt to text for summaries.summarise(): null where the provider fails, gives nothing, or
    says that its quota is used up, after which it isn't asked again by this task."""

    def ask(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spent = False

        def one(prompt: str) -> str | None:
            nonlocal spent
            for _ in range(retries + 1):
                if spent:
                    return None
                status, headers, text = provider.ask(prompt)
                if status == 200:
                    return (text or "").strip() or None
                spent = status == 429 and not _left(headers)
                if status not in (429, 500, 502, 503, 504):
                    return None
            return None

        for some in prompts:
            yield some.map(one).astype(object)

    ask.__annotations__ = {"prompts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda prompt: pandas_udf(ask, StringType())(prompt)
