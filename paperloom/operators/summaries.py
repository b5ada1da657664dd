"""Extractive summaries, grounding checks, sentence support, quality scores and the summary policy."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..config import DEFAULTS, Settings
from ..functions import lexicon as L
from ..functions import text as T
from ..tables import keep

ISSUE = "array<struct<kind:string,detail:string,severity:string,span:string>>"


def extractive(papers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id and summary: the best sentences of the abstract in their order; the title where there is no abstract.

    A sentence scores its overlap with the title, 1 for announcing a finding, 0.5 in first and 0.3 in one of
    the last two places; of equal scores the later one wins. Row by row, without a shuffle. papers: doc_id, title,
    abstract."""
    most = settings.summary_sentences
    each = papers.select("doc_id", "title", "abstract", T.abstract_sentences(F.coalesce("abstract", F.lit(""))).alias("s"), T.content_words(F.col("title")).alias("tw"))
    each = each.withColumn("tn", F.greatest(F.size("tw"), F.lit(1))).withColumn("n", F.size("s"))
    worded = F.transform("s", lambda x, i: F.struct(T.content_words(x).alias("w"), F.exists(T.words_in(L.FINDING_MARKERS), lambda m: F.contains(F.lower(x), m)).alias("found"), i.alias("i")))

    def scored(x: Column) -> Column:
        place = F.when(x["i"] == 0, 0.5).when(x["i"] >= F.col("n") - 2, 0.3).otherwise(0.0)
        score = F.size(F.array_intersect(x["w"], F.col("tw"))) / F.col("tn") + F.when(x["found"], 1.0).otherwise(0.0) + place
        return F.struct(F.round(score, 9).alias("score"), x["i"].alias("i"))

    # Sentences are parted in a projection of their own, so that they are parted once.
    each = each.withColumn("x", F.when(F.col("n") > most, F.transform(F.filter(worded, lambda x: F.size(x["w"]) > 0), scored)))
    best = F.array_sort(F.transform(F.slice(F.sort_array("x", asc=False), 1, most), lambda x: x["i"]))
    chosen = F.array_join(F.transform(best, lambda i: F.get("s", i)), " ")
    text = (
        F.when(F.coalesce(F.trim("abstract"), F.lit("")) == "", F.trim("title")).when(F.col("n") == 0, F.trim("abstract"))
        .otherwise(F.when(F.size("x") > 0, chosen).otherwise(F.array_join(F.slice("s", 1, most), " ")))
    )
    return each.select("doc_id", text.alias("summary"))


def _issue(kind: str, detail: Column, span: Column, severity: str = "blocking") -> Column:
    return F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), F.lit(severity).alias("severity"), span.alias("span"))


@dataclass(frozen=True)
class Parts:
    """What the checks read of a summary and its abstract. As columns of their own they are made once a row; inside
    the checks' lambdas they would be made again for each element."""

    summary_words: Column
    abstract_words: Column
    abstract_numbers: Column
    abstract_lower: Column

    @classmethod
    def of(cls, summary: Column, abstract: Column) -> Parts:
        return cls(T.content_words(summary), T.content_words(abstract), F.transform(T.numbers(abstract), T.normalize_number), F.lower(abstract))

    @classmethod
    def added(cls, texts: DataFrame, summary: str, abstract: str) -> tuple[DataFrame, Parts]:
        """texts with the parts as columns."""
        made = cls.of(F.col(summary), F.col(abstract))
        names = [f"_part_{f.name}" for f in fields(cls)]
        return texts.withColumns({n: getattr(made, f.name) for n, f in zip(names, fields(cls), strict=True)}), cls(*map(F.col, names))


def fabricated_numbers(summary: Column, abstract: Column, parts: Parts | None = None) -> Column:
    """Numbers of the summary, each time they occur, that the abstract doesn't have."""
    known = (parts or Parts.of(summary, abstract)).abstract_numbers
    return F.filter(T.numbers(summary), lambda n: (T.normalize_number(n) != "") & ~F.array_contains(known, T.normalize_number(n)))


def fabricated_entities(summary: Column, abstract: Column, parts: Parts | None = None) -> Column:
    """Term-shaped words of the summary that the abstract never names, first spellings."""
    lower = (parts or Parts.of(summary, abstract)).abstract_lower
    found = F.concat(*[F.regexp_extract_all(summary, F.lit(f"({p})"), 1) for p in (L.ACRONYM, L.PREFIXED_SYMBOL)])
    first = F.array_distinct(F.transform(found, F.lower))
    absent = F.filter(first, lambda t: ~F.contains(lower, t))
    return F.transform(absent, lambda t: F.element_at(F.filter(found, lambda x: F.lower(x) == t), 1))


def overlap(summary: Column, abstract: Column, parts: Parts | None = None) -> Column:
    """Share of the summary's content words that the abstract has; 0 without any."""
    p = parts or Parts.of(summary, abstract)
    return F.coalesce(F.size(F.array_intersect(p.summary_words, p.abstract_words)) / F.nullif(F.size(p.summary_words), F.lit(0)), F.lit(0.0))


def reversed_directions(summary: Column, abstract: Column, parts: Parts | None = None) -> Column:
    """Words of direction in the summary where the abstract has only the opposite."""
    p = parts or Parts.of(summary, abstract)
    both = [(a, b) for pair in L.ANTONYMS for a, b in (pair, pair[::-1])]
    stated = F.array_intersect(T.words_in([a for a, _ in both]), F.array_except(p.summary_words, p.abstract_words))
    opposite = F.create_map(*[F.lit(x) for kv in both for x in kv])
    return F.filter(stated, lambda w: F.array_contains(p.abstract_words, F.element_at(opposite, w)))


def overclaims(summary: Column, abstract: Column, parts: Parts | None = None) -> Column:
    p = parts or Parts.of(summary, abstract)
    return F.array_sort(F.array_except(F.array_intersect(p.summary_words, T.words_in(L.OVERCLAIMS)), p.abstract_words))


def format_problem(summary: Column, settings: Settings = DEFAULTS) -> Column:
    """What is wrong with a summary's length, or null."""
    n = T.count_sentences(summary)
    return F.when(F.coalesce(summary, F.lit("")) == "", "empty").when(n > settings.max_sentences, "too long").when(n < 1, "no sentence")


def with_verdict(texts: DataFrame, summary: str = "summary", abstract: str = "abstract", settings: Settings = DEFAULTS, name: str = "v") -> DataFrame:
    """texts with the verdict of their summaries; what the checks share is made once a row."""
    made, parts = Parts.added(texts, summary, abstract)
    return made.withColumn(name, verdict(F.col(summary), F.col(abstract), settings, parts)).select(*texts.columns, name)


def verdict(summary: Column, abstract: Column, settings: Settings = DEFAULTS, parts: Parts | None = None) -> Column:
    """struct(status, issues, overlap): unverifiable without abstract, ungrounded with a blocking issue, else grounded."""
    no = F.array().cast(ISSUE)
    share = overlap(summary, abstract, parts)
    problem = format_problem(summary, settings)
    issues = F.concat(
        F.when(problem.isNotNull(), F.array(_issue("format", problem, F.lit(None).cast("string")))).otherwise(no),
        F.transform(fabricated_numbers(summary, abstract, parts), lambda n: _issue("fabricated_number", F.concat(F.lit("the abstract has no "), F.trim(n)), F.trim(n))),
        F.transform(fabricated_entities(summary, abstract, parts), lambda t: _issue("fabricated_entity", F.concat(F.lit("the abstract never names "), t), t)),
        F.when(share < settings.min_overlap, F.array(_issue("low_overlap", F.lit("too few content words in common"), F.lit(None).cast("string")))).otherwise(no),
        F.transform(reversed_directions(summary, abstract, parts), lambda w: _issue("contradicted_direction", F.concat(F.lit("the abstract says the opposite of "), w), w)),
        F.transform(overclaims(summary, abstract, parts), lambda w: _issue("overclaim", F.concat(F.lit("the abstract does not claim "), w), w)),
    )
    blank = F.coalesce(F.trim(abstract), F.lit("")) == ""
    blocked = F.exists(issues, lambda i: i["severity"] == "blocking")
    status = F.when(blank, "unverifiable").when(blocked, "ungrounded").otherwise("grounded")
    return F.struct(status.alias("status"), F.when(blank, no).otherwise(issues).alias("issues"), F.when(blank, 0.0).otherwise(share).alias("overlap"))


def windows(s: Column, most: int = DEFAULTS.support_window) -> Column:
    """All runs of 1 to `most` neighbouring sentences, joined."""
    n = F.size(s)

    def runs(w: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - (w - 1), F.lit(1)))
        return F.when(n >= w, F.transform(starts, lambda i: F.array_join(F.slice(s, i, w), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(w) for w in range(1, most + 1)])


class _Terms(dict):
    """Bucket and sign of hashed words, as hash_embedding() gives them."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, term: str) -> tuple[int, float]:
        if len(self) >= 100_000:
            self.clear()
        raw = hashlib.md5(term.encode(), usedforsecurity=False).digest()
        value = self[term] = int.from_bytes(raw[:4], "little") % self.dim, 1.0 if raw[4] % 2 else -1.0
        return value


_TERM = re.compile("[a-z0-9]{3,}")


def _vectors(texts: list[str], known: _Terms) -> np.ndarray:
    """Unit vectors of signed hashed words, a row for each text."""
    out = np.zeros((len(texts), known.dim))
    for row, text in zip(out, texts, strict=True):
        for term, n in Counter(_TERM.findall(text.lower())).items():
            at, sign = known[term]
            row[at] += sign * math.sqrt(n)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


#: Texts whose vectors are held at once.
VECTOR_ROWS = 4096


@pandas_udf(StructType().add("best", ArrayType(DoubleType())).add("at", ArrayType(IntegerType())).add("covered", DoubleType()).add("twins", DoubleType()))
def compared(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Of the texts in left against those in right, by cosine of hashed words rounded to nine places: the best of each
    text and its first place, the mean over right of the best there, and the best of two different texts in left.

    Row by row, in blocks of VECTOR_ROWS texts, so that nothing is shuffled and a long text takes no more memory."""
    known = _Terms(DEFAULTS.hashing_dim)
    out = []
    for a, b in zip(left, right, strict=True):
        a, b = list(a) if a is not None else [], list(b) if b is not None else []
        if not a or not b:
            out.append((None, None, None, None))
            continue
        va = _vectors(a, known)
        best, at, covered = np.full(len(a), -np.inf), np.zeros(len(a), int), 0.0
        for start in range(0, len(b), VECTOR_ROWS):
            sims = np.round(va @ _vectors(b[start : start + VECTOR_ROWS], known).T, 9)
            here = sims.argmax(1)
            more = sims[np.arange(len(a)), here] > best
            best, at = np.where(more, sims[np.arange(len(a)), here], best), np.where(more, here + start, at)
            covered += float(sims.max(0).sum())
        own = np.round(va @ va.T, 9)
        own[np.tril_indices(len(a))] = -np.inf
        out.append((best, at, covered / len(b), float(own.max()) if len(a) > 1 else 0.0))
    return pd.DataFrame(out, columns=["best", "at", "covered", "twins"])


def support(texts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, i, support and supported of summary sentences of min_words and more, against the abstract's windows.

    texts: doc_id, summary, abstract."""
    rows = texts.select("doc_id", T.split_sentences(F.col("summary")).alias("s"), T.split_sentences(F.col("abstract")).alias("a"))
    long = F.filter(F.transform("s", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda x: F.size(F.split(x["x"], r"\s+")) >= settings.support_min_words)
    rows = rows.select("doc_id", long.alias("s"), windows(F.col("a"), settings.support_window).alias("w"))
    rows = rows.withColumn("c", compared(F.transform("s", lambda x: x["x"]), "w"))
    each = rows.select("doc_id", F.explode(F.arrays_zip(F.transform("s", lambda x: x["i"]).alias("i"), F.col("c.best").alias("best"))).alias("x"))
    found = each.select("doc_id", F.col("x.i").alias("i"), F.col("x.best").alias("support")).where("support is not null")
    return found.withColumn("supported", F.col("support") >= settings.min_support)


def support_issues(supported: DataFrame) -> DataFrame:
    """doc_id and advisory issues of unsupported sentences."""
    one = F.struct("i", _issue("unsupported_claim", F.lit("no passage supports this sentence"), F.col("i").cast("string"), "advisory").alias("x"))
    return supported.where("not supported").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"]).alias("issues"))


def with_support(judged: DataFrame, settings: Settings = DEFAULTS, summary: str = "summary") -> DataFrame:
    """judged (doc_id, the summary, abstract, v as with_verdict() gives it, and more) with the advisory issues of
    unsupported sentences added to those of its grounded and ungrounded verdicts. doc_id must be unique."""
    more = support_issues(support(judged.select("doc_id", F.col(summary).alias("summary"), "abstract"), settings)).withColumnRenamed("issues", "_more")
    met = judged.join(more, "doc_id", "left")
    issues = F.when((F.col("v.status") == "unverifiable") | F.col("_more").isNull(), F.col("v.issues")).otherwise(F.concat("v.issues", "_more"))
    return met.withColumn("v", F.col("v").withField("issues", issues)).drop("_more")


def plain_words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9][a-z0-9'-]*)"), 1)


def compression(summary: Column, abstract: Column) -> Column:
    return F.size(plain_words(summary)) / F.nullif(F.size(plain_words(abstract)), F.lit(0))


def novelty(summary: Column, abstract: Column) -> Column:
    """Share of the summary's word pairs that the abstract doesn't have."""
    a, b = (F.array_distinct(T.pairs(plain_words(x), " ")) for x in (summary, abstract))
    return F.coalesce(F.size(F.array_except(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def _longest_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of words in both: of each word of a, the runs that end at each place of b."""
    known = {w: i for i, w in enumerate(dict.fromkeys(a))}
    other = np.fromiter((known.get(w, -1) for w in b), np.int32, len(b))
    runs, best = np.zeros(len(b) + 1, np.int32), 0
    for w in a:
        runs[1:] = np.where(other == known[w], runs[:-1] + 1, 0)
        best = max(best, int(runs.max()))
    return best


@pandas_udf(DoubleType())
def longest_copied_span(summary: pd.Series, abstract: pd.Series) -> pd.Series:
    """Longest run of words copied from the abstract, over the summary's words. Needs arrays of words."""
    return pd.Series([_longest_run(list(a), list(b)) / len(a) if a is not None and b is not None and len(a) and len(b) else 0.0 for a, b in zip(summary, abstract, strict=True)], dtype="float64")


def sentence_quality(texts: DataFrame) -> DataFrame:
    """doc_id, coverage, lead_bias and redundancy of (doc_id, summary, abstract), by hashed sentence vectors."""
    rows = texts.select("doc_id", T.split_sentences(F.col("summary")).alias("s"), T.split_sentences(F.col("abstract")).alias("a"))
    rows = rows.where((F.size("s") > 0) & (F.size("a") > 0)).select("doc_id", F.size("a").alias("n"), F.size("s").alias("k"), compared("s", "a").alias("c"))
    place = F.aggregate("c.at", F.lit(0.0), lambda x, at: x + at / F.nullif(F.col("n") - 1, F.lit(0))) / F.col("k")
    return rows.select("doc_id", F.col("c.covered").alias("coverage"), F.when(F.col("n") <= 1, 0.5).otherwise(place).alias("lead_bias"), F.col("c.twins").alias("redundancy"))


def quality(texts: DataFrame) -> DataFrame:
    """All six scores of (doc_id, summary, abstract); texts without words or sentences have no row."""
    words = texts.select("doc_id", compression(F.col("summary"), F.col("abstract")).alias("compression"), novelty(F.col("summary"), F.col("abstract")).alias("novelty"), longest_copied_span(plain_words(F.col("summary")), plain_words(F.col("abstract"))).alias("longest_copied_span"))
    return sentence_quality(texts).join(words, "doc_id")


def lead(abstract: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(T.split_sentences(abstract), 1, n), " ")


SYSTEM_PROMPT = (
    "Summarise a scientific abstract for researchers in two or three sentences of plain prose. Use only what the abstract "
    "states: no number, gene, method or acronym that it doesn't have, no reversed direction of effect, no claim of novelty "
    "or certainty that it doesn't make. Return the summary alone."
)


def first_prompt(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\n\nAbstract:\n"), abstract, F.lit("\n\nSummarise it in 2-3 sentences: what was done and what was found."))


def retry_prompt(title: Column, abstract: Column, previous: Column, issues: Column) -> Column:
    reasons = F.array_join(F.transform(issues, lambda i: F.concat(F.lit("- "), i["detail"])), "\n")
    return F.concat(first_prompt(title, abstract), F.lit('\n\nAn earlier attempt was rejected:\n"'), previous, F.lit('"\nfor these reasons:\n'), reasons, F.lit("\nCorrect every one of them."))


def summarise(papers: DataFrame, complete: Callable[[Column], Column] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """doc_id, text, origin, status, issues, overlap and attempts.

    Without a provider, or for papers without abstract, the summary is extractive. Else `complete` (a column
    function from prompt to text, such as a pandas UDF) is asked, its answer checked, and once more with the
    reasons if it was rejected; what is rejected again becomes extractive. Sentences of a generated summary that no
    passage supports are advisory issues. papers: doc_id, title, abstract."""
    own = extractive(papers, settings).withColumnRenamed("summary", "extract")
    rows = papers.select("doc_id", "title", "abstract").join(own, "doc_id")
    blank = F.coalesce(F.trim("abstract"), F.lit("")) == ""
    kept = lambda df, text, origin, n: df.select("doc_id", F.col(text).alias("text"), F.lit(origin).alias("origin"), "v.status", "v.issues", "v.overlap", F.lit(n).alias("attempts"))
    if complete is None:
        out = rows.withColumn("v", F.struct(F.when(blank, "unverifiable").otherwise("grounded").alias("status")))
        return out.select("doc_id", F.col("extract").alias("text"), F.lit("extractive").alias("origin"), "v.status", F.array().cast(ISSUE).alias("issues"), F.when(blank, 0.0).otherwise(1.0).alias("overlap"), F.lit(0).alias("attempts"))
    asked = rows.where(~blank).repartition(settings.summary_concurrency).withColumn("text", T.strip_markdown(complete(first_prompt(F.col("title"), F.col("abstract")))))
    asked = with_support(keep(with_verdict(asked, "text", "abstract", settings), "asked"), settings, "text")  # no prompt is sent twice
    good = asked.where("v.status = 'grounded'")
    bad = asked.where("v.status <> 'grounded'")
    again = bad.withColumn("text", T.strip_markdown(complete(retry_prompt(F.col("title"), F.col("abstract"), F.col("text"), F.col("v.issues"))))).drop("v")
    again = with_support(keep(with_verdict(again, "text", "abstract", settings), "again"), settings, "text")
    rest = again.where("v.status <> 'grounded'").select(rows.columns).unionByName(rows.where(blank))
    return kept(good, "text", "generated", 1).unionByName(kept(again.where("v.status = 'grounded'"), "text", "generated", 2)).unionByName(summarise_rest(rest, settings))


def summarise_rest(rows: DataFrame, settings: Settings) -> DataFrame:
    blank = F.coalesce(F.trim("abstract"), F.lit("")) == ""
    return rows.select("doc_id", F.col("extract").alias("text"), F.lit("extractive").alias("origin"), F.when(blank, "unverifiable").otherwise("grounded").alias("status"), F.array().cast(ISSUE).alias("issues"), F.when(blank, 0.0).otherwise(1.0).alias("overlap"), F.lit(settings.summary_attempts).alias("attempts"))
