"""Toxicity by class-conditional Kneser-Ney models.

For the toxic and for the ordinary labelled documents a model over words is estimated, whose context is the
class. As in Kneser-Ney smoothing it counts contexts, not occurrences: N_c(w) is the number of different
documents of class c that hold w, so that a word repeated all over one document counts once. With the absolute
discounts D_c (from the counts of counts) and the mass m_c that they set free,

    p_c(w) = (N_c(w) - D_c(N_c(w))) / N_c + m_c * p(w),    p(w) = (N_0(w) + N_1(w) + 1/2) / (N + (V + 1) / 2),

where the backoff counts behind p are shared by both classes, so that rare expressions speak for neither. Toxic
documents are ordinary text with toxic expressions, so their words come from p_1 with a share of SHARE and from
p_0 else. A document's score compares the two log-likelihoods, normalised by its length,

    x = (log p(text | toxic) - log p(text | ordinary)) / (words + PRIOR_WORDS),

through one monotone calibration, a logistic of the signed square root of x.

Every count holds at every size. The values of the HOT_WORDS words that most documents hold are broadcast (16
bytes each); the other words of a document are joined with the table of all values. No word of that join stands
in many documents, as those that do are among the broadcast ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import keep, sized
from .common import CACHE_WORDS, batch, texts

#: The discount where counts of counts give none.
DISCOUNT = 0.75
#: Share of a toxic document's words that the toxic model gives, and words without evidence added to each length.
#: Chosen by five inner folds of the rows outside the held-out fold.
SHARE, PRIOR_WORDS = 0.003, 40
#: One in so many labelled documents is kept from the counts and used for the two numbers of the calibration,
#: of which no more than about FIT_ROWS.
CALIBRATE = 5
FIT_ROWS = 50_000
#: At most so many words are broadcast.
HOT_WORDS = 1 << 18
#: Labels up to this number (12 bytes each) are broadcast to the documents; with more, texts are shuffled.
JOIN_ROWS = 1_000_000

_FOLD = bytes(ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)) + bytes(range(128, 256))


class _Words(dict):
    """64-bit hashes of words as signed integers."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        value = self[word] = value - ((value >> 63) << 64)
        return value


def words(text: str, cache: _Words) -> np.ndarray:
    """Hashes of a text's words: runs of letters, ASCII ones in lower case."""
    found = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return np.fromiter(map(cache.__getitem__, found), np.int64, len(found))


#: Words after which a task hands on its counts; bounds its memory.
_FLUSH = 2_000_000
_COUNTS = pa.schema([(c, pa.int64()) for c in ("word", "n0", "n1", "n")])


def _counted(rows: DataFrame) -> DataFrame:
    """word, and how many ordinary, toxic and all texts hold it. rows: text, label (0, 1 or null). Sums by word in
    Spark; a task hands on partial sums."""

    def run(batches):
        cache = _Words()
        held: list[tuple[np.ndarray, int]] = []
        count = 0

        def flush():
            word = np.concatenate([w for w, _ in held])
            label = np.repeat(np.array([c for _, c in held], np.int8), [len(w) for w, _ in held])
            order = np.argsort(word)
            word, label = word[order], label[order]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sums = [np.add.reduceat((label == c).astype(np.int64), first) for c in (0, 1)]
            held.clear()
            return batch(dict(zip(_COUNTS.names, (word[first], *sums, np.diff(np.append(first, len(word)))), strict=True)), _COUNTS)

        for part in batches:
            for text, label in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                w = np.unique(words(text.as_py(), cache))
                if len(w):
                    held.append((w, 2 if label is None else label))
                    count += len(w)
                if count >= _FLUSH:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    counts = rows.select("text", F.col("label").cast("tinyint")).mapInArrow(run, "word bigint, n0 bigint, n1 bigint, n bigint")
    return counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "n")])


def discounts(met: dict[int, int]) -> list[float]:
    """The discounts of counts of 1, 2 and more, from how many words have the counts 1 to 4 (modified Kneser-Ney)."""
    if not all(met.get(k) for k in (1, 2, 3, 4)):
        return [DISCOUNT] * 3
    y = met[1] / (met[1] + 2 * met[2])
    return [min(max(k - (k + 1) * y * met[k + 1] / met[k], 0.0), float(k)) for k in (1, 2, 3)]


class Model:
    """Of each word value, log(1 - SHARE + SHARE * p_1 / p_0), and the calibration.

    table: word and value of all words that a labelled text holds; hot, hot_values: those of the commonest words in
    all texts, sorted by word; rest: the value of a word that no labelled text holds."""

    def __init__(self, table: DataFrame | None, hot: np.ndarray, hot_values: np.ndarray, rest: float):
        self.table, self.hot, self.hot_values, self.rest = table, hot, hot_values, rest
        self.offset, self.slope = -2.0, 20.0

    def calibrate(self, x: np.ndarray, label: np.ndarray) -> None:
        """Logistic regression of the signed square root with a small ridge, by Newton steps; never falling."""
        if not len(label) or label.min() == label.max():
            return
        z = np.sign(x) * np.sqrt(np.abs(x))
        scale = float(z.std()) or 1.0
        rows = np.column_stack((np.ones(len(z)), z / scale))
        w = np.zeros(2)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.eye(2) * 1e-3, rows.T @ (label - p) - 1e-3 * w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.offset, self.slope = float(w[0]), max(float(w[1]), 0.0) / scale

    def score(self, x: Column) -> Column:
        z = self.offset + F.signum(x) * F.sqrt(F.abs(x)) * self.slope
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))


def _least_hot(counts: DataFrame) -> int:
    """The least number of texts from which on a word is broadcast, so that HOT_WORDS words are at most."""
    # An eighth of a power of two a class: a few hundred of them, whatever the counts.
    at = F.floor(F.log2("n") * 8).alias("k")
    best = total = None
    for k, number, least in sorted(counts.groupBy(at).agg(F.count(F.lit(1)), F.min("n")).collect(), reverse=True):
        total = (total or 0) + number
        if total > HOT_WORDS:
            break
        best = least
    return (1 << 62) if best is None else best


def fit(rows: DataFrame) -> Model:
    """The model of rows (text, label 0, 1 or null), from all counts over all of them."""
    counts = keep(_counted(rows), "counts")
    known = F.col("n0") + F.col("n1") > 0
    asked = [F.sum("n0").alias("all0"), F.sum("n1").alias("all1"), F.count_if(known).alias("words")]
    asked += [F.count_if(F.col(f"n{c}") == k).alias(f"c{c}_{k}") for c in (0, 1) for k in (1, 2, 3, 4)] + [F.count_if(F.col(f"n{c}") > 2).alias(f"more{c}") for c in (0, 1)]
    got = counts.agg(*asked).first()
    if not (got["all0"] and got["all1"]):
        return Model(None, np.empty(0, np.int64), np.empty(0), 0.0)
    shared = (F.col("n0") + F.col("n1") + 0.5) / (got["all0"] + got["all1"] + 0.5 * (got["words"] + 1))
    p, free = [], []
    for c in (0, 1):
        d = discounts({k: got[f"c{c}_{k}"] for k in (1, 2, 3, 4)})
        n, total = F.col(f"n{c}"), got[f"all{c}"]
        less = F.when(n > 2, d[2]).when(n > 1, d[1]).when(n > 0, d[0]).otherwise(0.0)
        free.append(max((d[0] * got[f"c{c}_1"] + d[1] * got[f"c{c}_2"] + d[2] * got[f"more{c}"]) / total, 1e-3))
        p.append((n - less) / total + free[c] * shared)
    value = F.log(1 - SHARE + SHARE * p[1] / p[0])
    hot = counts.where(F.col("n") >= _least_hot(counts)).select("word", value.alias("value")).toArrow()
    word = hot.column("word").to_numpy().astype(np.int64)
    order = np.argsort(word)
    return Model(counts.where(known).select("word", value.alias("value")), word[order], hot.column("value").to_numpy()[order], float(np.log(1 - SHARE + SHARE * free[1] / free[0])))


def _parts(docs: DataFrame, model: Model, extra: list[str]) -> DataFrame:
    """Of each row the extra columns, a number of its own, its words, the sum of its hot words' values and, with their
    counts, its other words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.hot, model.hot_values))
    schema = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("total", pa.float64()), ("others", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches):
        hot, values = shared.value
        cache = _Words()
        row = TaskContext.get().partitionId() << 40
        for part in batches:
            made = []
            for text in part.column(0):
                w, n = np.unique(words(text.as_py(), cache), return_counts=True)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, w), len(hot) - 1)
                    met = hot[at] == w
                    made.append((row, int(n.sum()), float((values[at[met]] * n[met]).sum()), w[~met], n[~met]))
                else:
                    made.append((row, int(n.sum()), 0.0, w, n))
                row += 1
            cols = list(zip(*made, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *batch(dict(zip(schema.names, cols, strict=True)), schema).columns], names=[*extra, *schema.names])

    source = docs.select("text", *extra)
    kinds = "".join(f"{c} {source.schema[c].dataType.simpleString()}, " for c in extra)
    return keep(source.mapInArrow(run, kinds + "row bigint, n bigint, total double, others array<bigint>, times array<bigint>"), "words")


def compared(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and x, the length-normalised comparison, of each row (doc_id, text). Written to the shared folder."""
    if model.table is None:
        return docs.select("doc_id", F.lit(0.0).alias("x"))
    parts = _parts(docs, model, ["doc_id"])
    others = parts.select("row", F.explode(F.arrays_zip("others", "times")).alias("o")).select("row", F.col("o.others").alias("word"), F.col("o.times").alias("times"))
    # Words that the table lacks have the value of rest, which the sum below gives all of them.
    sums = others.join(model.table, "word").groupBy("row").agg(F.sum((F.col("value") - model.rest) * F.col("times")).alias("more"))
    unseen = F.aggregate("times", F.lit(0).cast("bigint"), lambda a, t: a + t) * model.rest
    rows = parts.select("row", "doc_id", "n", (F.col("total") + unseen).alias("total")).join(sums, "row", "left")
    return keep(rows.select("doc_id", ((F.col("total") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + PRIOR_WORDS)).alias("x")), "compared")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (toxic likelier if higher) and predicted (score >= threshold).

    docs: doc_id, text; labels: doc_id, toxic; further columns are ignored. Counts come from all labelled
    rows outside the held-out fold but one in CALIBRATE, by a hash of doc_id, on which the calibration's two
    numbers are fitted. Label, lang, source and doc_id are no inputs. Null and empty texts have no words and get the
    score of no evidence (x = 0); a null doc_id has no fold (held_out false); repeated rows and labels count each.
    Without labels of both classes every document gets the score of no evidence. An empty table gives no
    rows. Counts are summed by word with partial sums in each task and none is left out.
    """
    source = texts(docs)
    known = labels.select("doc_id", F.col("toxic").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)
    known = keep(known.select("doc_id", F.col("label").cast("int").alias("label")), "toxic")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0
    model = fit(source.join(sized(known.where(~apart), JOIN_ROWS), "doc_id", "left"))
    found = compared(source, model)
    number = known.where(apart).count()
    some = known.where(apart)
    if number > FIT_ROWS:
        some = some.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / number))
    got = found.join(F.broadcast(some), "doc_id").select("x", "label").toArrow()
    model.calibrate(got.column("x").to_numpy().astype(float), got.column("label").to_numpy().astype(float))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    score = model.score(F.col("x"))
    return found.select("doc_id", fold.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
