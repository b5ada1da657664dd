"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text becomes ten statistics: shares of capitals, digits, punctuation and other signs, repetition of
words and lines, lengths of words, lines and sentences, and the entropy of its bytes, each smoothed towards
an ordinary text so that short texts aren't extreme, and transformed by a root or logarithm. For either
class Spark sums the first and second moments of the labelled rows; covariances are shrunk towards a
multiple of the identity. The score is the logistic of the difference of the log densities, Mahalanobis
distances and log determinants coming from Cholesky factors that are computed once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import keep
from .common import batch, lean, texts

#: Share of the identity in a class covariance.
SHRINKAGE = 0.2
#: Bytes, words, lines and sentences of ordinary text that each text is mixed with.
PRIOR_BYTES = 300

_CLASS = np.zeros(256, np.int8)  # 1 capitals, 2 other letters, 3 digits, 4 punctuation, 5 other signs
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[list(b".,;:?'\"()-")] = 4
_CLASS[list(b"#$%&*!|@^~_=+<>{}[]\\/`")] = 5


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    size, k = len(raw), PRIOR_BYTES
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    _, capitals, letters, digits, points, signs = np.bincount(_CLASS, weights=seen, minlength=6).tolist()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n, different, rows, distinct_rows, stops = len(words), len(set(words)), len(lines), len(set(lines)), int(seen[46])
    share = lambda count, usual: float(np.sqrt((count + k * usual) / (size + k)))
    some = seen[seen > 0] / max(size, 1)
    entropy = float(-(some * np.log(some)).sum())
    return [
        float(np.log((max(size - n, 0) + 251) / (n + 50))), share(capitals, 0.03), share(digits, 0.001), share(points, 0.03), share(signs, 0.002),
        float(np.log((different + 50) / (n**0.85 + 50))), float(np.log((distinct_rows + 4) / (rows + 4))), float(np.log((n + 120) / (rows + 4))),
        float(np.log((n + 50) / (stops + 5))), (entropy * size + 2.7 * k) / (size + k),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x (array<double>) of each text, in one pass over whole texts."""
    schema = pa.schema([("x", pa.list_(pa.float64()))])

    def run(batches):
        for part in batches:
            made = batch({"x": [statistics(t.as_py()) for t in part.column(1)]}, schema)
            yield pa.RecordBatch.from_arrays([part.column(0), made.column(0)], names=["doc_id", "x"])

    source = texts(docs)
    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Discriminant:
    """Log densities of both classes by cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        """moments: of each class the number of rows, the sum of x and the sum of x times x transposed."""
        self.share = {c: n / sum(m[0] for m in moments.values()) for c, (n, _, _) in moments.items()}
        self.parts = []
        if set(moments) != {0, 1} or min(m[0] for m in moments.values()) < 2:
            return
        total = sum(m[0] for m in moments.values())
        mean = sum(m[1] for m in moments.values()) / total
        spread = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values())) / total - mean**2, 1e-12))
        for c in (0, 1):
            n, first, second = moments[c]
            centre = (first / n - mean) / spread
            cov = (second / n - np.outer(first / n, first / n)) / np.outer(spread, spread)
            cov = (1 - shrinkage) * cov + shrinkage * (np.trace(cov) / len(cov) + 1e-6) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean, spread, centre, np.linalg.inv(factor), float(np.log(self.share[c]) - np.log(np.diag(factor)).sum())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of each row of x, how likely class 1 is, from 0 to 1. Without rows of both classes, class 1's share or 1/2."""
        if not self.parts:
            return np.full(len(x), self.share.get(1, 0.0 if self.share else 0.5))
        density = []
        for mean, spread, centre, inverse, constant in self.parts:
            away = ((x - mean) / spread - centre) @ inverse.T
            density.append(constant - 0.5 * (away**2).sum(1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(rows: DataFrame) -> Discriminant:
    """The discriminant of rows (x, label 0 or 1). Spark sums the moments; 2 x 66 numbers come to the driver."""
    size = len(statistics(""))
    sums = [F.sum(F.col("x")[i]) for i in range(size)] + [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(size) for j in range(i, size)]
    moments = {}
    for label, n, *values in rows.where("label in (0, 1)").groupBy("label").agg(F.count(F.lit(1)), *sums).collect():
        second = np.zeros((size, size))
        second[np.triu_indices(size)] = values[size:]
        moments[int(label)] = (float(n), np.array(values[:size]), second + np.triu(second, 1).T)
    return Discriminant(moments)


def score(x: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of features()'s rows."""

    def run(batches):
        for part in batches:
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            found = model.scores(flat.reshape(part.num_rows, -1)) if part.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(lean(run), f"doc_id {x.schema['doc_id'].dataType.simpleString()}, score double")


def train_rows(docs_ids: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """The rows of docs_ids with a label, but for those whose crc32(doc_id as text) mod folds is held."""
    known = labels.select(F.col("doc_id"), F.col(label).alias("label")).where("label is not null")
    return docs_ids.join(known, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score (class 1 likelier if higher) and predicted (score >= threshold).

    docs: doc_id, text; labels: doc_id, quality; further columns are ignored. Labels are learned from all
    labelled rows outside the held-out fold; label, lang, source and doc_id are no inputs. Null and empty
    texts are scored as the empty text; a null doc_id has no fold (held_out false); rows and labels that are
    repeated count each. Without labels of both classes every score is class 1's share, or 1/2. An empty
    table gives no rows. Statistics (ten numbers a document) are kept in the shared folder and join the
    labels by doc_id; texts aren't shuffled.
    """
    x = keep(features(docs), "quality")
    model = fit(train_rows(x, labels, "quality", folds, held))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    return score(x, model).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
