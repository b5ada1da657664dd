"""A training-data pipeline: quality filter, line dedup, near-dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of docs, whatever they are; the last returns token ids. Rows are told apart by doc_id:
a stage that drops a doc_id drops all its rows, and rows with a null doc_id are never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe, decontam, linededup, neardup, quality
from paperloom.shipping import ship
from paperloom.tables import keep, sized

#: Documents are near-duplicates, and contain a benchmark item, from this similarity on.
NEAR_PERCENT = 80
CONTAINMENT = 0.8
VOCABULARY = "byte_bpe_50k.json"
#: Ids to drop up to this number (8 bytes each) are broadcast; with more, the documents are shuffled.
JOIN_ROWS = 2_000_000
#: Documents that go to a Python worker at once, at most: Spark's 10,000 are tens of MB on both sides of each core.
BATCH_ROWS = 1000

#: The stages' rows depend on a trained model, so SQL doesn't express them.
ORACLE_SQL = None


def _start(spark: SparkSession) -> SparkSession:
    """spark with the package shipped and small Arrow batches, whatever stage is run first."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return ship(spark)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _start(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """docs but for those whose doc_id is in ids."""
    gone = keep(ids.select("doc_id").where("doc_id is not null").distinct(), label)
    return docs.join(sized(gone, JOIN_ROWS), "doc_id", "left_anti").select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels at hand, rejects go."""
    scored = quality.classify(docs, _table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 0"), "rejected")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go; n_chars follows the text. A document all of whose lines go stays, empty."""
    _start(spark)
    return linededup.drop_lines(docs, linededup.dropped_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    _start(spark)
    groups = neardup.near_duplicates(docs, NEAR_PERCENT)
    return _without(docs, groups.where("not kept"), "copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return _without(docs, decontam.contaminated(docs, _table(spark, sf_dir, "benchmark"), CONTAINMENT), "leaks")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding the ids gives the text back."""
    import public_tokenizers

    _start(spark)
    return bpe.encode_checked(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder before the next."""
    docs = _table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
