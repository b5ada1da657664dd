"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL, plain
from pyspark.sql import functions as F

from paperloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(x) for x in r) for r in got.select(columns).collect())
    if name not in catalogue.ORACLES:
        assert columns
        return
    told = duck.sql(catalogue.ORACLES[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in told.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_made_summaries_take_the_next_id_over_gaps(spark, tmp_path):
    rows = [(i, f"text number {i}") for i in (1, 2, 5, 6, 40, 41, 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.summary for r in catalogue._made(spark, str(tmp_path)).collect()}
    following = dict(zip([i for i, _ in rows], [*[i for i, _ in rows][1:], 300], strict=True))
    assert len(got) == 7 and all(got[i].startswith(f"text number {n}") for i, n in following.items())


def test_all_sources_and_labels_are_answered(spark, tmp_path):
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("gene editing").alias("text"), F.concat(F.lit("host"), "id").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "gene editing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert catalogue.QUERIES["q11_source_reports"](spark, str(tmp_path)).count() == 1200
    vectors = spark.range(10_500).select(F.col("id").alias("vec_id"), F.col("id").alias("label"), F.array(F.lit(1.0)).alias("embedding"))
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalogue.QUERIES["r08_semantic_vec"](spark, str(tmp_path)).count() == 10_500


@pytest.mark.parametrize("name", ["x05_keys", "x02_bibtex"])
def test_keys_of_many_repeats(spark, tmp_path, name):
    """Beyond 4,162 papers of one base the first letter of a key lies beyond the 256 signs of char()."""
    docs = spark.range(4500).select((F.col("id") * 2100).alias("doc_id"), F.lit("same title. and text").alias("text"), F.lit("en").alias("lang"), F.lit("a.org").alias("source"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for t in ("documents", "nation"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    told = con.sql(catalogue.ORACLES[name])
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select(*told.columns).collect()]
    assert sorted(got) == sorted(told.fetchall()) and len({r[1].split("\n")[0] for r in got}) == 4500


def test_upsert_keeps_the_first_of_equal_versions(spark, tmp_path):
    """Equal versions in several files: as in the SQL, the row that stands first in the table is kept."""
    for n, (flag, most) in enumerate((("A", 300), ("R", 30_000), ("N", 3_000))):
        rows = spark.range(most).select((F.col("id") % 300).alias("l_orderkey"), (F.col("id") % 2 * 3 + 2).cast("int").alias("l_linenumber"), F.lit(flag).alias("l_returnflag"), F.col("id").alias("more"))
        rows.toPandas().to_parquet(tmp_path / f"part-{n}.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for n in range(3):
        (tmp_path / f"part-{n}.parquet").rename(tmp_path / f"lineitem.parquet/part-{n}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    told = con.sql(catalogue.ORACLES["k06_upsert_versions"]).fetchall()
    got = catalogue.QUERIES["k06_upsert_versions"](spark, str(tmp_path)).select("id", "version", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(told)
    assert {r.kept[0] for r in got} == {"A"}


@pytest.mark.parametrize("name", ["a10_strategies", "a17_paired_bootstrap"])
def test_no_table_of_pairs_is_kept(spark, monkeypatch, name):
    def refused(df, label):
        raise AssertionError(f"{label} is written")

    monkeypatch.setattr(catalogue, "keep", refused, raising=False)
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0
