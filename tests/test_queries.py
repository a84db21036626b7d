"""Every query with SQL against DuckDB over the smallest tables; the others run."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sievewright import queries as q


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def rows_of(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, sf, db, name):
    df = q.queries()[name](spark, sf)
    found = db.execute(q.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.select(*columns).collect()) == rows_of(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs(spark, sf, name):
    assert q.queries()[name](spark, sf).count() >= 0


def test_vocabulary_of_all_training_texts(spark, tmp_path):
    """More than 200,000 characters of other splits stand before the training texts, whose last has pieces of its own."""
    rows = [(f"test-source-{i}-x", "zq " * 10_000) for i in range(8)] + [(f"train-source-{i}-x", "abab " * 10_000) for i in range(8)] + [("train-source-9-x", "kw " * 20_000)]
    spark.createDataFrame(rows, "doc_id string, text string").withColumn("loaded_at", F.lit(1)).write.parquet(str(tmp_path / "prepared_docs.parquet"))
    _, merges = q.token_table(spark, str(tmp_path))
    assert (ord("a"), ord("b")) in merges and (ord("k"), ord("w")) in merges and (ord("z"), ord("q")) not in merges
