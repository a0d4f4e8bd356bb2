import glob
import hashlib
import os
import time

import duckdb
import pytest

from cairn.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def normal(rows):
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert normal([r[c] for c in cols] for r in df.collect()) == normal([r[i] for i in at] for r in want.fetchall())


def test_lattice_report_of_many_full_groups_is_quick(spark, tmp_path):
    """Equal sizes leave every choice of edges open; ranked one by one they took about a second a group."""
    spark.range(4200).selectExpr("id as doc_id", "1000L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    found = catalogue.queries()["lattice_report"](spark, str(tmp_path)).collect()
    assert time.monotonic() - began < 60
    assert sorted(tuple(r) for r in found) == [(g, 8, 8 * 96, 7) for g in range(600)]


def test_lattice_plan_is_dealt_to_all_tasks(spark, tmp_path):
    """Spark left the deal by group out and merged the groups, few in bytes, into one task that planned all."""
    spark.range(4200).selectExpr("id as doc_id", "1000 + id % 50 as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    planned = catalogue.queries()["lattice_plan"](spark, str(tmp_path))
    assert planned.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert planned.select("group_id").distinct().count() == 600


def test_archive_health_of_a_wholly_damaged_group(spark, tmp_path):
    texts = [t for t in (f"{k:04d}" for k in range(200)) if hashlib.sha256(t.encode()).hexdigest() < "4"][:7]
    rows = [(k, t, "en", "s", 4) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalogue.queries()["archive_health"](spark, str(tmp_path)).collect()] == [(7, 0, 0, 7)]
