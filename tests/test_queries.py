"""Every archive query against its SQL."""

import pytest
from compare import difference

from stowage.queries import ORACLES, QUERIES

ROWS_ONLY = {"q_compressibility_sample"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_the_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) == ""


def test_every_query_has_sql_but_the_listed():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


def test_compressibility(spark, sf):
    rows = QUERIES["q_compressibility_sample"](spark, sf).collect()
    assert rows and all(r.worth == (r.sample_percent >= 5.0) for r in rows)


@pytest.mark.parametrize(("name", "key", "view", "of"), [("q_first_fit_bins_all", "seq", "orders", "o_orderkey"), ("q_manifest_round_trip_all", "id", "lineitem", "l_orderkey")])
def test_no_archive_is_left_out(spark, sf, name, key, view, of):
    rows = QUERIES[name](spark, sf).select(key).collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{sf}/{view}.parquet").select(of).distinct().collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
