"""Every registered query against its SQL on the supplied tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_check import connect, differences

SF_DIR = "/root/testdata/sf0.01"
# Full-size forests take minutes; what is checked of them does not depend on the scale.
SMALL_DIR = "/root/testdata/sf0.001"
FORESTS = {"forest_chain_properties", "forest_lag_properties", "out_of_bag_rows"}


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n not in FORESTS])
def test_query_equals_sql(spark, database, name):
    assert not differences(spark, database, queries()[name], oracle_sql()[name], SF_DIR)


@pytest.mark.parametrize("name", sorted(FORESTS))
def test_forest_equals_sql(spark, name):
    small = connect(SMALL_DIR)
    assert not differences(spark, small, queries()[name], oracle_sql()[name], SMALL_DIR)


def test_the_comparison_notices_a_difference(spark, database):
    sql = oracle_sql()["yield_over_time"].replace("sum(DAILY_YIELD)", "sum(DAILY_YIELD) + 1")
    assert differences(spark, database, queries()["yield_over_time"], sql, SF_DIR)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship_has_a_day_for_each_source(spark):
    rows = entry(spark).groupBy("SOURCE_KEY").count().collect()
    assert rows and {row["count"] for row in rows} == {96}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kathmandu"])
@pytest.mark.parametrize("name", ["forecast_yields", "lag_roll_global", "lenient_parse"])
def test_session_zone_does_not_matter(spark, database, name, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert not differences(spark, database, queries()[name], oracle_sql()[name], SF_DIR)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
