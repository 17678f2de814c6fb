"""Every registered query of the library against its SQL."""

import oracle
import pytest

from findloom.plans import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, con, name):
    query, sql = own.queries()[name], own.oracle_sql().get(name)
    if sql is None:
        df = query(spark, SF)
        assert df.columns and df.count() >= 0
    else:
        assert oracle.compare(spark, con, query, sql, SF)[1] == ""
    spark.catalog.clearCache()


def test_reports_do_not_depend_on_the_order_of_events(spark, tmp_path):
    """An error keeps its number whatever order its events come in, as steps join on it."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = []
    for k, order in enumerate((events["event_id"].asc(), events["event_id"].desc())):
        events.repartition(8, "user_id").sortWithinPartitions(order).write.parquet(f"{tmp_path}/{k}/events.parquet")
        got.append(sorted(map(tuple, own._reports_of_jobs(spark, f"{tmp_path}/{k}").select("repo_url", "scanner", "errors", "scanned").collect())))
    assert got[0] == got[1] and got[0]
