import math
import os

import duckdb
import pytest

from graphloom.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders")


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _plain(row):
    return tuple(round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x) else str(x) for x in row)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    want = sql.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted((_plain(r) for r in got.select(*columns).collect()), key=str)
    assert rows == sorted((_plain(r) for r in want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()), key=str)


def test_constants_reach_the_files(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    from graphloom.engine import Engine
    from graphloom.sources.relations import Relations

    def plan(term):
        return Engine(Relations(spark, FOLDER)).execute(term).frame._jdf.queryExecution().executedPlan().toString()

    one = plan('{tp, {"[]", "<customer/7>", "<c_nationkey>", "?o"}, none, none}')
    assert one.count("FileScan") == 1 and "EqualTo(c_custkey,7)" in one and "c_name" not in one
    reference = plan('{tp, {"[]", "?s", "?p", "<nation/3>"}, none, none}')
    assert "EqualTo(c_nationkey,3)" in reference and "EqualTo(s_nationkey,3)" in reference
    by_id = plan('{tp, {"<nation/4/n_name>", "?s", "?p", "?o"}, none, none}')
    assert by_id.count("FileScan") == 1 and "EqualTo(n_nationkey,4)" in by_id
    assert "FileScan" not in plan('{tp, {"[]", "<nowhere/1>", "?p", "?o"}, none, none}')


def test_own_counts_equal_counted_triples(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    from graphloom.operators.distribution import predicate_frequency
    from graphloom.sources.relations import Relations

    r = Relations(spark, FOLDER)
    assert sorted(predicate_frequency(r).collect()) == sorted(predicate_frequency(r.all()).collect())


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Two nations of one region, with 200 customers and 200 suppliers each."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    con = duckdb.connect()
    rows = {
        "region": "SELECT 1 AS r_regionkey, 'R' AS r_name",
        "nation": "SELECT i AS n_nationkey, 'N' || i AS n_name, 1 AS n_regionkey FROM range(2) t(i)",
        "customer": "SELECT i AS c_custkey, 'C' || i AS c_name, i % 2 AS c_nationkey, i + 0.5 AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(400) t(i)",
        "supplier": "SELECT i AS s_suppkey, 'S' || i AS s_name, i % 2 AS s_nationkey, -i - 0.5 AS s_acctbal FROM range(400) t(i)",
        "orders": "SELECT i AS o_orderkey, i % 400 AS o_custkey FROM range(800) t(i)",
    }
    for table, query in rows.items():
        con.sql(f"CREATE TABLE {table} AS {query}")
        con.sql(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return folder, con


def _join_rows(plan):
    """Rows out of each join of a plan that has run."""
    name = plan.nodeName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if name.endswith("Join") else []
    return sum((_join_rows(b) for b in below), own)


@pytest.mark.parametrize("name", ["bench_linked", "bench_eight_join", "bench_eight_mjoin", "bench_two_join", "bench_two_hjoin", "bench_two_mjoin", "join_cycle"])
def test_counts_of_frequent_values_list_no_pairs(spark, crowded, name):
    folder, con = crowded
    got = QUERIES[name](spark, folder)
    want = con.sql(SQL[name])
    columns = sorted(got.columns)
    found = got.select(*columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())
    # Customers and suppliers of a nation make 40,000 pairs, twice.
    assert 0 < max(_join_rows(found._jdf.queryExecution().executedPlan())) <= 2000
