"""Registered queries against their SQL on the smallest tables, and known counts."""

import json
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
import tagweave as tw

SF_DIR = "/root/testdata/sf0.001"
SQL_DIR = "/root/testdata/sf0.01"
COUNTS = {
    "p_edge": 65, "p_star_same_tag": 4, "p_star_mixed": 51, "p_triangle": 234, "p_cycle_local_supplier": 6,
    "p_path4": 16, "p_shared_part": 25, "p_two_regions": 500, "p_no_match": 0,
}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
LLM = registered.llm.queries() if registered.llm else {}
QUERIES = {name: query for name, query in registered.queries().items() if name not in LLM}
SQL = {name: sql for name, sql in registered.oracle_sql().items() if name not in LLM}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = tables.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(row[i] for i in order) for row in result.fetchall())
    assert sorted(tuple(row[c] for c in columns) for row in df.collect()) == expected


def most_rows(operator: dict) -> int:
    return max([operator["intermediate_rows"], *(most_rows(child) for child in operator.get("children", []))])


@pytest.mark.skipif(not Path(SQL_DIR).exists(), reason="no test tables")
def test_sql_has_no_large_intermediate_result():
    connection = duckdb.connect()
    for path in Path(SQL_DIR).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    largest = {}
    for name, sql in SQL.items():
        profile = connection.execute(f"explain (analyze, format json) {sql}").fetchone()[1]
        largest[name] = max(most_rows(operator) for operator in json.loads(profile)["operator"])
    assert min(largest.values()) > 0 and max(largest.values()) < 1_000_000, largest


@pytest.mark.parametrize("name", COUNTS)
def test_known_counts(spark, name):
    graph = registered._graph(spark, SF_DIR)
    assert tw.match_count(graph, registered.PATTERNS[name]) == COUNTS[name]


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["v1", "v2", "v3"] and df.count() == 234


@pytest.mark.parametrize("name", ["p_triangle", "p_path4", "p_two_regions", "p_isolated_region"])
def test_plans_have_no_unkeyed_join_and_read_few_columns(spark, name):
    graph = registered._graph(spark, SF_DIR)
    plan = registered.match(graph, registered.PATTERNS[name])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_hub_queries_split_joins(spark):
    graph = registered._graph(spark, SF_DIR, "hubs")
    assert graph.hubs.table.count() > 100
    plan = registered.queries()["match_hub_shared_part"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "left_share" in plan and "right_share" in plan
