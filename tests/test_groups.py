from itertools import permutations

import pytest
from conftest import rows

from pyspark.sql import functions as F

from tagweave.operators import groups as operators
from tagweave.operators.groups import arrangement_cells, cell_digits, cross_tags, group_permutations


@pytest.fixture(scope="module")
def members(spark):
    groups = {1: [10, 11, 12], 2: [20], 3: [30, 31, 32, 33, 34, 35]}
    return groups, spark.createDataFrame([(g, m) for g, ms in groups.items() for m in ms], "g long, m long")


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("split_at,cell_rows", [(2, 4), (4, 8), (1000, 1 << 18)])
def test_permutations(members, k, split_at, cell_rows):
    groups, df = members
    expected = sorted((g, *p) for g, ms in groups.items() for p in permutations(ms, k))
    assert rows(group_permutations(df, "g", "m", k, split_at, cell_rows)) == expected


def test_k_must_be_positive(members):
    with pytest.raises(ValueError):
        group_permutations(members[1], "g", "m", 0)


@pytest.mark.parametrize("split_at,cell_rows", [(2, 16), (1000, 1 << 18)])
def test_cross_tags(spark, members, split_at, cell_rows):
    groups, df = members
    others = {3: [7, 8, 9], 2: [9], 1: [6]}, {3: [1, 2], 1: [3]}
    frames = [
        spark.createDataFrame([(g, m) for g, ms in table.items() for m in ms], "g long, m long")
        for table in others
    ]
    result = cross_tags([(df, 2), (frames[0], 1), (frames[1], 1)], "g", "m", split_at, cell_rows)
    assert result.columns == ["g", "t1m1", "t1m2", "t2m1", "t3m1"]
    assert rows(result) == sorted(
        (g, *p, x, y)
        for g, ms in groups.items()
        for p in permutations(ms, 2)
        for x in others[0].get(g, [])
        for y in others[1].get(g, [])
    )


def test_the_choices_of_a_large_group_are_dealt_evenly(spark):
    """5,000 members in threes: 493,039 choices of blocks, no hot group, and every triple in exactly one of them."""
    members = spark.range(5000).selectExpr("7L AS g", "id AS m").union(spark.range(30).selectExpr("8L AS g", "id AS m"))
    cells = arrangement_cells([(members, 3)], "g", "m")
    plan = cells._jdf.queryExecution().toString()
    assert "left_share" not in plan
    sizes = cells.groupBy("g").agg(
        F.count("*").alias("cells"),
        F.sum(F.size("slot0") * F.size("slot1").cast("long") * F.size("slot2")).alias("triples"),
        F.max(F.size("slot0")).alias("most"),
    )
    assert rows(sizes) == [(7, 79**3, 5000**3, 64), (8, 1, 30**3, 30)]
    counts = spark.createDataFrame([(7, 79)], "g long, blocks0 long")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    dealt = cell_digits(counts, "g", [0, 0, 0])
    shares = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sum(shares) == 79**3 and max(shares) < 1.5 * 79**3 / 8
    assert dealt.distinct().count() == 79**3


def test_groups_beyond_one_block_are_joined_when_many(spark, members, monkeypatch):
    monkeypatch.setattr("tagweave.operators.skew.BROADCAST_ROWS", 0)
    monkeypatch.setattr(operators, "BROADCAST_ROWS", 0)
    groups, df = members
    expected = sorted((g, *p) for g, ms in groups.items() for p in permutations(ms, 2))
    assert rows(group_permutations(df, "g", "m", 2, 3, 4)) == expected
