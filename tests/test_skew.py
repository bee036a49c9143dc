import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagweave.operators import skew
from tagweave.operators.skew import few_or_stored, grid_product, hot_keys, skew_join, splits_from


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 30), (2, 3), (3, 1)) for i in range(n)], "k long, a long")
    right = spark.createDataFrame([(k, i) for k, n in ((1, 25), (2, 2), (4, 5)) for i in range(n)], "k long, b long")
    return left, right


def test_hot_keys(sides):
    assert rows(hot_keys(sides[0], ["k"], 2)) == [(1, 30), (2, 3)]


def shares(spark, left, right, split_at):
    counts = spark.createDataFrame([(7, left, right)], "k long, l long, r long")
    found = splits_from(counts, ["k"], "l", "r", split_at)
    return None if found is None else tuple(found.first())[1:]


def test_shares_follow_both_sides_and_the_result(spark):
    assert shares(spark, 10, 10, 100) is None
    assert shares(spark, 1000, 1, 100) == (10, 1)
    assert shares(spark, 1, 1000, 100) == (1, 10)
    left, right = shares(spark, 4000, 4000, 100)  # 16,000,000 result rows, 6,400 in a cell
    assert abs(left - right) <= 1 and 4000 / left * 4000 / right <= 6400 * 20
    # Fewer rows than the limit on each side, but a large product: three children of 10,000 each.
    left, right = shares(spark, 10_000 * 10_000, 10_000, 16_384)
    assert left * right >= 100


def test_more_keys_than_a_broadcast_takes(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    table = spark.range(10).selectExpr("id AS k")
    kept = few_or_stored(table)
    assert rows(kept) == [(i,) for i in range(10)] and "/keys-" in kept.inputFiles()[0]
    left = spark.range(400).selectExpr("id % 20 AS k", "id AS a")
    right = spark.range(100).selectExpr("id % 10 AS k", "-id AS b")
    splits = splits_from(hot_keys(left, ["k"], 2), ["k"], "n", "10", 2)
    assert splits.count() == 20
    assert rows(skew_join(left, right, ["k"], splits)) == rows(left.join(right, "k"))


def table_of(spark, parts):
    rows = [(*key, *counts) for key, counts in parts.items()]
    return F.broadcast(spark.createDataFrame(rows, "k long, left_parts long, right_parts long"))


@pytest.mark.parametrize("parts", [{(1,): (4, 3)}, {(1,): (1, 7), (2,): (2, 1)}, {(9,): (5, 5)}])
def test_split_join_equals_plain_join(spark, sides, parts):
    splits = table_of(spark, parts)
    assert rows(skew_join(*sides, ["k"], splits)) == rows(sides[0].join(sides[1], "k"))


@pytest.mark.parametrize("how", ["left", "left_semi"])
def test_split_outer_and_semi_join(spark, sides, how):
    left, right = sides
    once = right.select("k").distinct()
    splits = table_of(spark, {(1,): (6, 1)})
    assert rows(skew_join(left, once, ["k"], splits, how)) == rows(left.join(once, "k", how))


def test_no_splits_without_hot_keys(spark):
    assert splits_from(None, ["k"], "1", "1") is None


@pytest.fixture
def plain_shuffles(spark):
    """Shuffled joins whose partitions are not merged, so that shares can be seen."""
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def largest_share(df) -> float:
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_split_spreads_a_hot_key(spark, plain_shuffles):
    left = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS a")
    right = spark.range(9000).selectExpr("id AS k", "-id AS b")
    splits = table_of(spark, {(0,): (64, 1)})
    assert largest_share(skew_join(left, right, ["k"])) > 0.33
    assert largest_share(skew_join(left, right, ["k"], splits)) < 0.25
    assert skew_join(left, right, ["k"], splits).count() == 9000


def test_grid_cells_are_even(spark, plain_shuffles, monkeypatch):
    left = spark.range(3000).selectExpr("id AS a")
    right = spark.range(200).selectExpr("id AS b")
    for product in (grid_product(left, right), grid_product(right, left)):
        assert product.count() == 600_000
        assert largest_share(product) < 0.3  # 32 cells on 8 partitions
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    square = grid_product(left, right)
    assert square.count() == 600_000
    assert largest_share(square) < 0.3


def test_grid_product(sides):
    left, right = sides[0].withColumnRenamed("k", "kl"), sides[1]
    product = grid_product(left, right, "a <> b")
    expected = sorted((*l, *r) for l in rows(left) for r in rows(right) if l[1] != r[1])
    assert rows(product) == expected
    plan = product._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_of_very_many_keys_only_the_hot_ones_are_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 300)
    left = spark.range(8000).selectExpr("if(id < 4000, 0, id % 1000) AS k", "id AS a")
    right = spark.range(1000).selectExpr("id AS k", "-id AS b")
    splits = splits_from(hot_keys(left, ["k"], 2), ["k"], "n", "1", 2)
    assert [r.k for r in splits.collect()] == [0]
    assert rows(skew_join(left, right, ["k"], splits)) == rows(left.join(right, "k"))
    even = splits_from(hot_keys(left.where("k > 0"), ["k"], 2), ["k"], "n", "1", 2)
    assert even is None


def test_the_partitions_of_a_counted_table_follow_its_rows(spark, monkeypatch):
    left = spark.range(1000).selectExpr("id % 100 AS k", "id % 500 AS a")
    assert skew.task_partitions(left, skew.SPREAD_ROWS) is None
    assert skew.task_partitions(left, 10**9) == 1000
    monkeypatch.setattr(skew, "SPREAD_ROWS", 10)
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    right = spark.range(100).selectExpr("id AS k", "-id AS b")
    joined = skew_join(left, right, ["k"], None, "inner", True, skew.task_partitions(left, 1000))
    assert "hashpartitioning(k" in joined._jdf.queryExecution().executedPlan().toString()
    assert ", 20), REPARTITION_BY_NUM" in joined._jdf.queryExecution().executedPlan().toString()
    assert rows(joined) == rows(left.distinct().join(right, "k"))
