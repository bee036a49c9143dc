"""Joins that split hot keys.

One vertex may hold a third of all edges, or make most of a join's result. Such keys are found by pre-aggregated
counts and kept as a table, and are spread over several join partitions: the rows of each side are dealt out by a hash and
copied to every share of the other side. The result is the plain join's, row for row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tagweave.functions.expressions import named
from tagweave.session import new_folder

# Rows of one key on one side of a join beyond which the key is split.
SPLIT_ROWS = 16_384
# Result rows of one key beyond which it is split, for each row of the limit above.
RESULT_FACTOR = 64
# Cells of a key for each shuffle partition: more would not spread it any further.
CELLS_PER_PARTITION = 16
# Rows of (long, long) up to which a side, once counted, is broadcast.
BROADCAST_ROWS = 250_000
# Expected result rows beyond which a small input is spread over all tasks first.
SPREAD_ROWS = 5_000_000
# Rows that a task is given of a large table whose size has been counted.
TASK_ROWS = 1_000_000


def task_partitions(df: DataFrame, rows: int) -> int | None:
    """Partitions in which a table of ``rows`` rows is shuffled, so that a task's memory does not grow with it; None leaves a small one to the session."""
    if rows <= SPREAD_ROWS:
        return None
    # No fewer than usual: Spark would shuffle once more for the other side of a join that has more of them.
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def hot_keys(df: DataFrame, keys: Sequence[str], split_at: int = SPLIT_ROWS) -> DataFrame:
    """The keys with more than ``split_at`` rows: (key..., n)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > split_at)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The same rows, written to the shared folder and read back, and their number, which is observed while they are written."""
    spark, path, seen = df.sparkSession, new_folder(df.sparkSession, name), Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


def few_or_stored(df: DataFrame, rows: int | None = None) -> DataFrame | None:
    """A table that is used several times, computed and written once; None if it has no rows.

    Up to ``rows`` rows it is marked for a broadcast. A larger table is joined as any other. The limit only decides between the two.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    table, n = kept(df, "keys")
    if not n:
        return None
    return F.broadcast(table) if n <= rows else table


def splits_from(
    counts: DataFrame | None, keys: Sequence[str], left: str, right: str, split_at: int = SPLIT_ROWS
) -> DataFrame | None:
    """Shares of the keys that one task should not join alone: (key..., left_parts, right_parts), or None.

    ``counts`` has the keys, ``left`` and ``right`` are SQL expressions for the expected rows of a key on either side. Cells hold at most
    ``split_at`` rows of a side and ``RESULT_FACTOR`` times as many result rows; the grid has the shape that copies least.

    Of more keys than a broadcast takes, only those are split that make more of the join than a small part of one partition. All others are joined
    unsplit: each is less than that, so the hash alone spreads them evenly, and neither side is shuffled once more to find its shares.
    """
    if counts is None:
        return None
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = CELLS_PER_PARTITION * max(partitions, 8)
    rows = counts.select(
        *[named(k) for k in keys],
        F.expr(f"greatest(1D, double({left}))").alias("l"),
        F.expr(f"greatest(1D, double({right}))").alias("r"),
    )
    work = f"greatest(l * r / {RESULT_FACTOR * split_at}D, greatest(l, r) / {split_at}D)"
    shaped = rows.withColumn("work", F.expr(work)).withColumn("cells", F.expr(f"least({most}D, ceil(work))")).where("cells > 1")
    shaped = shaped.withColumn("left_parts", F.expr("bigint(ceil(greatest(1D, least(cells, l, sqrt(cells * l / r)))))"))
    shares = F.expr("bigint(ceil(cells / left_parts))").alias("right_parts")
    table, n = kept(shaped.select(*[named(k) for k in keys], "left_parts", shares, "work"), "keys")
    if n > BROADCAST_ROWS:
        table = table.where(F.col("work") * most >= table.agg(F.sum("work")).first()[0])
        n = table.count()
    if not n:
        return None
    table = table.drop("work")
    return F.broadcast(table) if n <= BROADCAST_ROWS else table


def _deal(df: DataFrame, keys: Sequence[str], splits: DataFrame, own: str, other: str) -> DataFrame:
    """Give every row its own share and a copy for each share of the other side."""
    columns = df.columns
    own_parts = F.coalesce(F.col(f"{own}_parts"), F.lit(1))
    other_parts = F.coalesce(F.col(f"{other}_parts"), F.lit(1))
    return df.join(splits, list(keys), "left").select(
        *[named(c) for c in columns],
        F.pmod(F.xxhash64(*[named(c) for c in columns]), own_parts).alias(f"{own}_share"),
        F.explode(F.sequence(F.lit(0).cast("long"), other_parts - 1)).alias(f"{other}_share"),
    )


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    splits: DataFrame | None = None,
    how: str = "inner",
    distinct: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Equi-join in which the keys of ``splits`` are spread over a grid of shares.

    ``splits`` has the key columns, ``left_parts`` and ``right_parts``. For left outer
    and semi joins ``right_parts`` must be 1, otherwise left rows would be repeated. With ``distinct`` the left
    rows are first made a set, in the exchange that the join needs anyway. ``partitions`` is the number of that exchange's partitions,
    where the left rows have been counted.
    """
    shares: list[str] = []
    if splits is not None:
        shares = ["left_share", "right_share"]
        left = _deal(left, keys, splits, "left", "right")
        right = _deal(right, keys, splits, "right", "left")
    if distinct or partitions:
        left = left.repartition(*filter(None, [partitions]), *[named(c) for c in (*keys, *shares)])
    if distinct:
        left = left.distinct()
    return left.join(right, [*keys, *shares], how).drop(*shares)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all shuffle partitions; their number is kept by the planner."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *[named(c) for c in df.columns])


def grid_product(
    left: DataFrame, right: DataFrame, condition: str = "", left_rows: int | None = None, right_rows: int | None = None
) -> DataFrame:
    """Every pair of rows of two tables, computed as an equi-join on a grid of cells.

    The rows of each side are dealt to the grid's rows or columns by a hash and copied along the other axis. A side
    that is known to be small by its number of rows is copied to all cells, and the other one is not copied at all; otherwise the grid is square. There are
    several cells for each partition, so that partitions get even shares.
    """
    cells = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, round(cells**0.5))
    shape = (side, side)
    if right_rows is not None and right_rows <= BROADCAST_ROWS:
        shape = (cells, 1)
    elif left_rows is not None and left_rows <= BROADCAST_ROWS:
        shape = (1, cells)

    def place(df: DataFrame, own: str, size: int, other: str, copies: int) -> DataFrame:
        share = F.pmod(F.xxhash64(*[named(c) for c in df.columns]), F.lit(size)).cast("int")
        every = F.sequence(F.lit(0), F.lit(copies - 1))
        return df.select("*", share.alias(own), F.explode(every).alias(other))

    pairs = place(left, "cell_row", shape[0], "cell_col", shape[1]).join(
        place(right, "cell_col", shape[1], "cell_row", shape[0]), ["cell_row", "cell_col"]
    ).drop("cell_row", "cell_col")
    return pairs.where(condition) if condition else pairs


def rows_up_to(tables: Sequence[DataFrame], rows: int | None = None) -> list[int]:
    """The number of rows of each table, or ``rows + 1`` where there are more; one job for all."""
    rows = BROADCAST_ROWS if rows is None else rows
    marks = [df.select(F.lit(i).alias("i")).limit(rows + 1) for i, df in enumerate(tables)]
    counted = dict(reduce(DataFrame.union, marks).groupBy("i").count().collect())
    return [counted.get(i, 0) for i in range(len(tables))]
