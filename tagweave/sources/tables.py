"""Graphs derived from relational Parquet tables.

An entity's kind sits in its id offset, so that ids are unique over all kinds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.operators.skew import SPLIT_ROWS, few_or_stored, hot_keys

# Id offset of each kind of entity.
CUSTOMER, ORDER, PART, SUPPLIER, NATION, REGION = (
    100_000_000,
    200_000_000,
    300_000_000,
    400_000_000,
    500_000_000,
    600_000_000,
)
# Market segments, tags 11 to 15 in this order.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
# Event types, tags 1 to 5 in this order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _offset(kind: int, key: str) -> Column:
    return F.lit(kind).cast("long") + F.col(key).cast("long")


def graph_from_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, tag) and edges (src, dst) of the order processing tables.

    An edge can be listed several times; ``distinct_edges`` makes them a set, as
    ``tag_edges`` does by itself.
    """

    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    table = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}
    segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment"))
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    tagged = [
        ("customer", CUSTOMER, "c_custkey", F.lit(10) + segment),
        ("orders", ORDER, "o_orderkey", F.lit(20) + priority),
        ("part", PART, "p_partkey", F.lit(100) + brand),
        ("supplier", SUPPLIER, "s_suppkey", F.lit(40)),
        ("nation", NATION, "n_nationkey", F.lit(50)),
        ("region", REGION, "r_regionkey", F.lit(60)),
    ]
    vertices = reduce(
        DataFrame.unionByName,
        [
            table[name].select(_offset(kind, key).alias("id"), tag.cast("int").alias("tag"))
            for name, kind, key, tag in tagged
        ],
    )
    references = [
        ("orders", [(CUSTOMER, "o_custkey", ORDER, "o_orderkey")]),
        (
            "lineitem",
            [
                (ORDER, "l_orderkey", PART, "l_partkey"),
                (ORDER, "l_orderkey", SUPPLIER, "l_suppkey"),
                (PART, "l_partkey", SUPPLIER, "l_suppkey"),
            ],
        ),
        ("supplier", [(SUPPLIER, "s_suppkey", NATION, "s_nationkey")]),
        ("customer", [(CUSTOMER, "c_custkey", NATION, "c_nationkey")]),
        ("nation", [(NATION, "n_nationkey", REGION, "n_regionkey")]),
    ]
    # One scan per table: a row's references are emitted together.
    edges = reduce(
        DataFrame.unionByName,
        [
            table[name].select(
                F.inline(
                    F.array(
                        *[
                            F.struct(_offset(ka, a).alias("src"), _offset(kb, b).alias("dst"))
                            for ka, a, kb, b in pairs
                        ]
                    )
                )
            )
            for name, pairs in references
        ],
    )
    return vertices, edges


def event_graph(
    spark: SparkSession, sf_dir: str, split_at: int = SPLIT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Events tagged by type, each with an edge to the same user's next event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type"))
    vertices = events.select(F.col("event_id").cast("long").alias("id"), kind.cast("int").alias("tag"))
    timed = events.select("user_id", "ts", F.col("event_id").cast("long").alias("id"))
    return vertices, next_event_edges(timed, split_at)


#: Bits by which the position of an event is shortened from level to level: 16 ms, 4 minutes, 50 days.
LEVELS = (14, 28, 42)


def next_event_edges(events: DataFrame, split_at: int = SPLIT_ROWS) -> DataFrame:
    """(src, dst): each event (user_id, ts, id) and the same user's next one by (ts, id).

    Events without a time come before all others, in the order of their ids. A user may hold a large part of all
    events. The events of such users are ordered in levels: inside short ranges of time (of ids, where there is no
    time), then over one row per range inside longer ranges, and so on; each step links the last event of a range with the first one
    of the next. The result is the same for either way.
    """
    events = events.select("user_id", "ts", "id")
    busy = few_or_stored(hot_keys(events, ["user_id"], split_at).select(F.col("user_id").alias("busy_id")))
    if busy is None:
        return _next_in_order(events)
    same = F.col("user_id").eqNullSafe(F.col("busy_id"))
    return _next_in_order(events.join(busy, same, "left_anti")).union(
        _next_in_levels(events.join(busy, same, "left_semi"))
    )


def _next_in_order(events: DataFrame) -> DataFrame:
    by_time = Window.partitionBy("user_id").orderBy("ts", "id")
    edges = events.select(F.col("id").alias("src"), F.lead("id").over(by_time).alias("dst"))
    return edges.where(F.col("dst").isNotNull())


def _next_in_levels(events: DataFrame) -> DataFrame:
    if dict(events.dtypes)["ts"] == "timestamp":
        micros = F.unix_micros("ts")
    else:  # the wall clock, counted as if each day had 24 hours
        days = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
        seconds = F.expr("extract(SECOND FROM ts)").cast("decimal(20, 6)")
        clock = (days * 24 + F.hour("ts")) * 60 + F.minute("ts")
        micros = (clock * 60_000_000 + (seconds * 1_000_000).cast("long")).cast("long")
    # Each row stands for a range of events of which it keeps the first and the last.
    at = F.struct(F.col("ts").isNotNull().alias("timed"), F.coalesce(micros, F.col("id")).alias("place"), F.col("id"))
    rows = events.select("user_id", at.alias("first"), at.alias("last"))
    edges = []
    for bits in (*LEVELS, None):
        keys = ["user_id"]
        if bits is not None:
            rows = rows.withColumns({"timed": F.col("first.timed"), "range": F.shiftright("first.place", bits)})
            keys += ["timed", "range"]
        inside = Window.partitionBy(*keys).orderBy("first")
        follow = F.lead("first.id").over(inside)
        edges.append(rows.select(F.col("last.id").alias("src"), follow.alias("dst")))
        if bits is not None:
            rows = rows.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"))
            rows = rows.select("user_id", "first", "last")
    return reduce(DataFrame.union, edges).where(F.col("dst").isNotNull())
