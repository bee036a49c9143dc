"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (
        both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns ``a`` and ``b``).

    ``root`` is the least node that can be reached. Links may be repeated, reversed or
    from a node to itself; nulls link nothing. No links give no rows. The state between
    rounds is a written table, the driver sees one count and one checksum per round.
    """
    a, b = edges.columns
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    links = links.where("a is not null and b is not null")
    alone = links.where("a = b").select(F.col("a").alias("node"))
    links = stored(links.where("a <> b").distinct(), "links")
    state = _state(links)
    while state[0]:
        after = stored(_small_star(_large_star(links)), "links")
        links, before, state = after, state, _state(after)
        if state == before:
            break
    found = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root"))
    lone = alone.select("node", F.col("node").alias("root"))
    return found.union(roots).union(lone).groupBy("node").agg(F.min("root").alias("root"))
