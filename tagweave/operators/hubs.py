"""Fan-out of hub vertices, and the join splits that follow from it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.expressions import quoted
from tagweave.operators.skew import BROADCAST_ROWS, SPLIT_ROWS, few_or_stored, hot_keys, rows_up_to, splits_from

Pair = tuple[int, int]
#: Columns of the table of hubs: one row per hub, direction and tag pair with more than ``split_at`` edges.
HUB_SCHEMA = "side string, src_tag int, dst_tag int, id long, n long"


@dataclass(frozen=True)
class Hubs:
    """Edges of each hub per tag pair, the hub as source and as target, as a table of any size.

    The driver knows only which tag pairs have hubs. Empty for a graph without hubs;
    then no join is split for one and the plans are the plain ones.
    """

    table: DataFrame | None = None
    touched: frozenset[tuple[str, Pair]] = frozenset()
    split_at: int = SPLIT_ROWS

    def __bool__(self) -> bool:
        return bool(self.touched)

    def touch(self, pair: Pair) -> bool:
        """Whether a hub has edges of this tag pair beyond the limit."""
        return ("src", pair) in self.touched or ("dst", pair) in self.touched

    def _edges(self, side: str, pairs: Iterable[Pair]) -> DataFrame | None:
        wanted = [pair for pair in set(pairs) if (side, pair) in self.touched]
        if not wanted:
            return None
        of_pair = " OR ".join(f"(src_tag = {a} AND dst_tag = {b})" for a, b in sorted(wanted))
        return self.table.where(f"side = '{side}' AND ({of_pair})").groupBy("id").agg(F.sum("n").alias("n"))

    def sources(self, key: str) -> DataFrame | None:
        """Hubs with very many out-edges of some tag pair: (key)."""
        if not any(side == "src" for side, _ in self.touched):
            return None
        return few_or_stored(self.table.where("side = 'src'").select(F.col("id").alias(key)).distinct())

    def with_tag(self, tag: int) -> DataFrame | None:
        """Hubs carrying a tag, with their largest fan-out over all tag pairs: (id, most)."""
        if not any(pair[side == "dst"] == tag for side, pair in self.touched):
            return None
        own = f"(side = 'src' AND src_tag = {tag}) OR (side = 'dst' AND dst_tag = {tag})"
        return self.table.where(own).groupBy("id").agg(F.max("n").alias("most"))

    def end_splits(self, pairs: Iterable[Pair], side: str, key: str) -> DataFrame | None:
        """Splits for edges (left) joined by one end with at most a few rows per vertex."""
        counts = self._edges(side, pairs)
        return splits_from(counts and counts.withColumnRenamed("id", key), [key], "n", "1", self.split_at)

    def extend_splits(self, pair: Pair, bound_is_src: bool, key: str) -> DataFrame | None:
        """Splits for partial matches (left) against a slice (right) joined on one end.

        A hub's partial matches are taken to be as many as its largest fan-out, its rows in the slice are
        known. Both sides are split, as far as their product asks for.
        """
        bound = self.with_tag(pair[0] if bound_is_src else pair[1])
        if bound is None:
            return None
        in_slice = self._edges("src" if bound_is_src else "dst", [pair])
        if in_slice is None:
            counts = bound.withColumn("n", F.lit(1))
        else:
            counts = bound.join(in_slice, "id", "left")
        return splits_from(counts.withColumnRenamed("id", key), [key], "most", "coalesce(n, 1)", self.split_at)

    def vertex_splits(self, tag: int, key: str) -> DataFrame | None:
        """Splits for partial matches (left) joined on a vertex with a table of one row per vertex."""
        bound = self.with_tag(tag)
        return splits_from(bound and bound.withColumnRenamed("id", key), [key], "most", "1", self.split_at)

    def close_splits(self, pair: Pair, keys: list[str]) -> tuple[DataFrame, DataFrame] | None:
        """Shares per hub for both ends of a closing edge; only hub to hub edges are split."""
        tables = []
        for tag, key in zip(pair, keys):
            hubs = self.with_tag(tag)
            counts = hubs and hubs.withColumnRenamed("id", key)
            splits = splits_from(counts, [key], "most", "1", self.split_at)
            if splits is None:
                return None
            tables.append(splits.selectExpr(quoted(key), "left_parts AS parts"))
        return tables[0], tables[1]


def hubs_from_table(table: DataFrame, split_at: int = SPLIT_ROWS) -> Hubs:
    """Hubs from a stored table; one row per tag pair and direction comes to the driver."""
    touched = frozenset(
        (row["side"], (row["src_tag"], row["dst_tag"]))
        for row in table.select("side", "src_tag", "dst_tag").distinct().collect()
    )
    return Hubs(table if touched else None, touched, split_at)


def hub_rows(tagged: DataFrame, endpoints: DataFrame | None, split_at: int = SPLIT_ROWS) -> DataFrame:
    """Fan-out per tag pair of the vertices that ``hub_endpoints`` found, as rows of ``HUB_SCHEMA``.

    Only edges at such a vertex are aggregated, a semi join drops the others. Where the vertices are too many for a broadcast, most edges are at
    one of them: then all are aggregated, which shuffles counts and no edges.
    """
    spark: SparkSession = tagged.sparkSession
    result = spark.createDataFrame([], HUB_SCHEMA)
    if endpoints is None:
        return result.coalesce(1)
    (found,) = rows_up_to([endpoints])
    for side in ("src", "dst"):
        at_hub = tagged
        if found <= BROADCAST_ROWS:
            ids = endpoints.where(F.col("side") == side).select(F.col("id").alias(side))
            at_hub = tagged.join(ids, side, "left_semi")
        counted = hot_keys(at_hub, ["src_tag", "dst_tag", side], split_at)
        result = result.union(counted.select(F.lit(side), "src_tag", "dst_tag", side, "n"))
    return result


def hub_fan_out(tagged: DataFrame, endpoints: DataFrame | None, split_at: int = SPLIT_ROWS) -> Hubs:
    """The hubs of tagged edges that are not stored with a graph."""
    table = few_or_stored(hub_rows(tagged, endpoints, split_at))
    return Hubs(split_at=split_at) if table is None else hubs_from_table(table, split_at)
