"""A data graph prepared for matching."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tagweave.operators.hubs import HUB_SCHEMA, Hubs, Pair, hub_rows, hubs_from_table
from tagweave.operators.skew import SPLIT_ROWS
from tagweave.operators.slices import has_tag_pair
from tagweave.operators.tagging import (
    attach_tags,
    hub_endpoints,
    load_by_source,
    load_sources,
    load_tagged,
    store_by_source,
    store_sources,
    store_tagged,
    unique_vertices,
)
from tagweave.session import exists, new_folder


@dataclass(frozen=True)
class TaggedGraph:
    """Vertices (id, tag), tagged edges (src, dst, src_tag, dst_tag), and the hubs.

    ``by_source`` are the edges once more, bucketed by source; ``sources`` are the vertices with out-edges (id, tag,
    out_degree), stored by tag. Both are made on demand, see ``bucketed`` and ``indexed``.
    """

    vertices: DataFrame
    tagged: DataFrame
    hubs: Hubs = field(default_factory=Hubs)
    by_source: DataFrame | None = None
    sources: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.tagged.sparkSession

    def edges_of(self, pairs: Iterable[Pair]) -> DataFrame:
        """The table from which edges of some tag pairs are read: the bucketed one, unless a hub would make one of its buckets large."""
        if self.by_source is None or any(("src", pair) in self.hubs.touched for pair in pairs):
            return self.tagged
        return self.by_source

    def bucketed(self, buckets: int | None = None, store: str | None = None) -> TaggedGraph:
        """Stores the edges once more, bucketed and sorted by source: joins and counts by source then need no exchange.

        ``buckets`` is the number of shuffle partitions where it is not given. Tag pairs with a source that is a hub are left out; they are
        read from the other table, whose files split.
        """
        path = store or new_folder(self.spark, "by-source")
        hot = [pair for side, pair in self.hubs.touched if side == "src"]
        rows = self.tagged.where(f"NOT ({has_tag_pair(hot)})") if hot else self.tagged
        store_by_source(rows, path, buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return replace(self, by_source=load_by_source(self.spark, path))

    def indexed(self, store: str | None = None) -> TaggedGraph:
        """Stores the vertices with out-edges by tag, with their out-degree; ``vertices_by_tag`` reads one tag's row groups of it."""
        path = store or new_folder(self.spark, "sources")
        store_sources(self.tagged, path)
        return replace(self, sources=load_sources(self.spark, path))

    def persist(self) -> TaggedGraph:
        """Cache the tagged edges, for several patterns over a graph that fits in memory.

        The cache is sorted by tags, so batches of other tags are skipped. Stored edges are read in that order already.
        """
        stored = "bucket" in self.tagged.columns
        ordered = self.tagged if stored else self.tagged.sortWithinPartitions("src_tag", "dst_tag", "src")
        return replace(self, tagged=ordered.persist())

    def unpersist(self) -> None:
        self.tagged.unpersist()


def build_graph(
    vertices: DataFrame,
    edges: DataFrame,
    on_dangling: str = "error",
    store: str | None = None,
    split_at: int = SPLIT_ROWS,
    buckets: int | None = None,
    index: bool = False,
) -> TaggedGraph:
    """Tag the edges once, for all patterns, and keep them as tables.

    The tables go below ``store``, or below a new folder in ``spark.checkpoint.dir``. A
    lost executor then costs a new read, not a new tagging, and the plans built on the
    graph start from a plain scan. A dangling edge or a vertex with two tags stops this
    call. ``buckets`` and ``index`` also store what ``bucketed`` and ``indexed`` do.
    """
    spark = vertices.sparkSession
    path = store or new_folder(spark, "graph")
    # By tag, so that the vertices of one tag are few row groups.
    unique_vertices(vertices).repartitionByRange("tag", "id").sortWithinPartitions("tag", "id").write.mode(
        "error"
    ).parquet(f"{path}/vertices")
    known = _stored_vertices(spark, path)
    endpoints = hub_endpoints(edges, split_at)
    store_tagged(attach_tags(known, edges, on_dangling, endpoints, split_at), f"{path}/edges")
    tagged = load_tagged(spark, f"{path}/edges")
    hub_rows(tagged, endpoints, split_at).write.mode("error").parquet(f"{path}/hubs")
    graph = TaggedGraph(known, tagged, _stored_hubs(spark, path, split_at))
    if buckets:
        graph = graph.bucketed(buckets, f"{path}/by-source")
    return graph.indexed(f"{path}/sources") if index else graph


def load_graph(spark: SparkSession, path: str, split_at: int = SPLIT_ROWS) -> TaggedGraph:
    """A graph written by ``build_graph(store=path)``."""
    return TaggedGraph(
        _stored_vertices(spark, path),
        load_tagged(spark, f"{path}/edges"),
        _stored_hubs(spark, path, split_at),
        load_by_source(spark, f"{path}/by-source") if exists(spark, f"{path}/by-source/_buckets") else None,
        load_sources(spark, f"{path}/sources") if exists(spark, f"{path}/sources/_SUCCESS") else None,
    )


def _stored_hubs(spark: SparkSession, path: str, split_at: int) -> Hubs:
    return hubs_from_table(spark.read.schema(HUB_SCHEMA).parquet(f"{path}/hubs"), split_at)


def _stored_vertices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, tag int").parquet(f"{path}/vertices")
