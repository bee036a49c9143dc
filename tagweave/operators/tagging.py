"""Tagged edges: attaching vertex tags to edges, and checks of the two inputs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.expressions import fail
from tagweave.operators.hubs import Hubs
from tagweave.operators.skew import SPLIT_ROWS, few_or_stored, hot_keys, skew_join, splits_from, task_partitions
from tagweave.operators.slices import tag_bucket
from tagweave.session import leave_note, read_note, small_shuffle_reads


def conflicting_tags(vertices: DataFrame) -> DataFrame:
    """Ids listed with more than one tag: (id, n_tags)."""
    return (
        vertices.groupBy("id")
        .agg(F.count_distinct("tag").alias("n_tags"))
        .where(F.col("n_tags") > 1)
    )


def unique_vertices(vertices: DataFrame) -> DataFrame:
    """One row per id. An id with two tags stops the job that reads it."""
    tag = F.when(F.col("tag") == F.col("other_tag"), F.col("tag")).otherwise(
        fail("conflicting tags for vertex ", F.col("id")).cast("int")
    )
    return (
        vertices.groupBy("id")
        .agg(F.min("tag").alias("tag"), F.max("tag").alias("other_tag"))
        .select("id", tag.alias("tag"))
    )


def dangling_edges(vertices: DataFrame, edges: DataFrame, split_at: int = SPLIT_ROWS) -> DataFrame:
    """Distinct edges with an endpoint that is not a vertex.

    Endpoints are reduced to distinct ids, with the number of their edges, before the anti join. The missing ids are
    kept as a table and those with very many edges are split.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    missing = few_or_stored(ends.join(vertices.select("id"), "id", "left_anti"))
    if missing is None:
        return edges.select("src", "dst").limit(0)
    parts = []
    for end in ("src", "dst"):
        own = missing.withColumnRenamed("id", end)
        splits = splits_from(own.where(F.col("n") > split_at), [end], "n", "1", split_at)
        parts.append(skew_join(edges.select("src", "dst"), own.select(end), [end], splits, "left_semi"))
    return parts[0].select("src", "dst").union(parts[1].select("src", "dst")).distinct()


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each edge once: (src, dst)."""
    return edges.select("src", "dst").distinct()


def hub_endpoints(edges: DataFrame, split_at: int = SPLIT_ROWS) -> DataFrame | None:
    """Vertices with about ``split_at`` edges or more in one direction: (side, id, n), side 'src' or 'dst'; None without any.

    Counted on a fixed-seed sample that shows some 256 edges of the smallest hub. The
    counts only decide how far a join key is split, never which rows are joined.
    """
    fraction = min(1.0, 256 / split_at)
    if fraction < 1:
        edges = edges.sample(fraction, seed=1)
    end = lambda side: F.struct(F.lit(side).alias("side"), F.col(side).alias("id"))
    ends = edges.select(F.inline(F.array(end("src"), end("dst"))))
    # Half the expected count, so that a hub is not missed by chance.
    found = hot_keys(ends, ["side", "id"], int(split_at * fraction / 2))
    return few_or_stored(found.withColumn("n", (F.col("n") / fraction).cast("long")))


def tag_edges(
    vertices: DataFrame,
    edges: DataFrame,
    on_dangling: str = "error",
    hubs: DataFrame | None = None,
    split_at: int = SPLIT_ROWS,
) -> DataFrame:
    """Edges with both tags: (src, dst, src_tag, dst_tag), each edge once.

    ``hubs`` (from ``hub_endpoints``) splits the endpoints that hold very many edges.
    With ``on_dangling='error'`` an edge with an unknown endpoint stops the job that
    computes it, as does a vertex with two tags; with ``'drop'`` such edges are left out.
    """
    return attach_tags(unique_vertices(vertices), edges, on_dangling, hubs, split_at)


def attach_tags(
    unique: DataFrame,
    edges: DataFrame,
    on_dangling: str = "error",
    hubs: DataFrame | None = None,
    split_at: int = SPLIT_ROWS,
) -> DataFrame:
    """``tag_edges`` for vertices that are known to be listed once.

    The edges are shuffled once by source, where repeated ones are dropped and the source's tag is attached, and once by target. They are counted
    first: the number of partitions follows from it, so a task holds no more of a larger graph.
    """
    if on_dangling not in ("error", "drop"):
        raise ValueError("on_dangling must be 'error' or 'drop'")
    how = "left" if on_dangling == "error" else "inner"
    tagged = edges.select("src", "dst")
    partitions = task_partitions(tagged, tagged.count())
    for end in ("src", "dst"):
        tag = f"{end}_tag"
        lookup = unique.select(F.col("id").alias(end), F.col("tag").alias(tag))
        own = hubs and hubs.where(F.col("side") == end).select(F.col("id").alias(end), "n")
        splits = splits_from(own, [end], "n", "1", split_at)
        tagged = skew_join(tagged, lookup, [end], splits, how, end == "src", partitions)
        if on_dangling == "error":
            tagged = tagged.where(
                F.when(F.col(tag).isNotNull(), F.lit(True)).otherwise(
                    fail("edge endpoint without a tag: ", F.col(end)).cast("boolean")
                )
            )
    return tagged.select("src", "dst", "src_tag", "dst_tag")


def sorted_adjacency(tagged: DataFrame, hubs: Hubs | None = None) -> DataFrame:
    """Edges clustered by src and ordered by (src, dst_tag, dst) in each partition.

    The out-edges of a hub are clustered in several partitions, by (src, share).
    """
    order = ("src", "dst_tag", "dst")
    pairs = [pair for side, pair in hubs.touched if side == "src"] if hubs else []
    splits = hubs.end_splits(pairs, "src", "src") if hubs else None
    if splits is None:
        return tagged.repartition("src").sortWithinPartitions(*order)
    share = F.pmod(F.xxhash64("dst"), F.coalesce("left_parts", F.lit(1)))
    return (
        tagged.join(splits, "src", "left")
        .select(*tagged.columns, share.alias("share"))
        .repartition("src", "share")
        .sortWithinPartitions(*order)
        .drop("share")
    )


def store_tagged(tagged: DataFrame, path: str) -> None:
    """Write tagged edges as Parquet, in folders by tag pair and sorted by tags inside.

    A query edge then lists the files of one folder and reads the row groups of its two
    tags. Rebalancing splits a folder with many edges over several tasks and merges small
    ones, so each task writes few files of a good size. What a task sorts is kept small.
    """
    order = ("bucket", "src_tag", "dst_tag", "src")
    with small_shuffle_reads(tagged.sparkSession):
        (
            tagged.withColumn("bucket", F.expr(tag_bucket("src_tag", "dst_tag")))
            .hint("rebalance", "bucket")
            .sortWithinPartitions(*order)
            .write.mode("error")
            .partitionBy("bucket")
            .parquet(path)
        )


def load_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Stored tagged edges: (src, dst, src_tag, dst_tag, bucket)."""
    schema = "src long, dst long, src_tag int, dst_tag int, bucket int"
    return spark.read.schema(schema).parquet(path)


def table_name(path: str) -> str:
    """The catalog's name of a bucketed table: it follows from its folder, so every session finds the same table."""
    return f"tagweave_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:32]}"


def store_by_source(tagged: DataFrame, path: str, buckets: int) -> None:
    """Write tagged edges in folders by tag pair, bucketed by source and sorted by (src, dst_tag, dst) inside.

    Rows are dealt to the buckets first, so a folder has one file for each bucket. Spark joins and aggregates such slices by source without an exchange.
    """
    columns = ("src", "dst", "src_tag", "dst_tag")
    (
        tagged.select(*columns, F.expr(tag_bucket("src_tag", "dst_tag")).alias("bucket"))
        .repartition(buckets, "src")
        .write.mode("error")
        .partitionBy("bucket")
        .bucketBy(buckets, "src")
        .sortBy("src", "dst_tag", "dst")
        .option("path", path)
        .saveAsTable(table_name(path))
    )
    leave_note(tagged.sparkSession, f"{path}/_buckets", str(buckets))


def load_by_source(spark: SparkSession, path: str) -> DataFrame:
    """Edges written by ``store_by_source``, in this session or another."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} (src BIGINT, dst BIGINT, src_tag INT, dst_tag INT, bucket INT) USING parquet "
            f"PARTITIONED BY (bucket) CLUSTERED BY (src) SORTED BY (src, dst_tag, dst) INTO {int(read_note(spark, f'{path}/_buckets'))} BUCKETS "
            f"LOCATION '{path}'"
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def source_degrees(tagged: DataFrame) -> DataFrame:
    """Vertices with out-edges: (id, tag, out_degree)."""
    counted = tagged.groupBy(F.col("src").alias("id"), F.col("src_tag").alias("tag"))
    return counted.agg(F.count("*").alias("out_degree"))


def store_sources(tagged: DataFrame, path: str) -> None:
    """Write ``source_degrees`` in ranges of (tag, id): the vertices of one tag are few row groups, found by their smallest and largest tag."""
    ranges = source_degrees(tagged).repartitionByRange("tag", "id").sortWithinPartitions("tag", "id")
    ranges.write.mode("error").parquet(path)


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, tag int, out_degree long").parquet(path)
