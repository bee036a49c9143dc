"""Text sources and sinks: ``id tag`` and ``src dst`` lines in, match lines out.

One space between tokens, empty lines skipped, tokens after the second ignored. A
line that does not parse stops the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.expressions import graph_token, match_line
from tagweave.pattern import Pattern


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.length("value") > 0)


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """``id tag`` lines as (id LONG, tag INT)."""
    line = F.col("value")
    return _lines(spark, path).select(
        graph_token(line, 0, "long").alias("id"), graph_token(line, 1, "int").alias("tag")
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src dst`` lines as (src LONG, dst LONG)."""
    line = F.col("value")
    return _lines(spark, path).select(
        graph_token(line, 0, "long").alias("src"), graph_token(line, 1, "long").alias("dst")
    )


def read_pattern(spark: SparkSession, vertex_path: str, edge_path: str) -> Pattern:
    """A query graph from its two files. It is small, so its rows come to the driver."""
    line = F.col("value")
    in_file_order = (
        _lines(spark, vertex_path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("position"),
            graph_token(line, 0, "long").alias("id"),
            graph_token(line, 1, "int").alias("tag"),
        )
        .orderBy("file", "block", "position")
        .collect()
    )
    edges = read_edges(spark, edge_path).collect()
    return Pattern(
        tuple((row.id, row.tag) for row in in_file_order),
        tuple((row.src, row.dst) for row in edges),
    )


def write_vertices(vertices: DataFrame, path: str) -> None:
    vertices.select(F.concat_ws(" ", "id", "tag").alias("value")).write.mode("error").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("error").text(path)


def write_matches(matches: DataFrame, path: str, file_format: str = "text") -> int:
    """One comma separated line per match, or the same columns as Parquet; returns the number of matches.

    The number is observed while the rows are written, nothing is read again. An existing path is refused, so a finished result is never overwritten.
    """
    seen = Observation("matches")
    matches = matches.observe(seen, F.count(F.lit(1)).alias("rows"))
    if file_format == "text":
        matches.select(match_line(matches.columns).alias("value")).write.mode("error").text(path)
    elif file_format == "parquet":
        matches.write.mode("error").parquet(path)
    else:
        raise ValueError(f"unknown match format: {file_format}")
    return seen.get["rows"]


def read_match_lines(spark: SparkSession, path: str) -> DataFrame:
    """Result lines as (value STRING)."""
    return spark.read.text(path)
