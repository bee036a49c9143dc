"""Run summary and the check of written results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.graph import TaggedGraph
from tagweave.operators.stars import star_match_counts, star_selectivity, star_table
from tagweave.pattern import Pattern
from tagweave.plans.match import match_count
from tagweave.plans.order import star_order


def match_summary(graph: TaggedGraph, pattern: Pattern, result_count: int | None = None) -> DataFrame:
    """One row per star: its structure, candidate roots, start weight, place in the join
    order, and the number of matches of the whole pattern."""
    spark, stars = graph.spark, pattern.stars
    counted = [(r.star_id, r.n) for r in star_match_counts(graph.tagged, stars).collect()]
    position = {s.star_id: i for i, s in enumerate(star_order(stars, dict(counted)))}
    rows = star_table(spark, stars)
    weights = star_selectivity(rows, spark.createDataFrame(counted, "star_id int, n long"))
    places = spark.createDataFrame(list(position.items()), "star_id int, join_position int")
    if result_count is None:
        result_count = match_count(graph, pattern)
    children = F.concat_ws(",", F.transform("children", lambda child: child["id"].cast("string")))
    return (
        rows.select("star_id", "root", "root_tag", children.alias("children"))
        .join(weights.select("star_id", "n", "weight"), "star_id")
        .join(places, "star_id")
        .withColumn("result_count", F.lit(result_count).cast("long"))
    )


def non_injective_rows(lines: DataFrame) -> DataFrame:
    """Result lines in which an id occurs twice: (value)."""
    ids = F.split("value", ",")
    return lines.where(F.size(F.array_distinct(ids)) != F.size(ids)).select("value")
