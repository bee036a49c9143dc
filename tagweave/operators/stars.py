"""Star operators: neighbour-tag signatures, star candidates, counts and weights.

Everything stays in long form, one row per edge: an array of a hub's neighbours would
neither spill nor split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.operators.hubs import Hubs
from tagweave.operators.skew import skew_join, task_partitions
from tagweave.operators.slices import EDGE_COLUMNS, has_tag_pair, with_tag_pairs
from tagweave.pattern import Star

# Ids in the range of one row of the array form of a star.
BLOCK = 65_536


def neighbour_tag_counts(tagged: DataFrame) -> DataFrame:
    """Out-neighbours per tag: (src, src_tag, dst_tag, n). ``tagged`` holds each edge once."""
    return tagged.groupBy("src", "src_tag", "dst_tag").agg(F.count("*").alias("n"))


def stars(tagged: DataFrame, block: int = BLOCK) -> DataFrame:
    """One star per vertex with out-edges: (root, root_tag, block, children).

    ``children`` is an array of (id, tag) in id order. Every star is cut in the same way, into one row for each range of
    ``block`` ids that holds children, named by the first id of the range. So no row holds
    more than ``block`` children, however large a hub is.
    """
    return (
        tagged.withColumn("block", (F.col("dst") - F.pmod("dst", F.lit(block))).cast("long"))
        .groupBy(F.col("src").alias("root"), F.col("src_tag").alias("root_tag"), "block")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.col("dst").alias("id"), F.col("dst_tag").alias("tag")))
            ).alias("children")
        )
    )


def star_members(tagged: DataFrame, block: int = BLOCK, hubs: Hubs | None = None) -> DataFrame:
    """Every star in long form: (root, root_tag, pos, id, tag), a row per child, ``pos`` its place in the star's id order from 0.

    With ``hubs``, the stars of other roots are ranked as a whole, in one shuffle. A hub is ranked in parts, as is every star where the hubs are not
    known: places are counted inside ranges of ``block`` ids and added to the sizes of the ranges before.
    """
    if hubs is None:
        return _ranked_in_parts(tagged, block)
    roots = hubs.sources("src")
    if roots is None:
        return _ranked_whole(tagged)
    return _ranked_whole(tagged.join(roots, "src", "left_anti")).unionByName(
        _ranked_in_parts(tagged.join(roots, "src", "left_semi"), block)
    )


def _ranked_whole(tagged: DataFrame) -> DataFrame:
    partitions = task_partitions(tagged, tagged.count())
    dealt = tagged.repartition(partitions, "src") if partitions else tagged
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    return dealt.select(
        F.col("src").alias("root"),
        F.col("src_tag").alias("root_tag"),
        place.cast("long").alias("pos"),
        F.col("dst").alias("id"),
        F.col("dst_tag").alias("tag"),
    )


def _ranked_in_parts(tagged: DataFrame, block: int) -> DataFrame:
    ranged = tagged.select(
        F.col("src").alias("root"),
        F.col("src_tag").alias("root_tag"),
        F.col("dst").alias("id"),
        F.col("dst_tag").alias("tag"),
        (F.col("dst") - F.pmod("dst", F.lit(block))).cast("long").alias("block"),
    )
    before = Window.partitionBy("root").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("root", "block").agg(F.count("*").alias("n"))
    starts = starts.select("root", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("root", "block").orderBy("id")) - 1
    ranked = ranged.withColumn("place", place).join(starts, ["root", "block"])
    return ranked.select("root", "root_tag", (F.col("start") + F.col("place")).alias("pos"), "id", "tag")


def star_table(spark: SparkSession, pattern_stars: Sequence[Star]) -> DataFrame:
    """The stars of a pattern: (star_id, root, root_tag, out_degree, children)."""
    return spark.createDataFrame(
        [(s.star_id, s.root, s.root_tag, s.out_degree, list(s.children)) for s in pattern_stars],
        "star_id int, root long, root_tag int, out_degree int, children array<struct<id: long, tag: int>>",
    )


def star_child_tags(star_rows: DataFrame) -> DataFrame:
    """Children of each star grouped by tag: (star_id, dst_tag, k)."""
    return (
        star_rows.select("star_id", F.explode("children").alias("child"))
        .groupBy("star_id", F.col("child.tag").alias("dst_tag"))
        .agg(F.count("*").alias("k"))
    )


def star_tag_pairs(pattern_stars: Sequence[Star]) -> list[tuple[int, int]]:
    return sorted({(s.root_tag, tag) for s in pattern_stars for tag in s.required})


def signatures(tagged: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Per source vertex, its neighbour count for each tag pair: (src, src_tag, n0, n1, ...).

    One aggregation with map-side combine serves all stars of a pattern. It is keyed by
    src alone, a vertex has one tag, so joins on src need no further exchange.
    """
    return with_tag_pairs(tagged, pairs).groupBy("src").agg(
        F.min("src_tag").alias("src_tag"),
        *[F.expr(f"count_if({has_tag_pair([pair])}) AS n{i}") for i, pair in enumerate(pairs)],
    )


def satisfies(star: Star, pairs: Sequence[tuple[int, int]]) -> str:
    """Signature test of a star: right tag and enough neighbours of each child tag."""
    enough = [
        f"n{pairs.index((star.root_tag, tag))} >= {k}" for tag, k in star.required.items()
    ]
    return " AND ".join([f"src_tag = {star.root_tag}", *enough])


def star_candidates(tagged: DataFrame, pattern_stars: Sequence[Star]) -> DataFrame:
    """Vertices that can be the root of each star: (star_id, root)."""
    pairs = star_tag_pairs(pattern_stars)
    fulfilled = ", ".join(f"if({satisfies(s, pairs)}, {s.star_id}, null)" for s in pattern_stars)
    return signatures(tagged, pairs).selectExpr(
        f"explode(array_compact(array({fulfilled}))) AS star_id", "src AS root"
    )


def star_roots(tagged: DataFrame, star: Star) -> DataFrame:
    """Vertices that can be the root of one star: (src)."""
    pairs = star_tag_pairs([star])
    return signatures(tagged, pairs).where(satisfies(star, pairs)).select("src")


def prune_by_star(tagged: DataFrame, star: Star, hubs: Hubs | None = None) -> DataFrame:
    """Edges of a star's tags whose source can be the root of the star."""
    pairs = star_tag_pairs([star])
    splits = hubs.end_splits(pairs, "src", "src") if hubs else None
    return skew_join(
        with_tag_pairs(tagged, pairs).select(*EDGE_COLUMNS),
        star_roots(tagged, star),
        ["src"],
        splits,
        "left_semi",
    ).select(*EDGE_COLUMNS)


def star_matches(tagged: DataFrame, pattern_stars: Sequence[Star], hubs: Hubs | None = None) -> DataFrame:
    """Candidate neighbours of each star's candidate roots: (star_id, root, dst_tag, dst)."""
    pairs = star_tag_pairs(pattern_stars)
    splits = hubs.end_splits(pairs, "src", "root") if hubs else None
    child_of_star = " OR ".join(
        f"(star_id = {s.star_id} AND dst_tag IN ({', '.join(map(str, s.required))}))"
        for s in pattern_stars
    )
    return (
        skew_join(
            with_tag_pairs(tagged, pairs).select(F.col("src").alias("root"), "dst_tag", "dst"),
            star_candidates(tagged, pattern_stars),
            ["root"],
            splits,
        )
        .where(child_of_star)
        .select("star_id", "root", "dst_tag", "dst")
    )


def star_match_counts(tagged: DataFrame, pattern_stars: Sequence[Star]) -> DataFrame:
    """Candidate roots per star, zero included: (star_id, n)."""
    counts = star_candidates(tagged, pattern_stars).groupBy("star_id").agg(F.count("*").alias("n"))
    return (
        star_table(tagged.sparkSession, pattern_stars)
        .select("star_id")
        .join(counts, "star_id", "left")
        .select("star_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    )


def start_weight(n: Column, out_degree: Column) -> Column:
    """Weight by which the first star is chosen: few matches, many children."""
    return n.cast("double") / (out_degree * out_degree)


def star_selectivity(star_rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Start weights: (star_id, out_degree, n, weight, rank); rank 1 is the start star.

    The window has no partition key, it ranks the one row per star of a pattern.
    """
    weighted = star_rows.join(counts, "star_id").select(
        "star_id", "out_degree", "n", start_weight(F.col("n"), F.col("out_degree")).alias("weight")
    )
    return weighted.withColumn("rank", F.row_number().over(Window.orderBy("weight", "star_id")))
