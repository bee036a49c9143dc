"""Slices of the tagged edges: the rows that can realise one query edge."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tagweave.functions.expressions import quoted
from tagweave.pattern import Pattern, column

# Folders of a stored graph; a query edge reads the one of its tag pair.
TAG_BUCKETS = 64
EDGE_COLUMNS = ("src", "dst", "src_tag", "dst_tag")

Pair = tuple[int, int]


def tag_bucket(src_tag: str | int, dst_tag: str | int) -> str:
    """Folder of a tag pair in a stored graph; the planner folds it for constant tags."""
    return f"pmod(hash(int({src_tag}), int({dst_tag})), {TAG_BUCKETS})"


def has_tag_pair(pairs: Iterable[Pair]) -> str:
    """Edge has one of the given (source tag, target tag) pairs."""
    by_source: dict[int, set[int]] = {}
    for a, b in pairs:
        by_source.setdefault(a, set()).add(b)
    return " OR ".join(
        f"(src_tag = {a} AND dst_tag IN ({', '.join(map(str, sorted(targets)))}))"
        for a, targets in sorted(by_source.items())
    )


def vertices_by_tag(tagged: DataFrame, tag: int, sources: DataFrame | None = None) -> DataFrame:
    """Distinct source vertices with a tag: (src).

    From ``sources``, the stored table of an indexed graph, where there is one: a filtered scan. Otherwise from all edges.
    """
    if sources is not None:
        return sources.where(f"tag = {tag}").selectExpr("id AS src")
    return tagged.where(f"src_tag = {tag}").select("src").distinct()


def with_tag_pairs(tagged: DataFrame, pairs: Iterable[Pair]) -> DataFrame:
    """Edges with one of the given tag pairs, read from these pairs' folders only."""
    wanted = sorted(set(pairs))
    condition = f"({has_tag_pair(wanted)})"
    if "bucket" in tagged.columns:
        condition += f" AND bucket IN ({', '.join(tag_bucket(a, b) for a, b in wanted)})"
    return tagged.where(condition)


def edges_for(tagged: DataFrame, src_tag: int, dst_tag: int) -> DataFrame:
    """Edges from one tag to another: (src, dst)."""
    return with_tag_pairs(tagged, [(src_tag, dst_tag)]).select("src", "dst")


def query_slice(tagged: DataFrame, pattern: Pattern, edge: tuple[int, int]) -> DataFrame:
    """Candidate bindings of one query edge, in the match columns of its two vertices.

    A query self-loop has one column: the vertices with an edge to themselves.
    """
    a, b = edge
    rows = with_tag_pairs(tagged, [pattern.tag_pair(edge)])
    if a == b:
        return rows.where("src = dst").selectExpr(f"src AS {quoted(column(a))}")
    return rows.selectExpr(f"src AS {quoted(column(a))}", f"dst AS {quoted(column(b))}")
