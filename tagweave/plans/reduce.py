"""Full reduction of tree patterns: slices without an edge that no placement of the whole pattern uses.

Semi joins go up the pattern's tree, then down again. After that every edge of a slice is part of a placement of the whole pattern,
so a join over the slices, in any connected order, never builds a partial match that cannot be completed (but for vertices
of one tag that must differ, whose difference the joins test).
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.expressions import named
from tagweave.graph import TaggedGraph
from tagweave.operators.joins import Edge, EdgeSlice, Slices
from tagweave.operators.skew import BROADCAST_ROWS, kept, skew_join
from tagweave.operators.slices import query_slice
from tagweave.operators.stars import star_roots
from tagweave.pattern import Pattern, column


def is_tree(pattern: Pattern) -> bool:
    """Whether a connected pattern has no cycle, direction and self-loops ignored."""
    return len({frozenset(edge) for edge in pattern.edges if edge[0] != edge[1]}) == len(pattern.vertices) - 1


class _Reducer:
    def __init__(self, graph: TaggedGraph, pattern: Pattern) -> None:
        self.graph, self.pattern = graph, pattern
        self.between: dict[frozenset[int], list[Edge]] = {}
        for edge in pattern.edges:
            self.between.setdefault(frozenset(edge), []).append(edge)
        neighbours: dict[int, list[int]] = {v: [] for v, _ in pattern.vertices}
        for ends in self.between:
            if len(ends) == 2:
                a, b = ends
                neighbours[a].append(b)
                neighbours[b].append(a)
        root = max(neighbours, key=lambda v: len(neighbours[v]))
        # Vertices from the root outwards, each with its children.
        self.children: dict[int, list[int]] = {}
        waiting, seen = deque([root]), {root}
        while waiting:
            v = waiting.popleft()
            self.children[v] = [c for c in sorted(neighbours[v]) if c not in seen]
            seen.update(self.children[v])
            waiting.extend(self.children[v])

    def rows(self, ends: frozenset[int]) -> DataFrame:
        """Bindings of all edges between two vertices, or of a self-loop."""
        first, *others = (query_slice(self.graph.tagged, self.pattern, edge) for edge in self.between[ends])
        for other in others:
            first = first.join(other, [column(v) for v in sorted(ends)], "left_semi")
        return first

    def restrict(self, rows: DataFrame, ends: frozenset[int], vertex: int, keep: tuple[DataFrame, int] | None) -> DataFrame:
        if keep is None:
            return rows
        table, n = keep
        if n <= BROADCAST_ROWS:
            return rows.join(F.broadcast(table), column(vertex), "left_semi")
        splits = None
        if len(ends) == 2 and self.graph.hubs:
            a, b = self.between[ends][0]
            splits = self.graph.hubs.end_splits([self.pattern.tag_pair((a, b))], "src" if a == vertex else "dst", column(vertex))
        return skew_join(rows, table, [column(vertex)], splits, "left_semi")

    def own(self, vertex: int) -> DataFrame | None:
        """What a vertex must fulfil by itself: a self-loop, or enough neighbours of a tag that several children carry."""
        found = self.rows(frozenset([vertex])) if frozenset([vertex]) in self.between else None
        star = next((s for s in self.pattern.stars if s.root == vertex), None)
        if star is not None and max(star.required.values()) > 1:
            roots = star_roots(self.graph.tagged, star).select(F.col("src").alias(column(vertex)))
            found = roots if found is None else found.join(roots, column(vertex), "left_semi")
        return found

    def upwards(self) -> dict[int, tuple[DataFrame, int] | None]:
        """For each vertex the candidates that the edges below it leave; None where nothing restricts them."""
        left: dict[int, tuple[DataFrame, int] | None] = {}
        for v in reversed(self.children):
            found = self.own(v)
            for c in self.children[v]:
                ends = frozenset((v, c))
                part = self.restrict(self.rows(ends), ends, c, left[c]).select(named(column(v))).distinct()
                found = part if found is None else found.join(part, column(v), "left_semi")
            left[v] = None if found is None else kept(found, "reduced-vertices")
        return left

    def reduced(self) -> dict[Edge, tuple[DataFrame, int]]:
        up = self.upwards()
        root = next(iter(self.children))
        down = {root: up[root]}
        slices: dict[Edge, tuple[DataFrame, int]] = {}
        for v, children in self.children.items():
            for c in children:
                ends = frozenset((v, c))
                rows = self.restrict(self.restrict(self.rows(ends), ends, c, up[c]), ends, v, down[v])
                table, n = kept(rows, "reduced-slice")
                slices |= {edge: (table, n) for edge in self.between[ends]}
                # A vertex has at most as many candidates as its slice has edges.
                down[c] = (table.select(named(column(c))).distinct(), n)
        for ends, loops in self.between.items():
            if len(ends) == 1:
                (v,) = ends
                rows = self.restrict(self.rows(ends), ends, v, down[v])
                slices[loops[0]] = kept(rows, "reduced-slice")
        return slices


def reduced_slices(graph: TaggedGraph, pattern: Pattern) -> dict[Edge, tuple[DataFrame, int]]:
    """For each edge of a connected tree pattern its fully reduced slice, stored, and the number of its rows.

    Two semi joins for each edge of the pattern, on tables whose sizes are known when they are joined.
    """
    if not is_tree(pattern):
        raise ValueError("the pattern has a cycle")
    return _Reducer(graph, pattern).reduced()


def slices_from(graph: TaggedGraph, pattern: Pattern, reduced: dict[Edge, tuple[DataFrame, int]]) -> Slices:
    """Reduced slices as the join steps take them."""

    def slice_of(edge: Edge) -> EdgeSlice:
        rows, n = reduced[edge]
        few = rows if n <= BROADCAST_ROWS and not graph.hubs.touch(pattern.tag_pair(edge)) else None
        return EdgeSlice(edge, rows, n, few, graph.hubs)

    return slice_of
