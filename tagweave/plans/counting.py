"""Numbers of embeddings by sums over single vertices: nothing is listed that has more vertices than the order of sums needs.

An embedding gives different vertices of one tag different data vertices. Placements that need not do so are counted by eliminating
one pattern vertex after the other: its edges are joined and summed over it. Those in which vertices coincide are the placements of the
pattern with these vertices merged; over all ways to merge vertices of one tag into blocks, with the factor
(-1)^(b-1) (b-1)! for each block of b, the sum is the number of embeddings (Moebius inversion). Adjacent vertices are kept apart in
their slice and never merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.expressions import named
from tagweave.graph import TaggedGraph
from tagweave.operators.joins import Edge
from tagweave.operators.skew import RESULT_FACTOR, few_or_stored, skew_join, splits_from
from tagweave.operators.slices import edges_for
from tagweave.pattern import Pattern, column

#: Merged patterns beyond which a pattern is listed instead; the plan grows with their number.
MOST_TERMS = 60


def wide(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def times(left: Column, right: Column) -> Column:
    return wide(left * right)


@dataclass(frozen=True)
class Part:
    """A connected pattern with weights: (vertex, tag, weighted pattern vertices merged in it) and edges."""

    vertices: tuple[tuple[int, int, tuple[int, ...]], ...]
    edges: tuple[Edge, ...]

    @property
    def tag_of(self) -> dict[int, int]:
        return {v: tag for v, tag, _ in self.vertices}

    def renumbered(self) -> Part:
        """A form in which parts that differ only in their vertex ids are equal."""
        if len(self.vertices) > 5:
            return self
        forms = []
        for order in permutations(self.vertices):
            place = {v: i for i, (v, _, _) in enumerate(order)}
            labels = tuple((i, tag, weights) for i, (_, tag, weights) in enumerate(order))
            forms.append((labels, tuple(sorted((place[a], place[b]) for a, b in self.edges))))
        return Part(*min(forms))


@dataclass(frozen=True)
class Factor:
    """A table over some vertices, ``v<id>`` columns, each combination once; ``w`` counts placements of what was eliminated."""

    scope: frozenset[int]
    rows: DataFrame
    weighted: bool


def blocks_of(vertices: list[int], apart: set[frozenset[int]]) -> Iterator[list[list[int]]]:
    """All partitions of some vertices into blocks without two that are ``apart``."""
    if not vertices:
        yield []
        return
    first, *rest = vertices
    for blocks in blocks_of(rest, apart):
        yield [[first], *blocks]
        for i, block in enumerate(blocks):
            if all(frozenset((first, other)) not in apart for other in block):
                yield [*blocks[:i], [first, *block], *blocks[i + 1 :]]


def merged_patterns(vertices: list[tuple[int, int]], edges: list[Edge]) -> Iterator[tuple[int, dict[int, int]]]:
    """The factor of each way to merge vertices of one tag, and the vertex that each vertex becomes."""
    apart = {frozenset(edge) for edge in edges if edge[0] != edge[1]}
    by_tag: dict[int, list[int]] = {}
    for v, tag in vertices:
        by_tag.setdefault(tag, []).append(v)
    # Lazily: the partitions of many vertices of one tag are too many to hold.
    for partitions in _combinations([(group, apart) for group in by_tag.values()]):
        blocks = [block for partition in partitions for block in partition]
        factor = 1
        for block in blocks:
            factor *= (-1) ** (len(block) - 1) * factorial(len(block) - 1)
        yield factor, {v: block[0] for block in blocks for v in block}


def _combinations(groups: list[tuple[list[int], set[frozenset[int]]]]) -> Iterator[list[list[list[int]]]]:
    if not groups:
        yield []
        return
    for blocks in blocks_of(*groups[0]):
        for others in _combinations(groups[1:]):
            yield [blocks, *others]


def connected_parts(vertices: set[int], edges: set[Edge]) -> list[set[int]]:
    parts: list[set[int]] = [{v} for v in sorted(vertices)]
    for a, b in sorted(edges):
        touching = [p for p in parts if a in p or b in p]
        parts = [p for p in parts if p not in touching] + [set().union(*touching)]
    return parts


def embedding_terms(
    vertices: list[tuple[int, int]], edges: list[Edge], weighted: set[int]
) -> tuple[list[Part], list[tuple[int, Counter]]]:
    """The distinct connected parts of all merged patterns, and the terms of the sum: a factor and how often each part occurs in its product."""
    tag_of = dict(vertices)
    parts: dict[Part, int] = {}
    terms: Counter = Counter()
    for factor, becomes in merged_patterns(vertices, edges):
        merged = {(becomes[a], becomes[b]) for a, b in edges}
        product: Counter = Counter()
        for members in connected_parts(set(becomes.values()), merged):
            labels = tuple(
                (m, tag_of[m], tuple(v for v, to in sorted(becomes.items()) if to == m and v in weighted)) for m in sorted(members)
            )
            part = Part(labels, tuple(sorted(e for e in merged if e[0] in members))).renumbered()
            product[parts.setdefault(part, len(parts))] += 1
        terms[tuple(sorted(product.items()))] += factor
    return list(parts), [(factor, Counter(dict(product))) for product, factor in terms.items() if factor]


def embedding_count(
    graph: TaggedGraph, vertices: list[tuple[int, int]], edges: list[Edge], weights: dict[int, DataFrame]
) -> DataFrame | None:
    """Embeddings of a pattern, each counted with its vertices' weights (``id, w``), as one row ``n``; one job for all terms.

    None if there are more than ``MOST_TERMS`` merged patterns.
    """
    if sum(1 for _ in islice(merged_patterns(vertices, edges), MOST_TERMS + 1)) > MOST_TERMS:
        return None
    parts, terms = embedding_terms(vertices, edges, set(weights))
    totals = [part_total(graph, part, weights).select("n", F.lit(i).alias("i")) for i, part in enumerate(parts)]
    of_part = [F.max(F.when(F.col("i") == i, F.col("n"))) for i in range(len(parts))]
    total = None
    for factor, product in terms:
        value = wide(F.lit(factor))
        for i, times_used in product.items():
            for _ in range(times_used):
                value = times(value, of_part[i])
        total = value if total is None else wide(total + value)
    return reduce(DataFrame.union, totals).agg(total.alias("n"))


def part_total(graph: TaggedGraph, part: Part, weights: dict[int, DataFrame]) -> DataFrame:
    """Weighted placements of a connected part, in which distinct vertices may coincide unless they are adjacent, as one row ``n``."""
    factors = _base_factors(graph, part, weights)
    order = _elimination_order(graph, part)
    for vertex in order[:-1]:
        factors = _eliminated(graph, part, factors, vertex)
    last = _joined(graph, part, factors, order[-1])
    return last.rows.agg(_sum(last).alias("n"))


def _sum(factor: Factor) -> Column:
    if factor.weighted:
        return wide(F.coalesce(F.sum("w"), F.lit(0)))
    return wide(F.count("*"))


def _base_factors(graph: TaggedGraph, part: Part, weights: dict[int, DataFrame]) -> list[Factor]:
    tag_of, factors = part.tag_of, []
    for a, b in part.edges:
        rows = edges_for(graph.tagged, tag_of[a], tag_of[b])
        if a == b:
            rows = rows.where("src = dst").select(F.col("src").alias(column(a)))
        else:
            rows = rows.where("src <> dst") if tag_of[a] == tag_of[b] else rows
            rows = rows.select(F.col("src").alias(column(a)), F.col("dst").alias(column(b)))
        factors.append(Factor(frozenset((a, b)), rows, False))
    for v, _, merged in part.vertices:
        for weighted in merged:
            factors.append(Factor(frozenset([v]), weights[weighted].select(F.col("id").alias(column(v)), "w"), True))
    if not factors:
        ((v, tag, _),) = part.vertices
        rows = graph.vertices.where(F.col("tag") == tag).select(F.col("id").alias(column(v)))
        factors.append(Factor(frozenset([v]), rows, False))
    return factors


def _elimination_order(graph: TaggedGraph, part: Part) -> list[int]:
    """Vertices with few neighbours first; of several that close a cycle those with many data vertices, which have few edges each."""
    links = {v: set() for v, _, _ in part.vertices}
    for a, b in part.edges:
        if a != b:
            links[a].add(b)
            links[b].add(a)
    population: dict[int, int] = {}
    order = []
    while links:
        fewest = min(len(n) for n in links.values())
        ready = [v for v, n in links.items() if len(n) == fewest]
        if fewest > 1 and not population:
            tags = list({tag for _, tag, _ in part.vertices})
            population = dict(graph.vertices.where(F.col("tag").isin(tags)).groupBy("tag").count().collect())
        vertex = max(ready, key=lambda v: (population.get(part.tag_of[v], 0), -v))
        order.append(vertex)
        others = links.pop(vertex)
        for v in others:
            links[v] = (links[v] | others) - {v, vertex}
    return order


def _joined(graph: TaggedGraph, part: Part, factors: list[Factor], vertex: int) -> Factor:
    """The product of all factors on a vertex, and of those that lie within their vertices."""
    own = [f for f in factors if vertex in f.scope]
    scope = frozenset().union(*(f.scope for f in own))
    todo = own + [f for f in factors if vertex not in f.scope and f.scope <= scope]
    result = max(todo, key=lambda f: (vertex in f.scope, len(f.scope)))
    todo.remove(result)
    while todo:
        # Checks of bound vertices before new ones.
        other = min(todo, key=lambda f: (len(f.scope - result.scope), -len(f.scope & result.scope)))
        todo.remove(other)
        keys = [column(v) for v in sorted(result.scope & other.scope)]
        right = other.rows.withColumnRenamed("w", "w_other") if other.weighted else other.rows
        rows = skew_join(result.rows, right, keys, _shared_splits(graph, result.rows, other.rows, keys))
        weighted = result.weighted or other.weighted
        scope_now = result.scope | other.scope
        weight = [times(F.col("w"), F.col("w_other"))] if result.weighted and other.weighted else [F.col("w_other")] if other.weighted else [F.col("w")]
        columns = [named(column(v)) for v in sorted(scope_now)]
        rows = rows.select(*columns, *[c.alias("w") for c in weight if weighted])
        result = Factor(scope_now, rows, weighted)
    return result


def _eliminated(graph: TaggedGraph, part: Part, factors: list[Factor], vertex: int) -> list[Factor]:
    """The factors after a vertex has been summed over."""
    joined = _joined(graph, part, factors, vertex)
    rest = [f for f in factors if not f.scope <= joined.scope]
    scope = joined.scope - {vertex}
    rows = joined.rows.groupBy(*[named(column(v)) for v in sorted(scope)]).agg(_sum(joined).alias("w"))
    return [*rest, Factor(scope, rows, True)]


def _shared_splits(graph: TaggedGraph, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame | None:
    """Splits of a join on one vertex, by the counted rows of both sides, in a graph with hubs.

    A pair of vertices is no hot key: each side has it a few times at most.
    """
    if not graph.hubs or len(keys) > 1:
        return None
    counts = [side.groupBy(named(keys[0])).agg(F.count("*").alias(n)) for side, n in ((left, "l"), (right, "r"))]
    limit = graph.hubs.split_at
    large = counts[0].join(counts[1], keys).where(f"double(l) * r > {RESULT_FACTOR * limit} OR greatest(l, r) > {limit}")
    return splits_from(few_or_stored(large), keys, "l", "r", limit)
