"""What is measured about a pattern before matching, and the star order that follows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.slices import with_tag_pairs
from tagweave.operators.stars import satisfies, signatures, star_tag_pairs
from tagweave.pattern import Pattern, Star


@dataclass(frozen=True)
class PatternStats:
    """Candidate roots, bindings and the bindings of one root at most per star; edges and distinct sources per tag pair.

    The bindings are an upper bound, children of one tag are not kept apart.
    """

    star_counts: Mapping[int, int]
    bindings: Mapping[int, float]
    widest: Mapping[int, float]
    edges: Mapping[tuple[int, int], int]
    sources: Mapping[tuple[int, int], int]

    def selective(self, star: Star) -> bool:
        """Whether the star test drops half or more of the sources of one of its slices."""
        most = max(self.sources[(star.root_tag, tag)] for tag in star.required)
        return 2 * self.star_counts[star.star_id] <= most


def pattern_stats(tagged: DataFrame, pattern: Pattern) -> PatternStats:
    """One aggregation job over the pattern's slices; one row comes to the driver."""
    stars = pattern.stars
    pairs = star_tag_pairs(stars)
    measures = [f"count_if({satisfies(s, pairs)}) AS star{s.star_id}" for s in stars]
    for s in stars:
        ways = [f"pow(n{pairs.index((s.root_tag, tag))}, {k})" for tag, k in s.required.items()]
        measures += [
            f"{total}(if({satisfies(s, pairs)}, {' * '.join(ways)}, 0)) AS {name}{s.star_id}"
            for total, name in (("sum", "bindings"), ("max", "widest"))
        ]
    for i in range(len(pairs)):
        measures += [f"sum(n{i}) AS edges{i}", f"count_if(n{i} > 0) AS sources{i}"]
    row = signatures(tagged, pairs).selectExpr(*measures).first()
    return PatternStats(
        {s.star_id: row[f"star{s.star_id}"] for s in stars},
        {s.star_id: row[f"bindings{s.star_id}"] or 0.0 for s in stars},
        {s.star_id: row[f"widest{s.star_id}"] or 0.0 for s in stars},
        {pair: row[f"edges{i}"] or 0 for i, pair in enumerate(pairs)},
        {pair: row[f"sources{i}"] for i, pair in enumerate(pairs)},
    )


def target_counts(tagged: DataFrame, pattern: Pattern) -> dict[tuple[int, int], int]:
    """Distinct targets per tag pair of a pattern, about; one row per pair comes to the driver."""
    edges = with_tag_pairs(tagged, map(pattern.tag_pair, pattern.edges))
    counted = edges.groupBy("src_tag", "dst_tag").agg(F.approx_count_distinct("dst").alias("n"))
    return {(row["src_tag"], row["dst_tag"]): row["n"] for row in counted.collect()}


def vertex_order(
    pattern: Pattern, sizes: Mapping[tuple[int, int], int], ends: Mapping[tuple[int, int], tuple[int, int]]
) -> tuple[tuple[int, int], list[int]]:
    """The edge whose slice a match starts from, and the order in which the other vertices are bound to it.

    ``sizes`` are the edges of each slice, ``ends`` its distinct sources and targets. Each edge is tried as the start; from there the vertex
    with the fewest expected bindings comes next. The order that builds the fewest rows in all is taken: a start from the smallest
    slice can cost a product, where its vertices have very many edges of the next one.
    """
    edges = [e for e in pattern.edges if e[0] != e[1]]

    def grown(rows: float, vertex: int, bound: set[int]) -> tuple[float, float, int]:
        """Rows that binding a vertex builds, and those that are left of them, and the number of its bound neighbours."""
        own = [e for e in edges if vertex in e and set(e) - {vertex} <= bound]
        fan_out = sorted(sizes[e] / max(1, ends[e][e[0] == vertex]) for e in own)
        # Of the candidates along one edge, those are kept that the other edges lead to as well.
        choices = max(max(1, ends[e][e[1] == vertex]) for e in own)
        built = left = rows * fan_out[0]
        for others in fan_out[1:]:
            left *= min(1.0, others / choices)
        return built, left, len(own)

    def planned(start: tuple[int, int]) -> tuple[float, list[int]]:
        total = rows = float(sizes[start])
        bound, order = set(start), []
        free = {v for v, _ in pattern.vertices} - bound
        while free:
            near = {v for v in free if any(v in e and set(e) - {v} <= bound for e in edges)}
            cost = {v: grown(rows, v, bound) for v in near}
            vertex = min(near, key=lambda v: (cost[v][0], -cost[v][2], v))
            total, rows = total + cost[vertex][0], cost[vertex][1]
            order.append(vertex)
            bound.add(vertex)
            free.remove(vertex)
        return total, order

    plans = {start: planned(start) for start in edges}
    start = min(edges, key=lambda e: (plans[e][0], sizes[e]))
    return start, plans[start][1]


def star_order(stars: Sequence[Star], counts: Mapping[int, int]) -> list[Star]:
    """The order in which stars are joined.

    Start where matches are few and children many. Then stars that only check edges
    come before stars that add vertices, and stars that share nothing come last.
    """
    def weight(star: Star) -> float:
        return counts[star.star_id] / star.out_degree**2

    waiting, bound, order = list(stars), set(), []

    def rank(star: Star) -> tuple:
        shared = [child in bound for child in star.child_ids]
        if star.root in bound:
            group = 0 if all(shared) else 1
        elif any(shared):
            group = 2 if all(shared) else 3
        else:
            return 4, weight(star), star.star_id
        return group, star.star_id

    while waiting:
        star = min(waiting, key=rank)
        waiting.remove(star)
        order.append(star)
        bound |= {star.root, *star.child_ids}
    return order
