"""Matching a whole pattern: every embedding as a row, or their number."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.expressions import keep_injective, named, quoted
from tagweave.graph import TaggedGraph
from tagweave.operators.joins import (
    Edge,
    EdgeSlice,
    Slices,
    attach_mixed,
    close,
    cross_components,
    edge_slice,
    first_star,
    intersect,
)
from tagweave.operators.skew import BROADCAST_ROWS, SPREAD_ROWS, kept, rows_up_to, skew_join, spread
from tagweave.operators.slices import edges_for, query_slice
from tagweave.operators.stars import star_roots, star_tag_pairs
from tagweave.pattern import Pattern, Star, column
from tagweave.plans.counting import embedding_count, times, wide
from tagweave.plans.order import PatternStats, pattern_stats, star_order, target_counts, vertex_order
from tagweave.plans.reduce import is_tree, reduced_slices, slices_from

CHECKPOINT_EVERY = 4
STRATEGIES = ("auto", "stars", "reduce", "intersect")


def match(
    graph: TaggedGraph, pattern: Pattern, checkpoint_every: int = CHECKPOINT_EVERY, strategy: str = "auto"
) -> DataFrame:
    """Every embedding of the pattern as one row, columns in pattern vertex order.

    Lineage is cut by a stored table after each ``checkpoint_every`` joined stars (or vertices); 0 turns that off. ``strategy`` is how
    connected parts are matched, with equal rows: ``stars`` joins star by star; ``reduce`` first reduces
    the slices of a tree pattern fully; ``intersect`` binds vertex by vertex from all bound neighbours at once; ``auto`` decides
    by counted sizes, see ``chosen_strategy``.

    Parts of a disconnected pattern are computed once each; those of several edges are stored before the product is formed.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    patterns = pattern.components()
    parts = [component_matches(graph, part, checkpoint_every, strategy) for part in patterns]
    matches = parts[0]
    if len(parts) > 1:
        matches = _product(patterns, parts, pattern)
    return matches.select(*[named(c) for c in pattern.columns])


def _product(patterns: list[Pattern], parts: list[DataFrame], pattern: Pattern) -> DataFrame:
    """All combinations of the parts' matches. Parts of more than one edge are stored and counted on the way; the others, plain scans, are counted in one job."""
    sizes: dict[int, int] = {}
    for i, part in enumerate(patterns):
        if len(part.edges) > 1:
            parts[i], sizes[i] = kept(parts[i], "part-matches")
    scans = [i for i in range(len(parts)) if i not in sizes]
    sizes |= zip(scans, rows_up_to([parts[i] for i in scans])) if scans else {}
    matches, n = parts[0], sizes[0]
    for i in range(1, len(parts)):
        matches = cross_components(matches, parts[i], pattern, n, sizes[i])
        n *= sizes[i]
    return matches


def component_matches(
    graph: TaggedGraph, pattern: Pattern, checkpoint_every: int = CHECKPOINT_EVERY, strategy: str = "auto"
) -> DataFrame:
    """Embeddings of a connected pattern, columns in no particular order."""
    steps = match_steps(graph, pattern, strategy)
    matches = None
    for done, step in enumerate(steps, start=1):
        matches = step(matches)
        if checkpoint_every and done % checkpoint_every == 0 and done < len(steps):
            matches, _ = kept(matches, "step-matches")
    return matches


def match_steps(graph: TaggedGraph, pattern: Pattern, strategy: str = "auto") -> list[Callable[[DataFrame | None], DataFrame]]:
    """The joins of a connected pattern, one after another: each makes larger partial matches of those before, the first from None."""
    if not pattern.edges:
        ((vertex, tag),) = pattern.vertices
        return [lambda _: graph.vertices.where(F.col("tag") == tag).select(F.col("id").alias(column(vertex)))]
    if strategy == "reduce" and is_tree(pattern):
        return _reduced_steps(graph, pattern)
    # A single edge needs no order and has nothing to prune.
    several = len(pattern.edges) > 1
    stats = pattern_stats(graph.edges_of(map(pattern.tag_pair, pattern.edges)), pattern) if several else None
    if strategy == "auto":
        strategy = chosen_strategy(pattern, stats)
        if strategy == "reduce":
            return _reduced_steps(graph, pattern)
    slices = pruned_slices(graph, pattern, stats)
    if strategy == "intersect":
        return _vertex_steps(graph, pattern, slices, stats)
    return _star_steps(pattern, slices, star_order(pattern.stars, stats.star_counts) if stats else pattern.stars)


def chosen_strategy(pattern: Pattern, stats: PatternStats | None) -> str:
    """``stars`` where its intermediate rows are few by the statistics; else ``reduce`` for a tree of several stars and ``intersect`` for a cycle."""
    if stats is None or max(*stats.bindings.values(), sum(stats.edges.values())) <= SPREAD_ROWS:
        return "stars"
    if not is_tree(pattern):
        return "intersect"
    return "reduce" if len(pattern.stars) > 1 else "stars"


def _star_steps(pattern: Pattern, slices: Slices, order: Sequence[Star]) -> list[Callable]:
    first, *others = order
    return [lambda _: first_star(pattern, first, slices)] + [
        lambda matches, star=star: attach_mixed(matches, pattern, star, slices) for star in others
    ]


def _reduced_steps(graph: TaggedGraph, pattern: Pattern) -> list[Callable]:
    reduced = reduced_slices(graph, pattern)
    counts = {s.star_id: min(reduced[(s.root, child)][1] for child in s.child_ids) for s in pattern.stars}
    return _star_steps(pattern, slices_from(graph, pattern, reduced), star_order(pattern.stars, counts))


def _vertex_steps(graph: TaggedGraph, pattern: Pattern, slices: Slices, stats: PatternStats | None) -> list[Callable]:
    """Starts with a slice, then binds vertex by vertex, in the order that builds the fewest rows by the statistics."""
    loops = {a: (a, b) for a, b in pattern.edges if a == b}
    edges = [e for e in pattern.edges if e[0] != e[1]]
    if not edges:
        return [lambda _: slices(pattern.edges[0]).rows]
    start, order = edges[0], []
    if stats is not None:
        pair_of = {e: pattern.tag_pair(e) for e in edges}
        targets = target_counts(graph.edges_of(pair_of.values()), pattern)
        ends = {e: (stats.sources[pair], targets.get(pair, 0)) for e, pair in pair_of.items()}
        start, order = vertex_order(pattern, {e: stats.edges[pair] for e, pair in pair_of.items()}, ends)

    def begin(_: None) -> DataFrame:
        matches = slices(start).rows
        matches = keep_injective(matches, column(start[1]), [column(v) for v in pattern.same_tag(start[1], [start[0]])])
        checks = [e for e in edges if set(e) == set(start) and e != start] + [loops[v] for v in start if v in loops]
        return reduce(lambda df, edge: close(df, pattern, slices(edge)), checks, matches)

    def bind(matches: DataFrame, vertex: int, own: list[Edge]) -> DataFrame:
        matches = intersect(matches, pattern, vertex, [slices(e) for e in own])
        return close(matches, pattern, slices(loops[vertex])) if vertex in loops else matches

    steps, bound = [begin], set(start)
    for vertex in order:
        own = [e for e in edges if vertex in e and set(e) - {vertex} <= bound]
        steps.append(lambda matches, vertex=vertex, own=own: bind(matches, vertex, own))
        bound.add(vertex)
    return steps


def pruned_slices(graph: TaggedGraph, pattern: Pattern, stats: PatternStats | None) -> Slices:
    """Slices of the query edges, restricted to vertices that pass selective star tests.

    Candidate roots few enough to be broadcast restrict every slice at both ends, before
    anything is shuffled. Others only restrict the slice a match starts from: any later
    join on the root does the same by itself.
    """
    if stats is None:
        return lambda edge: edge_slice(graph.edges_of([pattern.tag_pair(edge)]), pattern, edge, graph.hubs)
    selective = {s.root: s for s in pattern.stars if stats.selective(s)}
    roots = {
        vertex: star_roots(graph.edges_of(star_tag_pairs([star])), star).selectExpr(f"src AS {quoted(column(vertex))}")
        for vertex, star in selective.items()
    }

    few_roots = {v for v, star in selective.items() if stats.star_counts[star.star_id] <= BROADCAST_ROWS}

    # A small slice comes from few files, and broadcast joins would expand it in few tasks.
    expanding = max(stats.bindings.values()) > SPREAD_ROWS

    def restrict(rows: DataFrame, vertex: int) -> DataFrame:
        if vertex not in few_roots:
            return rows
        return rows.join(F.broadcast(roots[vertex]), column(vertex), "left_semi")

    widest = {s.root: stats.widest[s.star_id] for s in pattern.stars}

    def slice_of(edge: Edge) -> EdgeSlice:
        source, target = edge
        size = stats.edges[pattern.tag_pair(edge)]
        rows = query_slice(graph.edges_of([pattern.tag_pair(edge)]), pattern, edge)
        if target != source:
            rows = restrict(rows, target)
        # A broadcast slice meets sources that are pruned already. A hub's edges are split.
        few = rows if size <= BROADCAST_ROWS and not graph.hubs.touch(pattern.tag_pair(edge)) else None
        if few is None:
            rows = restrict(rows, source)
        seed = rows
        if source in selective and (few is None or selective[source].out_degree > 2):
            if source not in few_roots:
                key = column(source)
                splits = graph.hubs.end_splits([pattern.tag_pair(edge)], "src", key)
                seed = skew_join(rows, roots[source], [key], splits, "left_semi")
            elif few is not None:
                seed = restrict(rows, source)
        if few is not None and expanding:
            seed = spread(seed)
        return EdgeSlice(edge, rows, size, few, graph.hubs, seed, widest[source])

    return slice_of


def match_count(graph: TaggedGraph, pattern: Pattern) -> int:
    """Number of embeddings, of any size up to 38 digits; see ``match_count_row``."""
    n = match_count_row(graph, pattern).first()["n"]
    if n is None:
        raise OverflowError("the pattern has more than 10^38 embeddings")
    return int(n)


def match_count_row(graph: TaggedGraph, pattern: Pattern) -> DataFrame:
    """Number of embeddings as one row ``n``, a decimal, without listing them.

    End vertices with a tag of their own become counts per neighbour, see ``peeled``; the rest is summed vertex by vertex, over
    the ways in which vertices of one tag could coincide, see ``plans.counting``. Only patterns with very many vertices of one tag are listed.
    A number, or a sum on the way, beyond 38 digits stops the job or, without ANSI mode, gives null.
    """
    core, weights = peeled(graph, pattern)
    counted = embedding_count(graph, list(core.vertices), list(core.edges), weights)
    return listed_count(graph, core, weights) if counted is None else counted


def peeled(graph: TaggedGraph, pattern: Pattern) -> tuple[Pattern, dict[int, DataFrame]]:
    """The pattern without its countable end vertices, and the weights (``id, w``) of the vertices they hung on.

    An end vertex whose tag occurs nowhere else can take any of its neighbour's edges,
    so it is replaced by the number of these edges per neighbour; k such twins by
    n (n - 1) ... (n - k + 1). Repeated inwards, this counts a tree of distinct tags by
    aggregations alone.
    """
    vertices, edges = [v for v, _ in pattern.vertices], list(pattern.edges)
    weights: dict[int, DataFrame] = {}
    while (twins := _peelable(pattern, vertices, edges, weights)) is not None:
        leaves, edge = twins
        inner = edge[0] if edge[1] in leaves else edge[1]
        weight = _leaf_weight(graph, pattern, edge, inner, len(leaves), weights.pop(leaves[0], None))
        if inner in weights:
            weight = _multiply(weights[inner], weight)
        weights[inner] = weight
        vertices = [v for v in vertices if v not in leaves]
        edges = [e for e in edges if not set(e) & set(leaves)]
    return pattern.restricted_to(vertices), weights


def listed_count(graph: TaggedGraph, core: Pattern, weights: dict[int, DataFrame]) -> DataFrame:
    """The sum of weights over all matches of a pattern, listed."""
    matches = match(graph, core)
    if not weights:
        return matches.agg(wide(F.count("*")).alias("n"))
    # Pre-aggregated on the weighted vertices, so a vertex in many matches is one row.
    keys = [column(v) for v in weights]
    counted = matches.groupBy(*[named(k) for k in keys]).agg(wide(F.count("*")).alias("matches"))
    product = F.col("matches")
    for vertex, weight in weights.items():
        w = f"w{vertex}"
        counted = counted.join(
            weight.select(F.col("id").alias(column(vertex)), F.col("w").alias(w)), column(vertex)
        )
        product = times(product, named(w))
    return counted.agg(wide(F.coalesce(F.sum(product), F.lit(0))).alias("n"))


def _peelable(
    pattern: Pattern, vertices: list[int], edges: list[Edge], weights: dict[int, DataFrame]
) -> tuple[list[int], Edge] | None:
    """End vertices with the same tag, neighbour and direction, and one of their edges."""
    degree = Counter(v for edge in edges for v in edge)
    tag_uses = Counter(pattern.tag_of.values())
    groups: dict[tuple, list[tuple[int, Edge]]] = {}
    for a, b in edges:
        for leaf, inner in ((b, a), (a, b)):
            if degree[leaf] == 1:
                groups.setdefault((inner, leaf == b, pattern.tag_of[leaf]), []).append((leaf, (a, b)))
    for (_, _, tag), members in groups.items():
        leaves = [leaf for leaf, _ in members]
        alone = tag_uses[tag] == len(leaves)
        if alone and (len(leaves) == 1 or not weights.keys() & set(leaves)):
            return leaves, members[0][1]
    return None


def _leaf_weight(
    graph: TaggedGraph, pattern: Pattern, edge: Edge, inner: int, k: int, leaf_weight: DataFrame | None
) -> DataFrame:
    """(id, w): for each data vertex of ``inner``, the ways to place k twin leaves."""
    pair = pattern.tag_pair(edge)
    inner_end, leaf_end = ("src", "dst") if inner == edge[0] else ("dst", "src")
    rows = edges_for(graph.tagged, *pair)
    if leaf_weight is not None:
        splits = graph.hubs.end_splits([pair], leaf_end, leaf_end)
        rows = skew_join(rows, leaf_weight.withColumnRenamed("id", leaf_end), [leaf_end], splits)
        return rows.groupBy(F.col(inner_end).alias("id")).agg(wide(F.sum("w")).alias("w"))
    counts = rows.groupBy(F.col(inner_end).alias("id")).agg(F.count("*").alias("n"))
    ways = reduce(lambda w, i: times(w, wide(F.col("n") - i)), range(1, k), wide(F.col("n")))
    return counts.where(F.col("n") >= k).select("id", ways.alias("w"))


def _multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.withColumnRenamed("w", "w_other"), "id").select(
        "id", times(F.col("w"), F.col("w_other")).alias("w")
    )
