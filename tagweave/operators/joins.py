"""Join steps from star to star: partial matches are wide rows ``v<id>, ...``.

Every step is an equi-join on a vertex both sides share; that no data vertex is used
twice is part of the join condition, as soon as both columns exist.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.expressions import all_different, keep_injective, named
from tagweave.operators.hubs import Hubs
from tagweave.operators.skew import RESULT_FACTOR, SPLIT_ROWS, few_or_stored, grid_product, skew_join, splits_from
from tagweave.operators.slices import query_slice
from tagweave.pattern import Pattern, Star, column

Edge = tuple[int, int]


@dataclass(frozen=True)
class EdgeSlice:
    """Candidate bindings of one query edge, in match columns.

    ``rows`` are what a join shuffles. ``few`` is set for a slice that was counted and is
    within the broadcast bound: it is broadcast instead, and its join has no hot key. Any
    other join is split by ``hubs``. ``seed`` are the rows to start from, where these are
    pruned further than it would pay for in a later join. ``widest`` is the largest number of bindings of
    the edge's whole star at one root, where it has been counted.
    """

    edge: Edge
    rows: DataFrame
    size: int = 0
    few: DataFrame | None = None
    hubs: Hubs | None = None
    seed: DataFrame | None = None
    widest: float | None = None

    @property
    def bindings(self) -> DataFrame:
        return self.rows if self.few is None else F.broadcast(self.few)

    @property
    def splitting(self) -> Hubs | None:
        return self.hubs if self.hubs and self.few is None else None


Slices = Callable[[Edge], EdgeSlice]


def edge_slice(tagged: DataFrame, pattern: Pattern, edge: Edge, hubs: Hubs | None = None) -> EdgeSlice:
    """The uncounted, unpruned slice of a query edge."""
    return EdgeSlice(edge, query_slice(tagged, pattern, edge), hubs=hubs)


def bound_vertices(matches: DataFrame, pattern: Pattern) -> list[int]:
    present = set(matches.columns)
    return [v for v, _ in pattern.vertices if column(v) in present]


def _must_differ(pattern: Pattern, new: int, bound: Sequence[int]) -> list[str]:
    return [column(v) for v in pattern.same_tag(new, bound)]


def first_star(pattern: Pattern, star: Star, slices: Slices) -> DataFrame:
    """All bindings of a star's root and children, children pairwise distinct.

    Roots with very many bindings, by the product of their children's candidates, are split.
    """
    root = column(star.root)
    # A self-loop only filters the root, so it goes first.
    children = sorted(star.child_ids, key=lambda child: child != star.root)
    bindings_of = [slices((star.root, child)) for child in children]
    large = _many_bindings(bindings_of, root) if len(children) > 1 else None
    matches = None
    for i, (child, bindings) in enumerate(zip(children, bindings_of)):
        if matches is None:
            bound, matches = [star.root], bindings.rows if bindings.seed is None else bindings.seed
        else:
            splits = None
            if bindings.few is None:
                joined = " * ".join(f"double(n{j})" for j in range(i))
                splits = splits_from(large, [root], joined, f"n{i}", bindings.hubs.split_at if bindings.hubs is not None else SPLIT_ROWS)
            bound = bound_vertices(matches, pattern)
            matches = skew_join(matches, bindings.bindings, [root], splits)
        matches = keep_injective(matches, column(child), _must_differ(pattern, child, bound))
    return matches


def _many_bindings(bindings_of: Sequence[EdgeSlice], root: str) -> DataFrame | None:
    """Roots one task should not bind alone: (root, n0, n1, ...), candidates per child."""
    hubs, widest = bindings_of[0].hubs, bindings_of[0].widest
    split_at = hubs.split_at if hubs is not None else SPLIT_ROWS
    if all(b.few is not None for b in bindings_of[1:]) or (not hubs and widest is None):
        return None
    if widest is not None and widest <= RESULT_FACTOR * split_at and not hubs:
        return None
    counts = None
    for i, bindings in enumerate(bindings_of):
        own = bindings.rows.groupBy(named(root)).agg(F.count("*").alias(f"n{i}"))
        counts = own if counts is None else counts.join(own, root)
    names = [f"n{i}" for i in range(len(bindings_of))]
    product = " * ".join(f"double({n})" for n in names)
    return few_or_stored(counts.where(f"{product} > {RESULT_FACTOR * split_at} OR greatest({', '.join(names)}) > {split_at}"))


def extend(matches: DataFrame, pattern: Pattern, bindings: EdgeSlice) -> DataFrame:
    """Root bound, child free: add the child's column."""
    root, child = bindings.edge
    return _attach(matches, pattern, bindings, bound=root, new=child)


def attach_root(matches: DataFrame, pattern: Pattern, bindings: EdgeSlice) -> DataFrame:
    """Child bound, root free: add the column of the root that points at the child."""
    root, child = bindings.edge
    return _attach(matches, pattern, bindings, bound=child, new=root)


def _attach(matches: DataFrame, pattern: Pattern, bindings: EdgeSlice, bound: int, new: int) -> DataFrame:
    key = column(bound)
    hubs = bindings.splitting
    splits = hubs and hubs.extend_splits(pattern.tag_pair(bindings.edge), bound == bindings.edge[0], key)
    others = bound_vertices(matches, pattern)
    joined = skew_join(matches, bindings.bindings, [key], splits)
    return keep_injective(joined, column(new), _must_differ(pattern, new, others))


def close(matches: DataFrame, pattern: Pattern, bindings: EdgeSlice) -> DataFrame:
    """Both ends bound: keep the matches whose edge exists; no column is added.

    Rows are spread by the pair of ends. Only an edge between two hubs can be a hot
    key; its matches are dealt out and that one edge is copied.
    """
    keys = list(dict.fromkeys(column(v) for v in bindings.edge))
    hubs = bindings.splitting
    tables = hubs.close_splits(pattern.tag_pair(bindings.edge), keys) if hubs and len(keys) == 2 else None
    if tables is None:
        return matches.join(bindings.bindings, keys, "left_semi")
    return _split_semi(matches, bindings.rows, keys, [([key], table) for key, table in zip(keys, tables)])


def _split_semi(
    matches: DataFrame, rows: DataFrame, keys: Sequence[str], tables: Sequence[tuple[list[str], DataFrame]]
) -> DataFrame:
    """Semi join on ``keys`` whose hot keys are split by the least of the ``parts`` that the tables give for some of the keys."""

    def with_parts(df: DataFrame) -> DataFrame:
        for i, (on, table) in enumerate(tables):
            df = df.join(table.withColumnRenamed("parts", f"parts{i}"), on, "left")
        return df.withColumn("parts", F.least(*[F.coalesce(F.col(f"parts{i}"), F.lit(1)) for i in range(len(tables))]))

    columns = [named(c) for c in matches.columns]
    dealt = with_parts(matches).select(*columns, F.pmod(F.xxhash64(*columns), "parts").alias("share"))
    copied = with_parts(rows).select(
        *[named(k) for k in keys],
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("share"),
    )
    return dealt.join(copied, [*keys, "share"], "left_semi").drop("share")


def attach_mixed(matches: DataFrame, pattern: Pattern, star: Star, slices: Slices) -> DataFrame:
    """Join one star that shares a vertex with the matches, bound children first.

    A free root is found through the bound child with the smallest slice. Edges with
    both ends bound are closed before any free child is added.
    """
    bound = set(bound_vertices(matches, pattern))
    todo = sorted((slices((star.root, child)) for child in star.child_ids), key=lambda s: s.size)
    if star.root not in bound:
        via = next(s for s in todo if s.edge[1] in bound)
        matches = attach_root(matches, pattern, via)
        bound.add(star.root)
        todo.remove(via)
    for bindings in [s for s in todo if s.edge[1] in bound]:
        matches = close(matches, pattern, bindings)
    for bindings in [s for s in todo if s.edge[1] not in bound]:
        matches = extend(matches, pattern, bindings)
    return matches


def cross_components(
    left: DataFrame, right: DataFrame, pattern: Pattern, left_rows: int | None = None, right_rows: int | None = None
) -> DataFrame:
    """Matches of two parts that share no vertex: every pair with all vertices distinct.

    The numbers of rows, where they are known, decide which side is copied.
    """
    bound = bound_vertices(left, pattern)
    differ = [
        all_different(column(new), _must_differ(pattern, new, bound))
        for new in bound_vertices(right, pattern)
    ]
    return grid_product(left, right, " AND ".join(filter(None, differ)), left_rows, right_rows)


def intersect(matches: DataFrame, pattern: Pattern, vertex: int, bindings: Sequence[EdgeSlice]) -> DataFrame:
    """Bind a free vertex from all its bound neighbours at once.

    ``bindings`` are the slices of the edges between the vertex and bound vertices. Each match is extended along the one
    of these edges that has the fewest candidates for it, and kept if all others have the candidate, too. So a match makes at most as many rows as its
    least neighbour has edges, and a hub is expanded only where all neighbours are hubs. Matches without a candidate on some edge are dropped first.

    The slices are one table, keyed by the number of the edge and its bound end, so the matches are joined once and not once for each choice.
    """
    if len(bindings) == 1:
        extending = extend if bindings[0].edge[1] == vertex else attach_root
        return extending(matches, pattern, bindings[0])
    columns, new, n = matches.columns, column(vertex), len(bindings)
    ends = [b.edge[1] if b.edge[0] == vertex else b.edge[0] for b in bindings]
    hubs = next((b.hubs for b in bindings if b.hubs), None)
    candidates = reduce(
        DataFrame.union,
        [b.rows.select(F.lit(i).alias("which"), named(column(end)).alias("end"), named(new)) for i, (b, end) in enumerate(zip(bindings, ends))],
    )
    degree_of = candidates.groupBy("which", "end").agg(F.count("*").alias("degree"))
    for i, end in enumerate(ends):
        key = column(end)
        degrees = degree_of.where(F.col("which") == i).select(F.col("end").alias(key), F.col("degree").alias(f"degree{i}"))
        matches = skew_join(matches, degrees, [key], hubs and hubs.vertex_splits(pattern.tag_of[end], key))
    degrees = [F.col(f"degree{i}") for i in range(n)]
    fewest = (F.array_position(F.array(*degrees), F.least(*degrees)) - 1).cast("int")
    matches = matches.select(*[named(c) for c in columns], fewest.alias("chosen"))

    def toward(step: int) -> DataFrame:
        """The matches with the edge that is ``step`` after the chosen one, and its bound end."""
        which = F.pmod(F.col("chosen") + step, F.lit(n))
        end = F.get(F.array(*[named(column(end)) for end in ends]), which)
        return matches.withColumns({"which": which, "end": end})

    matches = skew_join(toward(0), candidates, ["which", "end"], hubs and _by_edge(
        [hubs.extend_splits(pattern.tag_pair(b.edge), end == b.edge[0], "end") for b, end in zip(bindings, ends)]
    )).drop("which", "end")
    matches = keep_injective(matches, new, _must_differ(pattern, vertex, bound_vertices(matches.select(*map(named, columns)), pattern)))
    keys = ["which", "end", new]
    own = hubs and hubs.vertex_splits(pattern.tag_of[vertex], new)
    others = own and _by_edge([hubs.vertex_splits(pattern.tag_of[end], "end") for end in ends])
    for step in range(1, n):
        if others is None:
            matches = toward(step).join(candidates, keys, "left_semi")
        else:
            tables = [(["which", "end"], _parts(others)), ([new], _parts(own))]
            matches = _split_semi(toward(step), candidates, keys, tables)
        matches = matches.drop("which", "end")
    return matches.drop("chosen")


def _by_edge(splits: Sequence[DataFrame | None]) -> DataFrame | None:
    """Splits of several edges as one table, by the number of the edge."""
    known = [table.withColumn("which", F.lit(i)) for i, table in enumerate(splits) if table is not None]
    return reduce(DataFrame.unionByName, known) if known else None


def _parts(splits: DataFrame) -> DataFrame:
    return splits.drop("right_parts").withColumnRenamed("left_parts", "parts")
