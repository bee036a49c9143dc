"""Ways to match a connected pattern: equal rows, and bounds on what is built on the way."""

import random

import pytest
from brute import brute_force
from conftest import rows
from test_match import random_graph, random_pattern

from tagweave import Pattern, match, match_count
from tagweave.operators import joins
from tagweave.plans.counting import embedding_terms
from tagweave.plans import match as match_module
from tagweave.plans.match import chosen_strategy, match_steps
from tagweave.plans.order import PatternStats, vertex_order
from tagweave.plans.reduce import is_tree, reduced_slices


def graph_of(make_graph, vertices, edges, split_at=None):
    return make_graph(" ".join(f"{v}:{t}" for v, t in vertices.items()), " ".join(f"{a}>{b}" for a, b in edges), split_at)


SHAPES = {
    "path": ("1:1 2:2 3:1 4:3", "1>2 2>3 3>4"),
    "path of mixed directions": ("1:1 2:2 3:3 4:2", "1>2 3>2 3>4"),
    "star with twins": ("1:1 2:2 3:2 4:3", "1>2 1>3 4>1"),
    "both directions": ("1:1 2:2 3:3", "1>2 2>1 2>3"),
    "loops on a path": ("1:1 2:2 3:1", "1>1 1>2 2>3"),
    "triangle": ("1:1 2:2 3:3", "1>2 2>3 1>3"),
    "triangle of one tag": ("1:1 2:1 3:1", "1>2 2>3 3>1"),
    "cycle of four": ("1:1 2:2 3:1 4:2", "1>2 2>3 3>4 4>1"),
    "clique of four": ("1:1 2:2 3:3 4:1", "1>2 1>3 1>4 2>3 2>4 3>4"),
    "two triangles on an edge": ("1:1 2:2 3:3 4:3", "1>2 2>3 1>3 2>4 1>4"),
    "cycle with loop and tail": ("1:1 2:2 3:3 4:2", "1>2 2>3 3>1 1>1 3>4"),
}


@pytest.mark.parametrize("split_at", [None, 3], ids=["plain", "hubs"])
@pytest.mark.parametrize("strategy", ["stars", "reduce", "intersect"])
def test_strategies_agree_with_brute_force(make_graph, strategy, split_at):
    vertices, edges = random_graph(4)
    graph = graph_of(make_graph, vertices, edges, split_at)
    trees = ["path", "path of mixed directions", "star with twins", "both directions", "loops on a path"]
    for name, query in SHAPES.items():
        if (strategy == "reduce") > (name in trees) or (split_at and name not in ("both directions", "loops on a path", "cycle of four", "clique of four")):
            continue
        pattern = Pattern.parse(*query)
        expected = brute_force(vertices, edges, pattern)
        assert rows(match(graph, pattern, 0, strategy)) == expected, name
        if strategy == "stars":
            assert match_count(graph, pattern) == len(expected), name


def test_random_patterns(make_graph):
    vertices, edges = random_graph(6)
    plain, hubs = graph_of(make_graph, vertices, edges), graph_of(make_graph, vertices, edges, 3)
    rng = random.Random(8)
    for i in range(8):
        pattern = random_pattern(rng)
        expected = brute_force(vertices, edges, pattern)
        strategy = ("reduce", "intersect")[i % 2]
        assert rows(match((plain, hubs)[i % 3 == 0], pattern, i % 3, strategy)) == expected, pattern


def layered(make_graph, split_at=None):
    """Tags 1 to 5 in layers; of 40 vertices in each only few edges lead on to the last layer."""
    rng = random.Random(1)
    vertices = {100 * layer + i: layer for layer in range(1, 6) for i in range(40)}
    edges = {(100 * a + rng.randrange(40), 100 * (a + 1) + rng.randrange(40)) for a in range(1, 4) for _ in range(160)}
    edges |= {(400 + i, 500 + i) for i in range(3)}
    return graph_of(make_graph, vertices, edges, split_at), edges


@pytest.mark.parametrize("split_at", [None, 5])
def test_reduced_slices_build_no_match_in_vain(make_graph, split_at):
    graph, edges = layered(make_graph, split_at)
    pattern = Pattern.parse("1:1 2:2 3:3 4:4 5:5", "1>2 2>3 3>4 4>5")
    total = match(graph, pattern, 0, "stars")
    expected = rows(total)
    slices = reduced_slices(graph, pattern)
    for (a, b), (table, n) in slices.items():
        used = {(row[f"v{a}"], row[f"v{b}"]) for row in total.collect()}
        assert {tuple(row) for row in table.select(f"v{a}", f"v{b}").collect()} == used and n == len(used)
    built, partial = [], None
    for step in match_steps(graph, pattern, "reduce"):
        partial = step(partial)
        built.append(partial.count())
        # Each partial match is part of a whole one.
        assert partial.distinct().count() == total.select(*partial.columns).distinct().count() == built[-1]
    assert max(built) <= len(expected) == built[-1]
    plain = None
    unreduced = []
    for step in match_steps(graph, pattern, "stars"):
        plain = step(plain)
        unreduced.append(plain.count())
    assert sum(unreduced) > sum(built)


def test_a_cycle_is_not_reduced(make_graph):
    graph, _ = layered(make_graph)
    pattern = Pattern.parse("1:1 2:2 3:3", "1>2 2>3 1>3")
    assert not is_tree(pattern) and is_tree(Pattern.parse("1:1 2:2", "1>2 2>1 1>1"))
    with pytest.raises(ValueError):
        reduced_slices(graph, pattern)


@pytest.mark.parametrize("split_at", [None, 20])
def test_the_intersection_step_stays_within_the_worst_case_bound(make_graph, monkeypatch, split_at):
    """Two hubs of 150 edges each share one neighbour: joining all paths first would build 150 * 150 of them."""
    n = 150
    vertices = {0: 1, 1: 3, **{10 + i: 2 for i in range(n)}, **{1000 + i: 1 for i in range(n)}, **{2000 + i: 3 for i in range(n)}}
    hub = 10
    edges = {(0, 10 + i) for i in range(n)} | {(10 + i, 1) for i in range(n)} | {(0, 1)}
    edges |= {(1000 + i, hub) for i in range(n)} | {(hub, 2000 + i) for i in range(n)}
    edges |= {(1000 + i, 2000 + (7 * i) % n) for i in range(0, n, 10)}
    graph = graph_of(make_graph, vertices, edges, split_at)
    pattern = Pattern.parse("1:1 2:2 3:3", "1>2 2>3 1>3")
    expected = sorted(
        (a, b, c) for a, b in edges for b2, c in edges if b == b2 and (a, c) in edges and (vertices[a], vertices[b], vertices[c]) == (1, 2, 3)
    )
    built = []
    plain_join = joins.skew_join

    def counted(left, right, keys, *rest, **named):
        joined = plain_join(left, right, keys, *rest, **named)
        if "v1" in joined.columns and len(set(pattern.columns) & set(joined.columns)) == 3:
            built.append(joined.count())
        return joined

    monkeypatch.setattr(joins, "skew_join", counted)
    assert rows(match(graph, pattern, 0, "intersect")) == expected
    listed = len(edges) ** 1.5
    assert built and max(built) <= listed and max(built) < n * n
    built.clear()
    match(graph, pattern, 0, "stars")


def test_the_strategy_follows_the_counted_sizes():
    tree, cycle = Pattern.parse("1:1 2:2 3:3", "1>2 2>3"), Pattern.parse("1:1 2:2 3:3", "1>2 2>3 1>3")
    star = Pattern.parse("1:1 2:2 3:3", "1>2 1>3")

    def stats(bindings):
        return PatternStats({0: 5}, {0: bindings}, {0: 1.0}, {(1, 2): 10}, {(1, 2): 5})

    assert [chosen_strategy(p, stats(100.0)) for p in (tree, cycle, star)] == ["stars"] * 3
    assert [chosen_strategy(p, stats(1e9)) for p in (tree, cycle, star)] == ["reduce", "intersect", "stars"]
    with pytest.raises(ValueError):
        match(None, tree, strategy="other")


def test_terms_of_merged_patterns():
    """Three vertices of one tag: five ways to merge them, with factors 1, -1 (three times) and 2."""
    parts, terms = embedding_terms([(1, 7), (2, 7), (3, 7)], [], set())
    assert len(parts) == 1 and sorted((factor, uses[0]) for factor, uses in terms) == [(-3, 2), (1, 3), (2, 1)]
    # Adjacent vertices are never merged.
    assert len(embedding_terms([(1, 7), (2, 7)], [(1, 2)], set())[1]) == 1


PARTS = {
    "three edges of one pair": ("1:1 2:2 3:1 4:2 5:1 6:2", "1>2 3>4 5>6"),
    "three parts": ("1:1 2:2 3:2 4:1 5:1", "1>2 4>3"),
    "path and vertices": ("1:1 2:2 3:1 4:1 5:2", "1>2 2>3"),
    "cycle and an edge": ("1:1 2:2 3:3 4:1 5:2", "1>2 2>3 1>3 4>5"),
    "four of one tag": ("1:1 2:1 3:1 4:1", "1>2 3>2 3>4"),
}


@pytest.mark.parametrize("split_at", [None, 3], ids=["plain", "hubs"])
def test_counts_of_several_parts_without_products(make_graph, split_at):
    rng = random.Random(2)
    vertices = {v: rng.randint(1, 3) for v in range(9)}
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(28)}
    graph = graph_of(make_graph, vertices, edges, split_at)
    for name, query in PARTS.items():
        pattern = Pattern.parse(*query)
        assert match_count(graph, pattern) == len(brute_force(vertices, edges, pattern)), name


def test_counts_have_no_product_in_the_plan(make_graph):
    from tagweave.plans.match import match_count_row

    graph, _ = layered(make_graph)
    text = match_count_row(graph, Pattern.parse(*PARTS["three edges of one pair"]))._jdf.queryExecution().toString()
    assert "cell_row" not in text and "CartesianProduct" not in text


def test_very_many_vertices_of_one_tag_are_listed(make_graph):
    vertices = {v: 1 for v in range(7)}
    edges = {(a, a + 1) for a in range(6)}
    graph = graph_of(make_graph, vertices, edges)
    pattern = Pattern.parse(" ".join(f"{i}:1" for i in range(6)), "0>1 2>3 4>5")
    assert match_count(graph, pattern) == len(brute_force(vertices, edges, pattern))


def test_the_intersection_starts_where_no_product_is_built():
    """Few suppliers and many customers share a nation: the smallest slice, supplier to nation, is the worst start."""
    cycle = Pattern.parse("1:12 2:21 3:40 4:50", "1>2 2>3 3>4 1>4")
    sizes = {(1, 2): 5_000, (2, 3): 120_000, (3, 4): 1_000, (1, 4): 3_000}
    ends = {(1, 2): (2_500, 5_000), (2, 3): (30_000, 1_000), (3, 4): (1_000, 25), (1, 4): (3_000, 25)}
    for copies in (1, 10, 1000):
        grown = {e: n * copies for e, n in sizes.items()}
        grown_ends = {e: (a * copies, b * copies if b > 25 else b) for e, (a, b) in ends.items()}
        start, order = vertex_order(cycle, grown, grown_ends)
        assert start != (3, 4) and sorted((*start, *order)) == [1, 2, 3, 4]
        bound = set(start)
        for vertex in order:  # customers and suppliers are never paired by their nation alone
            assert not (bound == {3, 4} and vertex == 1) and not (bound == {1, 4} and vertex == 3)
            bound.add(vertex)


def test_the_rows_of_a_cycle_grow_with_the_graph(make_graph, monkeypatch):
    built = {}
    plain = match_module.intersect
    for copies in (2, 4):
        vertices, edges = {1: 50}, set()
        for i in range(30 * copies):
            customer, order, supplier = 1000 + i, 2000 + i, 3000 + i
            vertices |= {customer: 12, order: 21, supplier: 40}
            edges |= {(customer, order), (order, supplier), (customer, 1), (supplier, 1)}
            edges |= {(order, 3000 + (i + 1) % (30 * copies))} if i % 2 else set()
        graph = graph_of(make_graph, vertices, edges)
        counted = []

        def stepped(matches, *rest, counted=counted):
            found = plain(matches, *rest)
            counted.append(found.count())
            return found

        monkeypatch.setattr(match_module, "intersect", stepped)
        found = rows(match(graph, Pattern.parse("1:12 2:21 3:40 4:50", "1>2 2>3 3>4 1>4"), 0, "intersect"))
        assert len(found) == 45 * copies
        built[copies] = max(counted)
    assert built[4] <= 2 * built[2]
