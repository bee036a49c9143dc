import random
from math import perm

import pytest
from brute import brute_force
from conftest import rows

import tagweave as tw
from tagweave import Pattern, match, match_count
from tagweave.operators import joins

FIXTURES = {
    "golden": (
        "1:1 2:1 3:4 4:2 5:3 6:2",
        "1>3 3>1 1>4 4>1 1>5 5>1 2>4 2>5 5>2 2>6 4>3 4>5 5>4",
        ("1:1 2:2 3:4 4:3", "1>4 1>2 2>3 4>2"),
        [(1, 4, 3, 5), (2, 4, 3, 5)],
    ),
    "vertex order does not matter": (
        "1:1 2:1 3:1 4:1 5:1 11:2 12:2 20:3",
        "1>11 1>12 2>11 2>12 3>11 3>12 4>11 4>12 5>11 5>12 20>12",
        ("1:1 2:2 3:2 4:3", "1>2 1>3 4>3"),
        [(i, 11, 12, 20) for i in range(1, 6)],
    ),
    "self-loop and repeated edge in the data": (
        "1:1 2:1 3:1", "1>1 1>2 1>2 2>3", ("1:1 2:1", "1>2"), [(1, 2), (2, 3)],
    ),
    "isolated query vertex": (
        "1:1 2:2 3:3 4:3", "1>2 3>1", ("1:1 2:2 3:3", "1>2"), [(1, 2, 3), (1, 2, 4)],
    ),
    "id 0 with tag 0": (
        "10:1 11:2 0:0", "10>11 11>0", ("1:1 2:2 3:0", "1>2 2>3"), [(10, 11, 0)],
    ),
    "automorphisms are rows": (
        "1:1 2:1 3:1", "1>2 2>3 3>1", ("1:1 2:1 3:1", "1>2 2>3 3>1"), [(1, 2, 3), (2, 3, 1), (3, 1, 2)],
    ),
    "disconnected": (
        "1:1 2:2 3:1 4:2", "1>2 3>4 3>2", ("1:1 2:2 3:1 4:2", "1>2 3>4"), [(1, 2, 3, 4), (3, 4, 1, 2)],
    ),
    "self-loop in the query": (
        "1:1 2:1 3:2", "1>1 1>2 1>3 2>3", ("1:1 2:2", "1>1 1>2"), [(1, 3)],
    ),
    "only a self-loop": ("1:1 2:1", "1>1 1>2", ("1:1", "1>1"), [(1,)]),
    "one vertex": ("1:1 2:1 3:2", "1>3", ("5:1",), [(1,), (2,)]),
    "negative query ids": ("1:1 2:2", "1>2", ("-1:1 -2:2", "-1>-2"), [(1, 2)]),
    "no match": ("1:1 2:2", "1>2", ("1:2 2:1", "1>2"), []),
}


@pytest.mark.parametrize("split_at", [None, 1], ids=["plain", "all-hubs"])
@pytest.mark.parametrize("name", FIXTURES)
def test_fixture(make_graph, name, split_at):
    vertices, edges, query, expected = FIXTURES[name]
    graph = make_graph(vertices, edges, split_at)
    pattern = Pattern.parse(*query)
    result = match(graph, pattern)
    assert result.columns == pattern.columns
    assert rows(result) == expected
    assert match_count(graph, pattern) == len(expected)


def test_renumbered_and_reordered_queries_agree(make_graph):
    vertices, edges, _, expected = FIXTURES["vertex order does not matter"]
    graph = make_graph(vertices, edges)
    reordered = match(graph, Pattern.parse("7:3 3:2 2:2 9:1", "9>2 9>3 7>3"))
    assert rows(reordered.select("v9", "v2", "v3", "v7")) == expected


def test_an_isolated_data_vertex_changes_nothing(make_graph):
    vertices, edges, query, expected = FIXTURES["golden"]
    assert rows(match(make_graph(vertices + " 99:1", edges), Pattern.parse(*query))) == expected


def test_checkpoints(make_graph):
    graph = make_graph("1:1 2:2 3:3 4:4 5:5 6:6", "1>2 2>3 3>4 4>5 5>6")
    path = Pattern.parse("1:1 2:2 3:3 4:4 5:5 6:6", "1>2 2>3 3>4 4>5 5>6")
    cut = match(graph, path, checkpoint_every=2)
    assert "/step-matches-" in cut.inputFiles()[0]
    for every in (0, 1, 2, 4):
        assert rows(match(graph, path, checkpoint_every=every)) == [(1, 2, 3, 4, 5, 6)]


def random_graph(seed: int):
    """Twelve vertices of three tags; vertex 0 has an edge from and to nearly all."""
    rng = random.Random(seed)
    vertices = {v: rng.randint(1, 3) for v in range(12)}
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(30)}
    edges |= {(0, v) for v in range(11)} | {(v, 0) for v in range(2, 12)}
    return vertices, edges


def random_pattern(rng: random.Random) -> Pattern:
    n = rng.randint(2, 4)
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b or rng.random() < 0.2]
    chosen = rng.sample(pairs, rng.randint(1, min(4, len(pairs))))
    return Pattern(tuple((v, rng.randint(1, 3)) for v in range(n)), tuple(chosen))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(
    "split_at, broadcast_rows, spread_rows",
    [(None, 250_000, 5_000_000), (None, 250_000, 0), (None, -1, 0), (3, -1, 0), (3, 250_000, 0)],
    ids=["broadcast", "spread", "shuffled", "hubs", "hubs-and-broadcast"],
)
def test_random_patterns_against_brute_force(
    make_graph, monkeypatch, seed, split_at, broadcast_rows, spread_rows
):
    monkeypatch.setattr("tagweave.plans.match.BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr("tagweave.plans.match.SPREAD_ROWS", spread_rows)
    vertices, edges = random_graph(seed)
    graph = make_graph(
        " ".join(f"{v}:{t}" for v, t in vertices.items()), " ".join(f"{a}>{b}" for a, b in edges), split_at
    )
    assert bool(graph.hubs) == (split_at is not None)
    rng = random.Random(seed)
    for _ in range(7):
        pattern = random_pattern(rng)
        expected = brute_force(vertices, edges, pattern)
        result = match(graph, pattern, checkpoint_every=0)
        assert rows(result) == expected, pattern
        assert match_count(graph, pattern) == len(expected), pattern


COUNTED = {
    "path of distinct tags": ("1:1 2:2 3:3", "1>2 2>3"),
    "twins": ("1:1 2:2 3:2", "1>2 1>3"),
    "three twins and another": ("1:1 2:2 3:2 4:2 5:3", "1>2 1>3 1>4 1>5"),
    "twins pointing in": ("1:1 2:2 3:2", "2>1 3>1"),
    "leaves on a same-tag core": ("1:1 2:1 3:2 4:3", "1>2 1>3 2>4"),
    "leaves on a cycle": ("1:1 2:1 3:2 4:3", "1>2 2>1 1>3 2>4"),
    "leaf behind a leaf": ("1:1 2:1 3:2 4:3", "1>2 2>3 3>4"),
    "components without a common tag": ("1:1 2:2 3:3", "1>2"),
    "components with a common tag": ("1:1 2:2 3:1 4:2", "1>2 4>3"),
    "components with several common tags": ("1:1 2:1 3:1 4:1", "1>2 3>4"),
    "three components": ("1:1 2:1 3:1", ""),
}


@pytest.mark.parametrize("split_at", [None, 3], ids=["plain", "hubs"])
def test_counting_without_listing(make_graph, split_at):
    vertices, edges = random_graph(5)
    graph = make_graph(
        " ".join(f"{v}:{t}" for v, t in vertices.items()), " ".join(f"{a}>{b}" for a, b in edges), split_at
    )
    for name, query in COUNTED.items():
        pattern = Pattern.parse(*query)
        assert match_count(graph, pattern) == len(brute_force(vertices, edges, pattern)), name


def test_steps_one_by_one(make_graph):
    graph = make_graph("1:1 2:2 3:2 4:3 5:1", "1>2 1>3 2>4 3>4 5>3 1>4")
    pattern = Pattern.parse("1:1 2:2 3:3 4:1", "1>2 2>3 1>3 4>2")

    def of(edge):
        return joins.edge_slice(graph.tagged, pattern, edge)

    first = joins.first_star(pattern, pattern.stars[0], of)
    assert rows(first.select("v1", "v2", "v3")) == [(1, 2, 4), (1, 3, 4)]
    closed = joins.close(first, pattern, of((2, 3)))
    assert rows(closed.select("v1", "v2", "v3")) == [(1, 2, 4), (1, 3, 4)]
    with_root = joins.attach_root(closed, pattern, of((4, 2)))
    assert rows(with_root.select(*pattern.columns)) == [(1, 3, 4, 5)]
    extended = joins.extend(of((1, 2)).rows, pattern, of((2, 3)))
    assert rows(extended.select("v1", "v2", "v3")) == [(1, 2, 4), (1, 3, 4), (5, 3, 4)]


def test_every_match_is_injective(make_graph):
    vertices, edges = random_graph(3)
    graph = make_graph(" ".join(f"{v}:{t}" for v, t in vertices.items()), " ".join(f"{a}>{b}" for a, b in edges))
    found = match(graph, Pattern.parse("1:1 2:1 3:1", "1>2 2>3"))
    from tagweave.functions.expressions import match_line

    lines = found.select(match_line(found.columns).alias("value"))
    assert tw.non_injective_rows(lines).count() == 0
    assert lines.count() > 0


def test_non_injective_rows(spark):
    lines = spark.createDataFrame([("1,2,3",), ("1,2,1",), ("11,1",), ("5,5",)], "value string")
    assert rows(tw.non_injective_rows(lines)) == [("1,2,1",), ("5,5",)]


def test_a_hub_on_both_sides_is_split_on_both(spark, make_graph):
    """Vertex 0 has 60 in-edges of each of two tags: 3,600 pairs of one key."""
    vertices = "0:3 " + " ".join(f"{i}:1 {100 + i}:2" for i in range(1, 61))
    edges = " ".join(f"{i}>0 {100 + i}>0" for i in range(1, 61))
    graph, pattern = make_graph(vertices, edges, 4), Pattern.parse("1:1 2:3 3:2", "1>2 3>2")
    splits = graph.hubs.extend_splits((2, 3), False, "v2").first()
    left, right = splits["left_parts"], splits["right_parts"]
    assert left > 1 and right > 1
    assert 60 / left * 60 / right <= 64 * 4  # result rows in a cell
    of = lambda edge: joins.edge_slice(graph.tagged, pattern, edge, graph.hubs)
    found = joins.attach_root(of((1, 2)).rows, pattern, of((3, 2)))
    assert rows(found.select("v1", "v2", "v3")) == sorted((a, 0, 100 + b) for a in range(1, 61) for b in range(1, 61))


def test_children_with_a_large_product_are_split(make_graph, monkeypatch):
    """No vertex is a hub, but one root has 12 * 12 * 12 bindings."""
    vertices = "0:1 " + " ".join(f"{i}:2 {100 + i}:3 {200 + i}:4" for i in range(1, 13))
    edges = " ".join(f"0>{i} 0>{100 + i} 0>{200 + i}" for i in range(1, 13))
    graph, pattern = make_graph(vertices, edges), Pattern.parse("1:1 2:2 3:3 4:4", "1>2 1>3 1>4")
    assert not graph.hubs
    monkeypatch.setattr(joins, "SPLIT_ROWS", 16)
    of = lambda edge: joins.EdgeSlice(
        edge, joins.query_slice(graph.tagged, pattern, edge), widest=1728.0
    )
    matches = joins.first_star(pattern, pattern.stars[0], of)
    assert "left_share" in matches._jdf.queryExecution().toString()
    assert matches.count() == 1728 == matches.distinct().count()


def test_counts_beyond_64_bits(make_graph):
    graph = make_graph("0:1 " + " ".join(f"{i}:2" for i in range(1, 5001)), " ".join(f"0>{i}" for i in range(1, 5001)))
    pattern = Pattern.parse("1:1 " + " ".join(f"{i}:2" for i in range(2, 8)), " ".join(f"1>{i}" for i in range(2, 8)))
    assert match_count(graph, pattern) == perm(5000, 6) > 2**63
