import pytest
from conftest import rows

from tagweave import Pattern
from tagweave.operators import stars
from tagweave.plans.order import pattern_stats

VERTICES = "1:1 2:1 3:4 4:2 5:3 6:2"
EDGES = "1>3 3>1 1>4 4>1 1>5 5>1 2>4 2>5 5>2 2>6 4>3 4>5 5>4"
PATTERN = Pattern.parse("1:1 2:2 3:4 4:3", "1>4 1>2 2>3 4>2")


@pytest.fixture(scope="module")
def graph(make_graph):
    return make_graph(VERTICES, EDGES)


def test_neighbour_tag_counts(graph):
    assert rows(stars.neighbour_tag_counts(graph.tagged)) == [
        (1, 1, 2, 1), (1, 1, 3, 1), (1, 1, 4, 1), (2, 1, 2, 2), (2, 1, 3, 1), (3, 4, 1, 1),
        (4, 2, 1, 1), (4, 2, 3, 1), (4, 2, 4, 1), (5, 3, 1, 2), (5, 3, 2, 1),
    ]


def test_candidates_and_matches(graph):
    assert rows(stars.star_candidates(graph.tagged, PATTERN.stars)) == [(0, 1), (0, 2), (1, 4), (2, 5)]
    assert rows(stars.star_match_counts(graph.tagged, PATTERN.stars)) == [(0, 2), (1, 1), (2, 1)]
    assert rows(stars.star_matches(graph.tagged, PATTERN.stars)) == [
        (0, 1, 2, 4), (0, 1, 3, 5), (0, 2, 2, 4), (0, 2, 2, 6), (0, 2, 3, 5), (1, 4, 4, 3), (2, 5, 2, 4),
    ]


def test_hubs_do_not_change_star_matches(make_graph, graph):
    split = make_graph(VERTICES, EDGES, split_at=1)
    assert split.hubs
    for star in PATTERN.stars:
        assert rows(stars.prune_by_star(split.tagged, star, split.hubs)) == rows(
            stars.prune_by_star(graph.tagged, star)
        )
    assert rows(stars.star_matches(split.tagged, PATTERN.stars, split.hubs)) == rows(
        stars.star_matches(graph.tagged, PATTERN.stars)
    )


def test_counts_keep_zero(graph):
    none = Pattern.parse("1:4 2:4", "1>2").stars
    assert rows(stars.star_match_counts(graph.tagged, none)) == [(0, 0)]


def test_selectivity(spark, graph):
    table = stars.star_table(spark, PATTERN.stars)
    counts = stars.star_match_counts(graph.tagged, PATTERN.stars)
    assert rows(stars.star_selectivity(table, counts)) == [
        (0, 2, 2, 0.5, 1), (1, 1, 1, 1.0, 2), (2, 1, 1, 1.0, 3),
    ]
    assert rows(stars.star_child_tags(table)) == [(0, 2, 1), (0, 3, 1), (1, 4, 1), (2, 2, 1)]


def test_prune_by_star(graph):
    star = Pattern.parse("1:1 2:2 3:2", "1>2 1>3").stars[0]
    assert rows(stars.prune_by_star(graph.tagged, star)) == [(2, 4, 1, 2), (2, 6, 1, 2)]


def test_stars_of_a_data_graph(graph):
    found = {(r.root, r.block): [tuple(c) for c in r.children] for r in stars.stars(graph.tagged).collect()}
    assert found[(1, 0)] == [(3, 4), (4, 2), (5, 3)]
    assert len(found) == 5


def test_wide_stars_come_in_blocks(make_graph):
    graph = make_graph("0:1 " + " ".join(f"{i}:2" for i in range(-5, 20) if i), "1>2 " + " ".join(f"0>{i}" for i in range(-5, 20) if i))
    found = [(r.root, r.block, [c.id for c in r.children]) for r in stars.stars(graph.tagged, block=8).collect()]
    assert sorted(found) == [
        (0, -8, [-5, -4, -3, -2, -1]),
        (0, 0, list(range(1, 8))),
        (0, 8, list(range(8, 16))),
        (0, 16, list(range(16, 20))),
        (1, 0, [2]),
    ]
    # The same rule whatever the number of children.
    assert [len(c) for _, _, c in found if len(c)] and stars.stars(graph.tagged).count() == 3


def test_pattern_stats_in_one_row(graph):
    stats = pattern_stats(graph.tagged, PATTERN)
    assert stats.star_counts == {0: 2, 1: 1, 2: 1}
    assert stats.bindings == {0: 3.0, 1: 1.0, 2: 1.0}
    assert stats.widest == {0: 2.0, 1: 1.0, 2: 1.0}
    assert stats.edges == {(1, 2): 3, (1, 3): 2, (2, 4): 1, (3, 2): 1}
    assert stats.sources == {(1, 2): 2, (1, 3): 2, (2, 4): 1, (3, 2): 1}


@pytest.mark.parametrize("block", [1, 2, 65_536])
def test_members_in_long_form(graph, block):
    found = rows(stars.star_members(graph.tagged, block).where("root in (1, 2)"))
    assert found == [(1, 1, 0, 3, 4), (1, 1, 1, 4, 2), (1, 1, 2, 5, 3), (2, 1, 0, 4, 2), (2, 1, 1, 5, 3), (2, 1, 2, 6, 2)]


def test_members_are_ranked_in_one_shuffle_but_for_hubs(spark, make_graph):
    vertices = "0:1 " + " ".join(f"{i}:{2 + i % 2}" for i in range(-5, 20) if i)
    edges = " ".join(f"0>{i}" for i in range(-5, 20) if i) + " 1>2 1>-3 2>5"
    plain, hubs = make_graph(vertices, edges), make_graph(vertices, edges, 4)
    expected = rows(stars.star_members(plain.tagged, 8))
    tagged = spark.createDataFrame(plain.tagged.collect(), plain.tagged.schema)
    whole = stars.star_members(tagged, 8, plain.hubs)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    parted = stars.star_members(hubs.tagged, 8, hubs.hubs)
    assert hubs.hubs.sources("src").count() == 1
    assert rows(whole) == rows(parted) == expected and len(expected) == 27
    assert whole.dtypes == parted.dtypes == stars.star_members(plain.tagged, 8).dtypes
