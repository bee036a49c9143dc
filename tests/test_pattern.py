import pytest

from tagweave import Pattern
from tagweave.plans.order import star_order


def test_stars_follow_vertex_order():
    pattern = Pattern.parse("1:1 2:2 3:4 4:3", "1>4 1>2 2>3 4>2 1>2")
    assert [(s.star_id, s.root, s.child_ids) for s in pattern.stars] == [
        (0, 1, (2, 4)),
        (1, 2, (3,)),
        (2, 4, (2,)),
    ]
    assert pattern.stars[0].required == {2: 1, 3: 1}
    assert pattern.columns == ["v1", "v2", "v3", "v4"]


def test_childless_vertices_have_no_star():
    assert [s.root for s in Pattern.parse("1:1 2:1 3:1", "2>3").stars] == [2]


@pytest.mark.parametrize(
    "vertices, edges, message",
    [
        ("", "", "at least one vertex"),
        ("1:1 1:2", "", "more than once"),
        ("1:1", "1>2", "undeclared"),
        ("1:3000000000", "", "32-bit tags"),
    ],
)
def test_invalid_patterns(vertices, edges, message):
    with pytest.raises(ValueError, match=message):
        Pattern.parse(vertices, edges)


def test_components():
    parts = Pattern.parse("1:1 2:2 3:1 4:2 5:5", "1>2 4>3").components()
    assert [p.columns for p in parts] == [["v1", "v2"], ["v3", "v4"], ["v5"]]
    assert [p.edges for p in parts] == [((1, 2),), ((4, 3),), ()]


def test_order_starts_selective_and_closes_before_it_adds():
    pattern = Pattern.parse("1:1 2:2 3:4 4:3", "1>4 1>2 2>3 4>2")
    order = star_order(pattern.stars, {0: 2, 1: 1, 2: 1})
    assert [s.star_id for s in order] == [0, 2, 1]


def test_order_leaves_unconnected_stars_to_the_end():
    pattern = Pattern.parse("1:1 2:2 3:3 4:4 5:2", "1>2 3>4 5>1 2>4")
    order = [s.root for s in star_order(pattern.stars, {0: 1, 1: 9, 2: 9, 3: 9})]
    assert order[0] == 1
    assert order.index(3) > order.index(2)
