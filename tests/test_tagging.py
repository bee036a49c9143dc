import pytest
from conftest import rows

import tagweave as tw
from tagweave.operators import tagging
from tagweave.operators.hubs import hub_fan_out, hub_rows
from tagweave.operators.slices import edges_for, vertices_by_tag
from tagweave.session import new_folder, small_shuffle_reads


def test_tags_both_ends_and_keeps_each_edge_once(make_frames):
    v, e = make_frames("1:1 2:2 3:2 3:2", "1>2 1>2 2>3 3>3")
    assert rows(tw.tag_edges(v, e)) == [(1, 2, 1, 2), (2, 3, 2, 2), (3, 3, 2, 2)]


def test_dangling_edges(make_frames):
    v, e = make_frames("1:1 2:2", "1>2 1>9 8>2 8>9 1>9")
    assert rows(tw.dangling_edges(v, e)) == [(1, 9), (8, 2), (8, 9)]
    with pytest.raises(Exception, match="edge endpoint without a tag"):
        tw.tag_edges(v, e).collect()
    assert rows(tw.tag_edges(v, e, on_dangling="drop")) == [(1, 2, 1, 2)]
    with pytest.raises(ValueError):
        tw.tag_edges(v, e, on_dangling="ignore")


def test_conflicting_tags(make_frames):
    v, e = make_frames("1:1 1:2 2:2 2:2", "1>2")
    assert rows(tw.conflicting_tags(v)) == [(1, 2)]
    with pytest.raises(Exception, match="conflicting tags for vertex 1"):
        tw.tag_edges(v, e).collect()
    with pytest.raises(Exception, match="conflicting tags"):
        tw.build_graph(v, e)


def test_full_range_of_ids_and_tags(make_frames):
    low, high = -(2**63), 2**63 - 1
    v, e = make_frames(f"{low}:-2147483648 {high}:2147483647", f"{low}>{high}")
    assert rows(tw.tag_edges(v, e)) == [(low, high, -(2**31), 2**31 - 1)]


def hub_frames(make_frames):
    """Vertex 0 holds most edges in both directions."""
    vertices = "0:1 " + " ".join(f"{i}:{2 + i % 2}" for i in range(1, 40))
    edges = " ".join(f"0>{i} {i}>0" for i in range(1, 40)) + " 1>2 2>3 3>4"
    return make_frames(vertices, edges)


def test_split_hubs_give_the_same_tagged_edges(make_frames):
    v, e = hub_frames(make_frames)
    hubs = tagging.hub_endpoints(e, 10)
    assert {(r["side"], r["id"]) for r in hubs.collect()} == {("src", 0), ("dst", 0)}
    assert rows(tw.tag_edges(v, e, hubs=hubs, split_at=10)) == rows(tw.tag_edges(v, e))


def test_stored_graph(spark, make_frames):
    v, e = hub_frames(make_frames)
    path = new_folder(spark, "test-graph")
    built = tw.build_graph(v, e, store=path, split_at=10)
    loaded = tw.load_graph(spark, path, split_at=10)
    assert rows(loaded.tagged.drop("bucket")) == rows(tw.tag_edges(v, e))
    assert rows(loaded.vertices) == rows(v)
    assert rows(loaded.hubs.table) == rows(built.hubs.table) != []
    assert loaded.hubs.touched == built.hubs.touched
    pattern = tw.Pattern.parse("1:2 2:1 3:3", "1>2 2>3")
    plain = tw.match(tw.TaggedGraph(v, tw.tag_edges(v, e)), pattern)
    assert rows(tw.match(loaded, pattern)) == rows(plain)


def test_hubless_stored_graph(spark, make_frames):
    v, e = make_frames("1:-7 2:-2147483648", "1>2")
    path = new_folder(spark, "test-graph")
    tw.build_graph(v, e, store=path)
    assert not tw.load_graph(spark, path).hubs
    cached = tw.load_graph(spark, path).persist()
    assert rows(tw.match(cached, tw.Pattern.parse("1:-7 2:-2147483648", "1>2"))) == [(1, 2)]
    cached.unpersist()


def test_slice_reads_one_folder(spark, make_frames):
    v, e = hub_frames(make_frames)
    path = new_folder(spark, "test-graph")
    graph = tw.build_graph(v, e, store=path)
    plan = edges_for(graph.tagged, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert "EqualTo(src_tag,1), EqualTo(dst_tag,2)" in plan
    assert len(edges_for(graph.tagged, 1, 2).inputFiles()) >= 1
    assert rows(edges_for(graph.tagged, 1, 2)) == [(0, i) for i in range(2, 40, 2)]


def test_slices(make_graph):
    graph = make_graph("1:1 2:1 3:2 4:3", "1>3 1>4 2>4 3>4")
    assert rows(vertices_by_tag(graph.tagged, 1)) == [(1,), (2,)]
    assert rows(edges_for(graph.tagged, 1, 3)) == [(1, 4), (2, 4)]


@pytest.mark.parametrize("split", [False, True])
def test_sorted_adjacency(make_frames, split):
    v, e = hub_frames(make_frames)
    tagged = tw.tag_edges(v, e)
    hubs = hub_fan_out(tagged, tagging.hub_endpoints(e, 10), 10) if split else None
    ordered = tagging.sorted_adjacency(tagged, hubs)
    assert rows(ordered) == rows(tagged)
    parts = [part for part in ordered.rdd.glom().collect() if part]
    for part in parts:
        keys = [(r.src, r.dst_tag, r.dst) for r in part]
        assert keys == sorted(keys)
    places = {src: sum(any(r.src == src for r in part) for part in parts) for src in (1, 2, 3)}
    assert set(places.values()) == {1}


def test_tagging_more_edges_takes_more_partitions(spark, make_frames, monkeypatch):
    v, e = hub_frames(make_frames)
    few = rows(tw.tag_edges(v, e))
    monkeypatch.setattr("tagweave.operators.skew.SPREAD_ROWS", 5)
    monkeypatch.setattr("tagweave.operators.skew.TASK_ROWS", 4)
    endpoints = tagging.hub_endpoints(e, 10)
    for hubs in (None, endpoints):
        tagged = tw.tag_edges(v, e, hubs=hubs, split_at=10)
        text = tagged._jdf.queryExecution().executedPlan().toString()
        partitions = -(-e.count() // 4)
        assert partitions > 3 and f", {partitions}), REPARTITION_BY_NUM" in text
        assert rows(tagged) == few


def test_storing_leaves_the_session_as_it_was(spark, make_frames):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    with small_shuffle_reads(spark):
        assert spark.conf.get(key) == f"{16 << 20}b"
        with small_shuffle_reads(spark, 1 << 30):
            assert spark.conf.get(key) == f"{16 << 20}b"
    assert spark.conf.get(key) == before


def test_hubs_that_are_too_many_for_a_broadcast(make_frames, monkeypatch):
    v, e = hub_frames(make_frames)
    tagged = tw.tag_edges(v, e)
    endpoints = tagging.hub_endpoints(e, 10)
    expected = rows(hub_fan_out(tagged, endpoints, 10).table)
    monkeypatch.setattr("tagweave.operators.hubs.BROADCAST_ROWS", 0)
    assert "LeftSemi" not in hub_rows(tagged, endpoints, 10)._jdf.queryExecution().executedPlan().toString()
    assert rows(hub_fan_out(tagged, endpoints, 10).table) == expected != []
