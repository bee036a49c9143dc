"""Shapes of physical plans, with every join shuffled as for large slices."""

from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as registered
from tagweave import load_graph, match
from tagweave.operators import joins, slices, stars
from tagweave.operators.slices import edges_for

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture
def graph(spark, monkeypatch):
    graph = registered._graph(spark, SF_DIR)
    monkeypatch.setattr("tagweave.plans.match.BROADCAST_ROWS", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield graph
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_star_shuffles_each_slice_once(graph):
    """Three slices and the candidate roots, all by the root; no exchange between the joins."""
    text = plan(match(graph, registered.PATTERNS["p_star_mixed"]))
    assert text.count("Exchange") == 4


def test_injectivity_is_part_of_the_join(graph):
    text = plan(match(graph, registered.PATTERNS["p_star_same_tag"]))
    assert "Inner, NOT (v3" in text


def test_closing_is_a_semi_join(graph):
    text = plan(match(graph, registered.PATTERNS["p_triangle"]))
    assert "LeftSemi" in text and "Window" not in text and "Python" not in text


def test_slices_read_ids_and_tags_only(graph):
    text = edges_for(graph.tagged, 21, 111)._jdf.queryExecution().explainString(
        graph.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "ReadSchema: struct<src:bigint,dst:bigint,src_tag:int,dst_tag:int>" in text
    roots = plan(stars.star_roots(graph.tagged, registered.PATTERNS["p_star_mixed"].stars[0]))
    assert "dst#" not in roots.replace("dst_tag#", "")
    assert roots.count("Exchange") == 1


def test_tagging_shuffles_edges_twice(spark, graph):
    """By source, with the removal of repeated edges, and by target; the vertices once for each end."""
    vertices, edges = registered.tw.graph_from_tables(spark, SF_DIR)
    from tagweave.operators.tagging import attach_tags

    text = plan(attach_tags(graph.vertices, edges))
    assert text.count("Exchange hashpartitioning") == 4
    assert text.count("Exchange") == 4


def test_a_bucketed_graph_joins_by_source_without_exchange(spark, graph):
    bucketed, pattern = registered._graph(spark, SF_DIR, "bucketed"), registered.PATTERNS["p_star_mixed"]
    of = lambda edge: joins.edge_slice(bucketed.edges_of([pattern.tag_pair(edge)]), pattern, edge)
    text = plan(joins.first_star(pattern, pattern.stars[0], of))
    assert "Exchange" not in text and text.count("Bucketed: true") == 3
    whole = plan(match(bucketed, pattern))
    assert "Exchange hashpartitioning" not in whole
    assert match(bucketed, pattern).count() == match(graph, pattern).count() > 0


def test_a_stored_graph_is_loaded_with_its_buckets_and_index(spark, tmp_path):
    vertices, edges = registered.tw.graph_from_tables(spark, SF_DIR)
    path = str(tmp_path / "graph")
    built = registered.tw.build_graph(vertices, edges, store=path, buckets=5, index=True)
    expected = built.tagged.select("src", "dst").exceptAll(built.by_source.select("src", "dst")).count()
    assert expected == 0 and built.tagged.count() == built.by_source.count()
    # As in another session, whose catalog does not know the table.
    from tagweave.operators.tagging import table_name

    spark.sql(f"DROP TABLE {table_name(path + '/by-source')}")
    loaded, pattern = load_graph(spark, path), registered.PATTERNS["p_triangle"]
    assert loaded.by_source is not None and loaded.sources is not None
    assert match(loaded, pattern).count() == match(built, pattern).count() > 0
    assert "Bucketed: true" in plan(loaded.by_source.where("bucket = 3").groupBy("src").count())


def test_hubs_are_read_from_files_that_split(spark):
    graph = registered._graph(spark, SF_DIR, "hubs").bucketed(4)
    hot = [pair for side, pair in graph.hubs.touched if side == "src"]
    assert hot and all(graph.edges_of([pair]) is graph.tagged for pair in hot)
    assert graph.by_source.where(slices.has_tag_pair(hot)).count() == 0
    assert match(graph, registered.PATTERNS["p_triangle"]).count() == 234


def test_vertices_of_a_tag_are_a_filtered_scan(spark, tmp_path, graph):
    indexed = graph.indexed(str(tmp_path / "sources"))
    text = plan(slices.vertices_by_tag(indexed.tagged, 21, indexed.sources))
    assert "Exchange" not in text and "EqualTo(tag,21)" in text
    # Row groups of other tags are told by their smallest and largest tag.
    tags = Counter()
    for file in (tmp_path / "sources").glob("*.parquet"):
        groups = pq.ParquetFile(file).metadata
        for i in range(groups.num_row_groups):
            own = groups.row_group(i).column(1).statistics
            tags[own.min <= 21 <= own.max] += 1
    assert tags[True] == 1 or tags[False] > 0
    assert indexed.sources.where("tag = 21").count() == slices.vertices_by_tag(graph.tagged, 21).count()
