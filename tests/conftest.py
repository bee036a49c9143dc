from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import tagweave as tw
from tagweave.operators.hubs import hub_fan_out
from tagweave.operators.tagging import hub_endpoints, tag_edges, unique_vertices


@pytest.fixture(scope="session")
def spark():
    session = tw.create_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": 3,
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_frames(spark):
    """Vertex and edge DataFrames from the short form ``1:1 2:1``, ``1>2 2>1``."""

    def frames(vertices: str, edges: str):
        v = [tuple(map(int, item.split(":"))) for item in vertices.split()]
        e = [tuple(map(int, item.split(">"))) for item in edges.split()]
        return (
            spark.createDataFrame(v, "id long, tag int").coalesce(2),
            spark.createDataFrame(e, "src long, dst long").coalesce(2),
        )

    return frames


@pytest.fixture(scope="session")
def make_graph(make_frames):
    """A small tagged graph; with ``split_at`` its larger vertices are treated as hubs."""

    def graph(vertices: str, edges: str, split_at: int | None = None) -> tw.TaggedGraph:
        v, e = make_frames(vertices, edges)
        if split_at is None:
            return tw.TaggedGraph(unique_vertices(v), tag_edges(v, e).persist())
        endpoints = hub_endpoints(e, split_at)
        tagged = tag_edges(v, e, hubs=endpoints, split_at=split_at).persist()
        return tw.TaggedGraph(unique_vertices(v), tagged, hub_fan_out(tagged, endpoints, split_at))

    return graph


def rows(df) -> list[tuple]:
    return sorted(tuple(row) for row in df.collect())
