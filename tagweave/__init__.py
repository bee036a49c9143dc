"""Labelled-graph pattern matching on PySpark DataFrames."""

from tagweave.graph import TaggedGraph, build_graph, load_graph
from tagweave.operators.tagging import conflicting_tags, dangling_edges, tag_edges
from tagweave.pattern import Pattern, Star
from tagweave.plans.match import match, match_count
from tagweave.report import match_summary, non_injective_rows
from tagweave.session import create_session
from tagweave.sources.tables import event_graph, graph_from_tables
from tagweave.sources.text import read_edges, read_pattern, read_vertices, write_matches

__all__ = [
    "Pattern",
    "Star",
    "TaggedGraph",
    "build_graph",
    "conflicting_tags",
    "create_session",
    "dangling_edges",
    "event_graph",
    "graph_from_tables",
    "load_graph",
    "match",
    "match_count",
    "match_summary",
    "non_injective_rows",
    "read_edges",
    "read_pattern",
    "read_vertices",
    "tag_edges",
    "write_matches",
]
