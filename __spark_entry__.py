"""Registered queries over the graph of the order tables, and their SQL equivalents."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tagweave as tw
from tagweave.functions.expressions import match_line
from tagweave.job import run as run_job
from tagweave.operators import groups, joins, slices, stars, tagging
from tagweave.operators.skew import SPLIT_ROWS, few_or_stored, hot_keys, skew_join, splits_from
from tagweave.pattern import Pattern
from tagweave.plans.match import match, match_count_row
from tagweave.session import new_folder
from tagweave.sources import text

try:
    import tagweave.llm.queries as llm
except ModuleNotFoundError as missing:  # the subpackage is optional, what it imports is not
    if missing.name not in ("tagweave.llm", "tagweave.llm.queries"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

PATTERNS = {
    "p_edge": Pattern.parse("1:12 2:21", "1>2"),
    "p_star_same_tag": Pattern.parse("1:21 2:111 3:111", "1>2 1>3"),
    "p_star_mixed": Pattern.parse("1:21 2:111 3:112 4:40", "1>2 1>3 1>4"),
    "p_triangle": Pattern.parse("1:21 2:111 3:40", "1>2 2>3 1>3"),
    "p_cycle_local_supplier": Pattern.parse("1:12 2:21 3:40 4:50", "1>2 2>3 3>4 1>4"),
    "p_path4": Pattern.parse("1:60 2:50 3:12 4:21 5:111", "2>1 3>2 3>4 4>5"),
    "p_shared_part": Pattern.parse("1:21 2:111 3:111 4:22", "1>2 1>3 4>3"),
    "p_two_regions": Pattern.parse("1:50 2:60 3:50 4:60", "1>2 3>4"),
    "p_isolated_region": Pattern.parse("1:40 2:50 3:60 4:50", "1>2"),
    "p_no_match": Pattern.parse("1:60 2:50", "1>2"),
    "p_region_only": Pattern.parse("7:60"),
    "p_three_regions": Pattern.parse("1:50 2:60 3:50 4:60 5:50 6:60", "1>2 3>4 5>6"),
}
EVENT_PATH = Pattern.parse("1:5 2:1 3:3", "1>2 2>3")

#: Edges from which a vertex is a hub in the queries that show split joins; the usual limit is never reached in small tables.
HUB_SPLIT = 4

_graphs: dict[tuple[str, str, str], tw.TaggedGraph] = {}


def _graph(spark: SparkSession, sf_dir: str, kind: str = "orders") -> tw.TaggedGraph:
    """The tagged graph, built once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _graphs and kind in ("bucketed", "indexed"):
        plain = _graph(spark, sf_dir)
        _graphs[key] = plain.bucketed() if kind == "bucketed" else plain.indexed()
    if key not in _graphs:
        source = tw.event_graph if kind == "events" else tw.graph_from_tables
        split_at = HUB_SPLIT if kind == "hubs" else SPLIT_ROWS
        _graphs[key] = tw.build_graph(*source(spark, sf_dir), split_at=split_at)
    return _graphs[key]


def _edges(graph: tw.TaggedGraph) -> DataFrame:
    return graph.tagged.select(*slices.EDGE_COLUMNS)


def entry(spark: SparkSession) -> DataFrame:
    """Orders of the highest priority with a part and a supplier of that part."""
    return match(_graph(spark, "/root/testdata/sf0.001"), PATTERNS["p_triangle"])


def _match(name: str, kind: str = "orders", strategy: str = "auto") -> Query:
    return lambda spark, sf_dir: match(_graph(spark, sf_dir, kind), PATTERNS[name], strategy=strategy)


def _cached_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches on cached edges. The rows are stored, so that the cache can be given back."""
    graph, path = _graph(spark, sf_dir).persist(), new_folder(spark, "matches-cached")
    tw.write_matches(match(graph, PATTERNS["p_cycle_local_supplier"]), path, "parquet")
    graph.unpersist()
    return spark.read.parquet(path)


def _count(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match_count_row(_graph(spark, sf_dir), PATTERNS[name]).select(F.col("n").cast("long").alias("n"))

    return query


def _slices(graph: tw.TaggedGraph, pattern: Pattern) -> joins.Slices:
    return lambda edge: joins.edge_slice(graph.tagged, pattern, edge, graph.hubs)


def _first_star(name: str, kind: str = "orders") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph, pattern = _graph(spark, sf_dir, kind), PATTERNS[name]
        return joins.first_star(pattern, pattern.stars[0], _slices(graph, pattern))

    return query


def _read_vertices_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "vertices-text")
    text.write_vertices(tw.graph_from_tables(spark, sf_dir)[0], path)
    return text.read_vertices(spark, path)


def _read_edges_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "edges-text")
    text.write_edges(tagging.distinct_edges(tw.graph_from_tables(spark, sf_dir)[1]), path)
    return text.read_edges(spark, path)


def _write_matches_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "matches-text")
    tw.write_matches(match(_graph(spark, sf_dir), PATTERNS["p_triangle"]), path)
    return text.read_match_lines(spark, path)


def _write_matches_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "matches-parquet")
    tw.write_matches(match(_graph(spark, sf_dir), PATTERNS["p_triangle"]), path, "parquet")
    return spark.read.parquet(path)


def _tag_edges(spark: SparkSession, sf_dir: str, split_at: int = SPLIT_ROWS) -> DataFrame:
    vertices, edges = tw.graph_from_tables(spark, sf_dir)
    return tw.tag_edges(vertices, edges, hubs=tagging.hub_endpoints(edges, split_at), split_at=split_at)


def _sorted_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    return tagging.sorted_adjacency(_edges(graph), graph.hubs)


def _dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = tw.graph_from_tables(spark, sf_dir)
    discontinued = (F.col("tag") > 100) & (F.col("id") % 10 == 0)
    return tw.dangling_edges(vertices.where(~discontinued), edges)


def _conflicting_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return tw.conflicting_tags(
        lineitem.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").cast("int").alias("tag"))
    )


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = F.transform(
        "children", lambda c: F.concat(c["id"].cast("string"), F.lit(":"), c["tag"].cast("string"))
    )
    return stars.stars(_edges(_graph(spark, sf_dir))).select(
        "root", "root_tag", "block", F.concat_ws(",", child).alias("children")
    )


def _vertices_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir, "indexed")
    return slices.vertices_by_tag(graph.tagged, 21, graph.sources)


def _shared_part_stars(spark: SparkSession, sf_dir: str):
    return _graph(spark, sf_dir), PATTERNS["p_shared_part"].stars


def _star_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, pattern_stars = _shared_part_stars(spark, sf_dir)
    return stars.star_candidates(graph.tagged, pattern_stars)


def _star_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, pattern_stars = _shared_part_stars(spark, sf_dir)
    return stars.star_matches(graph.tagged, pattern_stars, graph.hubs)


def _star_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, pattern_stars = _shared_part_stars(spark, sf_dir)
    return stars.star_match_counts(graph.tagged, pattern_stars)


def _star_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, pattern_stars = _shared_part_stars(spark, sf_dir)
    return stars.star_selectivity(
        stars.star_table(spark, pattern_stars), stars.star_match_counts(graph.tagged, pattern_stars)
    )


def _star_child_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars.star_child_tags(
        stars.stars(_edges(_graph(spark, sf_dir))).withColumnRenamed("root", "star_id")
    )


def _star_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    return stars.star_members(_edges(graph), hubs=graph.hubs)


def _prune_by_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, pattern_stars = _shared_part_stars(spark, sf_dir)
    return stars.prune_by_star(graph.tagged, pattern_stars[0], graph.hubs)


def _extend_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, pattern = _graph(spark, sf_dir), Pattern.parse("1:12 2:21 3:111", "1>2 2>3")
    of = _slices(graph, pattern)
    return joins.extend(of((1, 2)).rows, pattern, of((2, 3)))


def _close_triangle(spark: SparkSession, sf_dir: str, kind: str = "orders") -> DataFrame:
    graph, pattern = _graph(spark, sf_dir, kind), PATTERNS["p_triangle"]
    of = _slices(graph, pattern)
    return joins.close(joins.first_star(pattern, pattern.stars[0], of), pattern, of((2, 3)))


def _attach_root(spark: SparkSession, sf_dir: str, kind: str = "orders") -> DataFrame:
    graph, pattern = _graph(spark, sf_dir, kind), Pattern.parse("1:21 2:111 3:22", "1>2 3>2")
    of = _slices(graph, pattern)
    return joins.attach_root(of((1, 2)).rows, pattern, of((3, 2)))


def _attach_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, pattern = _graph(spark, sf_dir), PATTERNS["p_shared_part"]
    of = _slices(graph, pattern)
    shared, last = pattern.stars
    return joins.attach_mixed(joins.first_star(pattern, last, of), pattern, shared, of).select(
        *pattern.columns
    )


def _cross_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, pattern = _graph(spark, sf_dir), PATTERNS["p_two_regions"]
    of = _slices(graph, pattern)
    return joins.cross_components(of((1, 2)).rows, of((3, 4)).rows, pattern)


def _order_parts(graph: tw.TaggedGraph, tag: int) -> DataFrame:
    return slices.with_tag_pairs(graph.tagged, [(order, tag) for order in range(21, 26)]).select("src", "dst")


def _group_permutations(spark: SparkSession, sf_dir: str, split_at: int = SPLIT_ROWS) -> DataFrame:
    return groups.group_permutations(_order_parts(_graph(spark, sf_dir), 111), "src", "dst", 2, split_at)


def _cross_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    by_tag = [(_order_parts(graph, 111), 2), (_order_parts(graph, 112), 1)]
    return groups.cross_tags(by_tag, "src", "dst")


def _non_injective_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check of result lines, on joins that leave out the test for repeated vertices."""
    graph, pattern = _graph(spark, sf_dir), PATTERNS["p_shared_part"]
    of = _slices(graph, pattern)
    large = few_or_stored(hot_keys(of((1, 2)).rows, ["v1"]))
    pairs = skew_join(of((1, 2)).rows, of((1, 3)).rows, ["v1"], splits_from(large, ["v1"], "n", "n"))
    with_repeats = skew_join(
        pairs, of((4, 3)).rows, ["v3"], graph.hubs.extend_splits(pattern.tag_pair((4, 3)), False, "v3")
    )
    return tw.non_injective_rows(with_repeats.select(match_line(pattern.columns).alias("value")))


def _job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch job on text files, its result lines read back."""
    folder, pattern = new_folder(spark, "job"), PATTERNS["p_shared_part"]
    vertices, edges = tw.graph_from_tables(spark, sf_dir)
    text.write_vertices(vertices, f"{folder}/data-vertices")
    text.write_edges(tagging.distinct_edges(edges), f"{folder}/data-edges")
    query_vertices = spark.createDataFrame(list(pattern.vertices), "id long, tag int")
    query_edges = spark.createDataFrame(list(pattern.edges), "src long, dst long")
    text.write_vertices(query_vertices.coalesce(1), f"{folder}/query-vertices")
    text.write_edges(query_edges.coalesce(1), f"{folder}/query-edges")
    inputs = [f"{folder}/{name}" for name in ("data-vertices", "data-edges", "query-vertices", "query-edges")]
    run_job(spark, *inputs, f"{folder}/output", f"{folder}/work")
    return text.read_match_lines(spark, f"{folder}/output")


def _stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches on a graph that was stored and loaded again."""
    path = new_folder(spark, "stored")
    tw.build_graph(*tw.graph_from_tables(spark, sf_dir), store=path)
    return match(tw.load_graph(spark, path), PATTERNS["p_triangle"])


def queries() -> dict[str, Query]:
    """Every operator, by name, over the tables of a data folder."""
    result: dict[str, Query] = {
        "graph_vertices": lambda spark, sf_dir: tw.graph_from_tables(spark, sf_dir)[0],
        "distinct_edges": lambda spark, sf_dir: tagging.distinct_edges(tw.graph_from_tables(spark, sf_dir)[1]),
        "event_edges": lambda spark, sf_dir: tw.event_graph(spark, sf_dir)[1],
        "read_vertices_text": _read_vertices_text,
        "read_edges_text": _read_edges_text,
        "write_matches_text": _write_matches_text,
        "write_matches_parquet": _write_matches_parquet,
        "match_summary": lambda spark, sf_dir: tw.match_summary(
            _graph(spark, sf_dir), PATTERNS["p_shared_part"]
        ),
        "match_summary_path": lambda spark, sf_dir: tw.match_summary(_graph(spark, sf_dir), PATTERNS["p_path4"]),
        "vertices_by_tag": _vertices_by_tag,
        "source_degrees": lambda spark, sf_dir: _graph(spark, sf_dir, "indexed").sources,
        "edges_for": lambda spark, sf_dir: slices.edges_for(_graph(spark, sf_dir).tagged, 21, 111),
        "tag_edges": _tag_edges,
        "sorted_adjacency": _sorted_adjacency,
        "dangling_edges": _dangling_edges,
        "conflicting_tags": _conflicting_tags,
        "prune_by_star": _prune_by_star,
        "neighbour_tag_counts": lambda spark, sf_dir: stars.neighbour_tag_counts(_graph(spark, sf_dir).tagged),
        "star_candidates": _star_candidates,
        "star_matches": _star_matches,
        "star_match_counts": _star_match_counts,
        "stars": _stars,
        "star_members": _star_members,
        "star_child_tags": _star_child_tags,
        "star_selectivity": _star_selectivity,
        "first_star_same_tag": _first_star("p_star_same_tag"),
        "first_star_mixed": _first_star("p_star_mixed"),
        "extend_path": _extend_path,
        "close_triangle": _close_triangle,
        "attach_root": _attach_root,
        "attach_mixed": _attach_mixed,
        "cross_components": _cross_components,
        "group_permutations": _group_permutations,
        "cross_tags": _cross_tags,
        "non_injective_rows": _non_injective_rows,
        "match_checkpointed": lambda spark, sf_dir: match(
            _graph(spark, sf_dir), PATTERNS["p_path4"], checkpoint_every=1
        ),
        "match_cached_graph": _cached_match,
        "match_bucketed_graph": _match("p_star_mixed", "bucketed"),
        "match_reduced_path": _match("p_path4", strategy="reduce"),
        "match_reduced_shared_part": _match("p_shared_part", strategy="reduce"),
        "match_intersect_triangle": _match("p_triangle", strategy="intersect"),
        "match_intersect_cycle": _match("p_cycle_local_supplier", strategy="intersect"),
        "match_stored_graph": _stored_graph,
        "match_event_path": lambda spark, sf_dir: match(_graph(spark, sf_dir, "events"), EVENT_PATH),
        "job": _job,
    }
    # The same again with a limit at which vertices and users of small tables are split.
    result |= {
        "event_edges_busy": lambda spark, sf_dir: tw.event_graph(spark, sf_dir, HUB_SPLIT)[1],
        "tag_edges_hub": lambda spark, sf_dir: _tag_edges(spark, sf_dir, HUB_SPLIT),
        "first_star_hub": _first_star("p_star_mixed", "hubs"),
        "close_hub": lambda spark, sf_dir: _close_triangle(spark, sf_dir, "hubs"),
        "attach_root_hub": lambda spark, sf_dir: _attach_root(spark, sf_dir, "hubs"),
        "group_permutations_hub": lambda spark, sf_dir: _group_permutations(spark, sf_dir, HUB_SPLIT),
        "match_hub_shared_part": _match("p_shared_part", "hubs"),
        "match_hub_intersect": _match("p_triangle", "hubs", "intersect"),
    }
    for name in PATTERNS:
        result[name.replace("p_", "match_", 1)] = _match(name)
        result[name.replace("p_", "match_count_", 1)] = _count(name)
    return result | (llm.queries() if llm else {})


_GRAPH = """
with gv as materialized (
  select cast(100000000 + c_custkey as bigint) id,
         cast(10 + array_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) as int) tag from customer
  union all select cast(200000000 + o_orderkey as bigint), cast(20 + cast(substr(o_orderpriority,1,1) as int) as int) from orders
  union all select cast(300000000 + p_partkey as bigint), cast(100 + cast(regexp_extract(p_brand,'([0-9]+)',1) as int) as int) from part
  union all select cast(400000000 + s_suppkey as bigint), cast(40 as int) from supplier
  union all select cast(500000000 + n_nationkey as bigint), cast(50 as int) from nation
  union all select cast(600000000 + r_regionkey as bigint), cast(60 as int) from region
), ge as materialized (
  select cast(100000000 + o_custkey as bigint) src, cast(200000000 + o_orderkey as bigint) dst from orders
  union select 200000000 + l_orderkey, 300000000 + l_partkey from lineitem
  union select 200000000 + l_orderkey, 400000000 + l_suppkey from lineitem
  union select 300000000 + l_partkey, 400000000 + l_suppkey from lineitem
  union select 400000000 + s_suppkey, 500000000 + s_nationkey from supplier
  union select 100000000 + c_custkey, 500000000 + c_nationkey from customer
  union select 500000000 + n_nationkey, 600000000 + n_regionkey from nation
), t as materialized (
  select src, dst, a.tag src_tag, b.tag dst_tag
  from ge join gv a on a.id = src join gv b on b.id = dst
)
"""

_EVENTS = """
with ev as (
  select cast(event_id as bigint) id,
         cast(array_position(['click','error','purchase','signup','view'], event_type) as int) tag,
         cast(lead(event_id) over (partition by user_id order by ts, event_id) as bigint) next_id
  from events
)
"""

# The matches of each pattern, written out as joins of edges. ``e<a>_<b>`` are the edges from tag a to tag b, see ``_over_graph``.
_MATCHES = {
    "p_edge": "select src v1, dst v2 from e12_21",
    "p_star_same_tag": "select a.src v1, a.dst v2, b.dst v3 from e21_111 a join e21_111 b on b.src = a.src and b.dst <> a.dst",
    "p_star_mixed": """select a.src v1, a.dst v2, b.dst v3, c.dst v4
        from e21_111 a join e21_112 b on b.src = a.src join e21_40 c on c.src = a.src""",
    "p_triangle": """select a.src v1, a.dst v2, b.dst v3
        from e21_111 a join e111_40 b on b.src = a.dst join e21_40 c on c.src = a.src and c.dst = b.dst""",
    "p_cycle_local_supplier": """select a.src v1, a.dst v2, b.dst v3, c.dst v4
        from e12_21 a join e21_40 b on b.src = a.dst join e40_50 c on c.src = b.dst
             join e12_50 d on d.src = a.src and d.dst = c.dst""",
    "p_path4": """select a.dst v1, a.src v2, b.src v3, c.dst v4, d.dst v5
        from e50_60 a join e12_50 b on b.dst = a.src join e12_21 c on c.src = b.src join e21_111 d on d.src = c.dst""",
    "p_shared_part": """select a.src v1, a.dst v2, b.dst v3, c.src v4
        from e21_111 a join e21_111 b on b.src = a.src and b.dst <> a.dst join e22_111 c on c.dst = b.dst""",
    "p_two_regions": """select a.src v1, a.dst v2, b.src v3, b.dst v4
        from e50_60 a, e50_60 b where a.src <> b.src and a.dst <> b.dst""",
    "p_isolated_region": """select a.src v1, a.dst v2, r.id v3, n.id v4
        from e40_50 a, (select id from gv where tag = 60) r, (select id from gv where tag = 50) n where n.id <> a.dst""",
    "p_no_match": "select src v1, dst v2 from e60_50",
    "p_region_only": "select id v7 from gv where tag = 60",
    "p_three_regions": """select a.src v1, a.dst v2, b.src v3, b.dst v4, c.src v5, c.dst v6
        from e50_60 a join e50_60 b on a.src <> b.src and a.dst <> b.dst
             join e50_60 c on a.src <> c.src and a.dst <> c.dst and b.src <> c.src and b.dst <> c.dst""",
}

# Parts of tags 111 and 112 of the orders.
_ORDER_PARTS = "".join(
    f", parts{tag} as materialized (select src, dst from t where src_tag between 21 and 25 and dst_tag = {tag})" for tag in (111, 112)
)

# Stars of p_shared_part: star 0 needs two parts of tag 111, star 1 needs one.
_SHARED_PART_STARS = """, signature as (
  select src, src_tag, count(*) n from t where dst_tag = 111 and src_tag in (21, 22) group by src, src_tag
), candidate as (
  select cast(0 as int) star_id, src root from signature where src_tag = 21 and n >= 2
  union all select cast(1 as int), src from signature where src_tag = 22
), star as (
  select cast(0 as int) star_id, cast(1 as bigint) root, cast(21 as int) root_tag, cast(2 as int) out_degree, '2,3' children
  union all select 1, 4, 22, 1, '3'
), counted as (
  select star_id, root, root_tag, out_degree, children,
         cast((select count(*) from candidate c where c.star_id = s.star_id) as bigint) n
  from star s
), weighted as (
  select *, cast(n as double) / (out_degree * out_degree) weight from counted
)
"""


def _over_graph(sql: str, tables: str = "") -> str:
    """SQL over the graph, other ``tables`` and slices: each slice in use is made once, so no order of joins meets other edges."""
    pairs = sorted(set(re.findall(r"\be(\d+)_(\d+)\b", sql)))
    slices_used = "".join(
        f", e{a}_{b} as materialized (select src, dst from t where src_tag = {a} and dst_tag = {b})" for a, b in pairs
    )
    return f"{_GRAPH}{tables}{slices_used} {sql}"


# Stars of p_path4, and the order in which they are joined for each star to start with.
_PATH_STARS = """, star as (
  select cast(0 as int) star_id, cast(2 as bigint) root, cast(50 as int) root_tag, cast(1 as int) out_degree, '1' children,
         (select count(distinct src) from e50_60) n
  union all select 1, 3, 12, 2, '2,4', (select count(*) from (select distinct src from e12_50 intersect select distinct src from e12_21))
  union all select 2, 4, 21, 1, '5', (select count(distinct src) from e21_111)
), weighted as (
  select *, cast(n as double) / (out_degree * out_degree) weight from star
), started as (
  select arg_min(star_id, (weight, star_id)) first from weighted
)
"""

_LINES = "select v1 || ',' || v2 || ',' || v3 || ',' || v4 as value from ({})"


def oracle_sql() -> dict[str, str]:
    """The same results in SQL over the tables."""
    triangle, shared = _MATCHES["p_triangle"], _MATCHES["p_shared_part"]
    with_stars = _GRAPH + _SHARED_PART_STARS
    result = {
        "graph_vertices": _GRAPH + "select id, tag from gv",
        "distinct_edges": _GRAPH + "select src, dst from ge",
        "event_edges": _EVENTS + "select id src, next_id dst from ev where next_id is not null",
        "read_vertices_text": _GRAPH + "select id, tag from gv",
        "read_edges_text": _GRAPH + "select src, dst from ge",
        "write_matches_text": _over_graph(f"select v1 || ',' || v2 || ',' || v3 as value from ({triangle})"),
        "write_matches_parquet": _over_graph(triangle),
        "match_summary": _over_graph(
            f"""select star_id, root, root_tag, children, n, weight,
            cast(row_number() over (order by weight, star_id) - 1 as int) join_position,
            cast((select count(*) from ({shared})) as bigint) result_count from weighted""",
            _SHARED_PART_STARS,
        ),
        "match_summary_path": _over_graph(
            _PATH_STARS
            + f"""select star_id, root, root_tag, children, n, weight,
                cast(case first when 0 then star_id when 1 then [1, 0, 2][star_id + 1] else 2 - star_id end as int) join_position,
                cast((select count(*) from ({_MATCHES["p_path4"]})) as bigint) result_count from weighted, started""",
        ),
        "source_degrees": _GRAPH + "select src id, src_tag tag, count(*) out_degree from t group by src, src_tag",
        "vertices_by_tag": _GRAPH + "select distinct src from t where src_tag = 21",
        "edges_for": _GRAPH + "select src, dst from t where src_tag = 21 and dst_tag = 111",
        "tag_edges": _GRAPH + "select src, dst, src_tag, dst_tag from t",
        "sorted_adjacency": _GRAPH + "select src, dst, src_tag, dst_tag from t",
        "dangling_edges": _GRAPH
        + """, kept as (select id from gv where not (tag > 100 and id % 10 = 0))
            select src, dst from ge where src not in (select id from kept) or dst not in (select id from kept)""",
        "conflicting_tags": """select l_partkey id, count(distinct l_suppkey) n_tags from lineitem
            group by l_partkey having count(distinct l_suppkey) > 1""",
        "prune_by_star": with_stars
        + """select src, dst, src_tag, dst_tag from t
            where dst_tag = 111 and src in (select root from candidate where star_id = 0)""",
        "neighbour_tag_counts": _GRAPH
        + "select src, src_tag, dst_tag, count(*) n from t group by src, src_tag, dst_tag",
        "star_candidates": with_stars + "select star_id, root from candidate",
        "star_matches": with_stars
        + """select star_id, root, dst_tag, dst from candidate join t on src = root where dst_tag = 111""",
        "star_match_counts": with_stars + "select star_id, n from counted",
        "stars": _GRAPH
        + """select t.src root, src_tag root_tag,
                   cast(dst - dst % 65536 as bigint) block,
                   string_agg(dst || ':' || dst_tag, ',' order by dst) children
            from t group by 1, 2, 3""",
        "star_members": _GRAPH
        + """select src root, src_tag root_tag, row_number() over (partition by src order by dst) - 1 pos, dst id, dst_tag tag from t""",
        "star_child_tags": _GRAPH + "select src star_id, dst_tag, count(*) k from t group by src, dst_tag",
        "star_selectivity": with_stars
        + """select star_id, out_degree, n, weight,
            cast(row_number() over (order by weight, star_id) as int) as rank from weighted""",
        "first_star_same_tag": _over_graph(_MATCHES["p_star_same_tag"]),
        "first_star_mixed": _over_graph(_MATCHES["p_star_mixed"]),
        "extend_path": _over_graph("select a.src v1, a.dst v2, b.dst v3 from e12_21 a join e21_111 b on b.src = a.dst"),
        "close_triangle": _over_graph(triangle),
        "attach_root": _over_graph("select a.src v1, a.dst v2, b.src v3 from e21_111 a join e22_111 b on b.dst = a.dst"),
        "attach_mixed": _over_graph(shared),
        "cross_components": _over_graph(_MATCHES["p_two_regions"]),
        "group_permutations": _over_graph(
            "select a.src, a.dst m1, b.dst m2 from parts111 a join parts111 b on b.src = a.src and b.dst <> a.dst", _ORDER_PARTS
        ),
        "cross_tags": _over_graph(
            """select a.src, a.dst t1m1, b.dst t1m2, c.dst t2m1
            from parts111 a join parts111 b on b.src = a.src and b.dst <> a.dst join parts112 c on c.src = a.src""",
            _ORDER_PARTS,
        ),
        "non_injective_rows": _over_graph(
            _LINES.format(
                """select a.src v1, a.dst v2, b.dst v3, c.src v4
                from e21_111 a join e21_111 b on b.src = a.src and a.dst = b.dst join e22_111 c on c.dst = b.dst"""
            )
        ),
        "match_checkpointed": _over_graph(_MATCHES["p_path4"]),
        "match_cached_graph": _over_graph(_MATCHES["p_cycle_local_supplier"]),
        "match_bucketed_graph": _over_graph(_MATCHES["p_star_mixed"]),
        "match_reduced_path": _over_graph(_MATCHES["p_path4"]),
        "match_reduced_shared_part": _over_graph(shared),
        "match_intersect_triangle": _over_graph(triangle),
        "match_intersect_cycle": _over_graph(_MATCHES["p_cycle_local_supplier"]),
        "match_hub_intersect": _over_graph(triangle),
        "match_stored_graph": _over_graph(triangle),
        "match_event_path": _EVENTS
        + """select a.id v1, b.id v2, c.id v3 from ev a join ev b on b.id = a.next_id join ev c on c.id = b.next_id
            where a.tag = 5 and b.tag = 1 and c.tag = 3""",
        "job": _over_graph(_LINES.format(shared)),
    }
    for name, plain in (
        ("event_edges_busy", "event_edges"),
        ("tag_edges_hub", "tag_edges"),
        ("first_star_hub", "first_star_mixed"),
        ("close_hub", "close_triangle"),
        ("attach_root_hub", "attach_root"),
        ("group_permutations_hub", "group_permutations"),
    ):
        result[name] = result[plain]
    result["match_hub_shared_part"] = _over_graph(_MATCHES["p_shared_part"])
    for name, sql in _MATCHES.items():
        result[name.replace("p_", "match_", 1)] = _over_graph(sql)
        result[name.replace("p_", "match_count_", 1)] = _over_graph(f"select count(*) n from ({sql})")
    return result | (llm.oracle_sql() if llm else {})
