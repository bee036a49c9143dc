"""Near duplicates among embeddings by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import ddl, record_batch, stored
from tagweave.llm.components import connected_components

COSINE = 0.93
#: Most children of a cell; their centres are drawn by a hash.
PIVOTS = 64
#: Vectors in a cell from which it is divided no further: a task builds the lower levels of its tree.
BLOCK = 2048
#: Levels of cells after which cells that are still large are cut by a hash.
LEVELS = 24
#: Vectors of a large cell that one task deals to its children.
DEALT = 16_384
#: Distances computed at once.
_CELLS = 1 << 21
#: Rows from which the next centres of a level are taken at once.
_AHEAD = 128
#: Slack of the bounds for rounding; pairs are decided by their own cosine.
_SLACK = 1e-7


class CoverTree:
    """Nested levels of centres over the rows of ``x`` (unit vectors), radii halving from level to level.

    A node has a centre (a row), the true radius that covers its rows, and children: one has the same centre, and all
    are covered within half the bound of the level above. Nodes of one row, or of equal rows, are leaves.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.rows: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self._add(0, np.arange(len(x)), float(_distances(x[:1], x).max()))
        bound, level = self.radius[0], [0]
        while level:
            bound /= 2
            below = []
            for node in level:
                if len(self.rows[node]) > 1 and self.radius[node] > 1e-9:
                    self.children[node] = np.array(self._cover(node, bound))
                    below += self.children[node].tolist()
            level = below

    def _add(self, centre: int, rows: np.ndarray, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.rows.append(rows)
        self.children.append(np.zeros(0, dtype=np.int64))
        return len(self.centre) - 1

    def _cover(self, node: int, bound: float) -> list[int]:
        """Children of a node: centres more than ``bound`` apart, each row with the first centre that reaches it."""
        if self.radius[node] <= bound:
            return [self._add(self.centre[node], self.rows[node], self.radius[node])]
        centre, rows = self.centre[node], self.rows[node]
        rows = np.concatenate([[centre], rows[rows != centre]])
        made = []
        while len(rows):
            ahead = rows[:_AHEAD]
            near = _distances(self.x[ahead], self.x[rows])
            reaches = near <= bound
            np.fill_diagonal(reaches, True)
            chosen: list[int] = []
            for i in range(len(ahead)):
                if not reaches[chosen, i].any():
                    chosen.append(i)
            first = reaches[chosen].argmax(axis=0)
            covered = reaches[chosen].any(axis=0)
            for k, i in enumerate(chosen):
                own = np.nonzero(covered & (first == k))[0]
                radius = float(near[i, own].max()) if len(own) > 1 else 0.0
                made.append(self._add(int(rows[i]), rows[own], radius))
            rows = rows[~covered]
        return made


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def linked_pairs(one: CoverTree, two: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of two trees with a cosine of at least ``cosine``, found by descending both at once.

    A pair of nodes whose centres are further apart than both radii and the threshold is left with all its rows. ``one is two`` gives
    each pair once and no row with itself.
    """
    reach = float(np.sqrt(max(2 - 2 * cosine, 0))) + _SLACK
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        below = [
            tree.children[node] if len(tree.children[node]) else np.array([node])
            for tree, node in ((one, p), (two, q))
        ]
        leaf = not len(one.children[p]) and not len(two.children[q])
        if leaf or len(one.rows[p]) * len(two.rows[q]) <= 64:
            yield from _checked(one, two, one.rows[p], two.rows[q], cosine)
            continue
        left, right = below
        at_left = one.x[[one.centre[n] for n in left]]
        at_right = two.x[[two.centre[n] for n in right]]
        r_left = np.array([one.radius[n] for n in left])
        r_right = np.array([two.radius[n] for n in right])
        step = max(1, _CELLS // len(right))
        for i in range(0, len(left), step):
            distance = _distances(at_left[i : i + step], at_right)
            near = distance <= r_left[i : i + step, None] + r_right[None, :] + reach
            a, b = np.nonzero(near)
            a, b = left[i + a], right[b]
            if one is two and p == q:
                a, b = a[a <= b], b[a <= b]
            single = np.array([len(one.rows[n]) for n in a]) * np.array([len(two.rows[n]) for n in b]) == 1
            if single.any():
                first = np.array([one.centre[n] for n in a[single]])
                second = np.array([two.centre[n] for n in b[single]])
                keep = first != second if one is two else np.ones(len(first), dtype=bool)
                yield from _decided(one, two, first[keep], second[keep], cosine)
            stack += zip(a[~single].tolist(), b[~single].tolist(), strict=True)


def _checked(one, two, left, right, cosine):
    for i in range(0, len(left), max(1, _CELLS // len(right))):
        part = left[i : i + max(1, _CELLS // len(right))]
        near = one.x[part] @ two.x[right].T >= cosine - _SLACK
        a, b = np.nonzero(near)
        a, b = part[a], right[b]
        if one is two:
            # Rows of one node meet in both orders, those of two nodes in one.
            keep = a < b if len(left) == len(right) and np.array_equal(left, right) else a != b
            a, b = a[keep], b[keep]
        yield from _decided(one, two, a, b, cosine)


def _decided(one, two, a, b, cosine):
    if len(a):
        near = np.einsum("ij,ij->i", one.x[a], two.x[b]) >= cosine
        if near.any():
            yield a[near], b[near]


def _unit_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x``: doubles of length one, as bytes; null where a vector can link with nothing."""
    fields = {"vec_id": "long", "label": "string", "x": "binary"}

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value in batch.column(2).to_pylist():
                x = None
                if value and None not in value:
                    x = np.array(value, dtype=np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top  # so that squares neither overflow nor vanish
                        x = (x / np.sqrt((x * x).sum())).tobytes()
                    else:
                        x = None
                made.append(x)
            yield record_batch(fields, [batch.column(0), batch.column(1), made])

    columns = (
        F.col("vec_id").cast("long"),
        F.col("label").cast("string"),
        F.col("embedding").cast("array<double>"),
    )
    return vectors.select(*columns).mapInArrow(unit, ddl(fields))


def _divided(placed: DataFrame, large: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The vectors of ``large`` cells (label, path, size) in their children, and the children: ``label, parent, path, centre, r``.

    Centres are some expected ``size / BLOCK`` vectors of the cell, at most ``PIVOTS``, drawn by a hash; which ones affects cost alone. A vector falls to the nearest, and
    ``r`` is the largest distance. A cell of any size is dealt out in parts of bounded size.
    """
    members = placed.join(large, ["label", "path"])
    wanted = F.least(F.lit(PIVOTS), F.greatest(F.lit(2), F.ceil(1.2 * F.col("size") / BLOCK)))
    draw = F.pmod(F.xxhash64("x", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    drawn = members.withColumns({"draw": draw, "wanted": wanted}).where(F.col("draw") * F.col("size") < 2 * F.col("wanted") + 8)
    place = F.row_number().over(Window.partitionBy("label", "path").orderBy("draw", "node"))
    centres = drawn.withColumn("place", place).where("place <= wanted")
    centres = stored(centres.select("label", "path", "place", F.col("x").alias("centre")), "centres")
    parts = F.ceil(F.col("size") / DEALT)
    dealt = members.withColumn("part", F.pmod(F.xxhash64("node"), parts))
    copies = large.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    copies = copies.select("label", "path", "part").join(centres, ["label", "path"])
    fields = {**_PLACED, "away": "double"}

    def assign(group: pa.Table, own: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.Table.from_batches([record_batch(fields, [[] for _ in fields])])
        order = np.argsort(own.column("place").to_numpy())
        numbers = own.column("place").to_numpy()[order]
        at = np.stack([np.frombuffer(x.as_py()) for x in own.column("centre")])[order] if len(order) else None
        children, away = [], []
        for start in range(0, group.num_rows, 1024):
            part = group.slice(start, 1024)
            if at is None:  # nothing was drawn: one child of the same size
                children += [0] * part.num_rows
                away += [2.0] * part.num_rows
                continue
            distance = _distances(np.stack([np.frombuffer(x.as_py()) for x in part.column("x")]), at)
            nearest = distance.argmin(axis=1)
            children += numbers[nearest].tolist()
            away += distance[np.arange(len(nearest)), nearest].tolist()
        path = group.column("path")[0].as_py()
        columns = [group.column(name).combine_chunks() for name in ("node", "label", "n", "x")]
        return pa.Table.from_batches([record_batch(fields, [*columns, [f"{path}/{child}" for child in children], away])])

    keys = ["label", "path", "part"]
    found = stored(dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(assign, ddl(fields)), "divided")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    cells = found.groupBy("label", "path").agg(F.max("away").alias("r")).withColumn("parent", parent)
    known = centres.select("label", F.concat_ws("/", "path", F.col("place").cast("string")).alias("path"), "centre")
    cells = cells.join(known, ["label", "path"], "left").select("label", "parent", "path", "centre", "r")
    return found.select(*_PLACED), stored(cells, "cells")


_PLACED = {"node": "long", "label": "string", "n": "long", "x": "binary", "path": "string"}


def _cells(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The vectors in their last cells, and the cells of each level.

    The first cell holds all vectors of one label and width; cells of more than ``BLOCK`` vectors are divided, level by level.
    """
    placed = classes.select("node", "label", "n", "x", F.octet_length("x").cast("string").alias("path"))
    done, levels = [], []
    for level in range(LEVELS):
        sizes = stored(placed.groupBy("label", "path").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), "large")
        if sizes.isEmpty():
            break
        done.append(placed.join(sizes, ["label", "path"], "left_anti").select(*_PLACED))
        placed, cells = _divided(placed, sizes, level)
        levels.append(cells)
    return reduce(DataFrame.union, [*done, placed]), levels


def _near_cells(first: DataFrame, levels: list[DataFrame], cosine: float) -> DataFrame:
    """``label, c1, c2``: pairs of last cells, each once, that may hold linked vectors.

    Starts with each first cell (``label, path``) and itself. Level by level a pair gives way to the pairs of its children whose covering
    radii allow a link; a cell that is not divided stays. A pair that is excluded takes all pairs below it with it.
    """
    reach = float(np.sqrt(max(2 - 2 * cosine, 0))) + 2 * _SLACK
    known = {f"{name}{i}": kind for i in (1, 2) for name, kind in (("c", "string"), ("x", "binary"), ("r", "double"))}
    fields = {"label": "string", **known}
    pairs = first.select("label", *[(F.col("path") if name[0] == "c" else F.lit(None).cast(kind)).alias(name) for name, kind in known.items()])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("x1"), batch.column("x2")
            ranges = np.stack([batch.column(name).fill_null(4.0).to_numpy(zero_copy_only=False) for name in ("r1", "r2")]).sum(axis=0)
            keep = [
                a is None or b is None or a == b or np.linalg.norm(np.frombuffer(a) - np.frombuffer(b)) <= limit + reach
                for a, b, limit in zip(one.to_pylist(), two.to_pylist(), ranges.tolist(), strict=True)
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    for cells in levels:
        for i in (1, 2):
            below = cells.select("label", F.col("parent").alias(f"c{i}"), F.col("path").alias("path"), F.col("centre"), F.col("r"))
            joined = pairs.join(below, ["label", f"c{i}"], "left")
            other = [F.col(name) for name in known if name[-1] != str(i)]
            pairs = joined.select(
                "label",
                *other,
                F.coalesce("path", f"c{i}").alias(f"c{i}"),
                F.when(F.col("path").isNull(), F.col(f"x{i}")).otherwise(F.col("centre")).alias(f"x{i}"),
                F.when(F.col("path").isNull(), F.col(f"r{i}")).otherwise(F.col("r")).alias(f"r{i}"),
            )
        # The children of a cell and itself meet in both orders.
        pairs = pairs.select(*fields).where("c1 <= c2")
        pairs = stored(pairs.mapInArrow(within, ddl(fields)), "cell-pairs")
    return pairs.select("label", "c1", "c2")


def _sides(classes: DataFrame, cosine: float) -> DataFrame:
    """The vectors of all pairs of blocks that meet: ``label, c1, c2, i, j, both, node, n, x, side``."""
    placed, levels = _cells(classes)
    first = classes.select("label", F.octet_length("x").cast("string").alias("path")).distinct()
    pairs = _near_cells(first, levels, cosine)
    # A cell has several blocks only if the levels did not suffice.
    sizes = placed.groupBy("label", "path").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = stored(sizes, "blocks")
    for i in (1, 2):
        pairs = pairs.join(sizes.select("label", F.col("path").alias(f"c{i}"), F.col("blocks").alias(f"b{i}")), ["label", f"c{i}"])
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b1") - 1)))
    pairs = pairs.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b2") - 1))).where("c1 < c2 or i <= j")
    both = ~((F.col("c1") == F.col("c2")) & (F.col("i") == F.col("j")))
    pairs = pairs.select("label", "c1", "c2", "i", "j", both.alias("both"))
    block = F.pmod("node", F.col("blocks").cast("long")).cast("int")
    blocks = placed.join(sizes, ["label", "path"]).withColumn("block", block)
    keys = ["label", "c1", "c2", "i", "j"]
    left = blocks.select("label", F.col("path").alias("c1"), F.col("block").alias("i"), "node", "n", "x")
    right = blocks.select("label", F.col("path").alias("c2"), F.col("block").alias("j"), "node", "n", "x")
    columns = [*keys, "both", "node", "n", "x"]
    sides = pairs.join(left, ["label", "c1", "i"]).select(*columns, F.lit(0).alias("side"))
    return sides.union(pairs.where("both").join(right, ["label", "c2", "j"]).select(*columns, F.lit(1).alias("side")))


def _spanning(links: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Least position that each of ``n`` positions reaches."""
    root = np.arange(n)
    if links:
        a, b = (np.concatenate(side) for side in zip(*links, strict=True))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
    return root


_LINKS = {"node": "long", "links": "long", "root": "long"}


def _traverse(cosine: float):
    def traverse(group: pa.Table) -> pa.Table:
        """Links between two blocks, or in one: how many vectors each node links with, and a node of its local group."""
        side = group.column("side").to_numpy()
        node = group.column("node").to_numpy()
        weight = group.column("n").to_numpy()
        x = np.stack([np.frombuffer(v.as_py()) for v in group.column("x")])
        order = np.lexsort((node, side))  # node order, so that a rerun gives the same trees
        side, node, weight, x = side[order], node[order], weight[order], x[order]
        first = int((side == 0).sum())
        both = group.column("both")[0].as_py()
        if both and first in (0, len(x)):  # one of the blocks is empty
            return pa.table([pa.array([], pa.int64())] * 3, names=list(_LINKS))
        one = CoverTree(x[:first])
        two = CoverTree(x[first:]) if both else one
        counts, found, size = np.zeros(len(x), dtype=np.int64), [], 0
        for a, b in linked_pairs(one, two, cosine):
            b = b + first if both else b
            np.add.at(counts, a, weight[b])
            np.add.at(counts, b, weight[a])
            found.append((a, b))
            size += len(a)
            if size > _CELLS:
                found, size = [(np.arange(len(x)), _spanning(found, len(x)))], 0
        root = _spanning(found, len(x))
        own = np.nonzero(counts)[0]
        return pa.table([pa.array(node[own]), pa.array(counts[own]), pa.array(node[root[own]])], names=list(_LINKS))

    return traverse


def embedding_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id`` of every vector.

    Vectors of one label (not null) are linked if the cosine of their doubles is at least ``cosine``, which must be positive;
    ``n_links`` counts the vectors linked with this one and ``component_id`` is the least id links reach.
    Null and zero vectors and those with a null or non-finite component have no links; vectors of different width have none with each other.
    Each row is a vector, also if ids or vectors are repeated: equal vectors of a label form one node with a weight. Vectors with a null
    id count as links, and are least only among themselves.

    Vectors of a label fall to cells, nested in levels until a cell is a block of bounded size: the upper levels of a cover tree. Pairs of cells descend
    level by level, and only pairs whose covering radii allow a link go on; the vectors are copied to the pairs of blocks that are left, and each is a task of
    its own, which descends the cover trees of both blocks. A task returns a row per linked node, never pairs.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be in (0, 1]")
    rows = stored(_unit_rows(vectors), "unit")
    usable = rows.where("x is not null and label is not null")
    classes = usable.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sides = _sides(classes, cosine)
    keys = ["label", "c1", "c2", "i", "j"]
    found = stored(sides.groupBy(*keys).applyInArrow(_traverse(cosine), ddl(_LINKS)), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node <> root").select("node", "root"))
    nodes = classes.join(links, "node", "left").join(roots, "node", "left")
    nodes = nodes.select("label", "x", "least", "n", "links", F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "root").select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    alone = rows.where("x is null or label is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return usable.join(nodes, ["label", "x"]).select("vec_id", "n_links", "component_id").union(alone)
