"""A Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and a proof per row.

Nodes are labelled so that a node's label is greater than those of its children: by the last leaf below it, then by its
level. A sweep in the order of labels (time-forward processing) delivers digests from children to parents through a
priority queue; a sweep in the reverse order delivers to each leaf what its proof has above it. A task sweeps blocks of
16^3 neighbouring nodes. What goes beyond a block is a row of a stored table, and Spark's sort by label is the external part of the queue.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import ddl, record_batch, shuffle_partitions, stored

#: Children of a node.
ARITY = 16
#: Levels that one sweep goes up, and the nodes of a block below them.
LEVELS = 3
BLOCK = ARITY**LEVELS
#: Characters of a digest.
WIDTH = 64

PROOF = "array<struct<left: string, right: string>>"
_NODE = {
    "tree": "long", "size": "long", "block": "long", "level": "int", "place": "long", "last": "long",
    "children": "string", "digest": "string", "top": "boolean",
}


def field(value: Column) -> Column:
    """A value for hashing: ``-`` for null, else its length in bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values of a row, in lowercase hex."""
    return F.sha2(F.concat(*[field(value) for value in values]), 256)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size = -(-size // ARITY)
        levels += 1
    return levels


def last_leaf(place: int, level: int, size: int) -> int:
    """The last leaf below a node: the first part of its label."""
    return min((place + 1) * ARITY**level, size) - 1


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``tree`` (a number per group, in the order of groups), ``slot`` (the place in the group, from 0) and ``size`` (of the group).

    Nulls come first. Rows are sorted in ranges by group and ``order``, so that a large group takes many ranges; ranges are counted
    per group, and the counts (a row per range and group) say where each range of a group starts.
    """
    keys = [group, *order]
    ranges = rows.repartitionByRange(shuffle_partitions(rows), *keys).sortWithinPartitions(*keys)
    placed = stored(ranges.withColumn("row_no", F.monotonically_increasing_id()), "merkle-sorted")
    placed = placed.withColumn("range_no", F.shiftright("row_no", 33))
    counts = placed.groupBy(F.col(group).alias("own_group"), F.col("range_no").alias("own_range")).agg(
        F.min("row_no").alias("first_row"), F.count("*").alias("n")
    )
    whole = Window.partitionBy("own_group")
    starts = counts.select(
        "own_group",
        "own_range",
        F.min("first_row").over(whole).alias("tree"),
        F.sum("n").over(whole).alias("size"),
        (F.sum("n").over(whole.orderBy("own_range")) - F.col("n") - F.col("first_row")).alias("shift"),
    )
    same = F.col(group).eqNullSafe(F.col("own_group")) & (F.col("range_no") == F.col("own_range"))
    return placed.join(starts, same).select(*rows.columns, "tree", "size", (F.col("row_no") + F.col("shift")).alias("slot"))


def _rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forward sweep over the blocks of a task, which come sorted: a row for each inner node."""
    queue: list[tuple[int, int, int, str]] = []  # label of the receiver (last leaf, level), slot of the child, digest
    tree = size = block = top = -1
    made: list[tuple] = []

    def send(slot: int, level: int, digest: str) -> None:
        place = slot // ARITY
        heapq.heappush(queue, (last_leaf(place, level + 1, size), level + 1, slot, digest))

    def receive(before: int | None) -> None:
        """Nodes whose label is passed get what has been sent to them."""
        while queue and (before is None or queue[0][0] < before):
            last, level, slot, digest = heapq.heappop(queue)
            children, place = [digest], slot // ARITY
            while queue and queue[0][:2] == (last, level):
                children.append(heapq.heappop(queue)[3])
            text = "".join(children)
            digest = sha256_hex(text)
            made.append((tree, size, block, level, place, last, text, digest, level == top))
            if level < top:
                send(place, level, digest)

    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("tree", "size", "slot", "digest"))
        for own_tree, own_size, slot, digest in zip(*columns, strict=True):
            if (own_tree, slot // BLOCK) != (tree, block):
                receive(None)
                tree, size, block, top = own_tree, own_size, slot // BLOCK, min(LEVELS, height(own_size))
            else:
                receive(slot)
            send(slot, 0, digest)
        if made:
            yield record_batch(_NODE, [list(column) for column in zip(*made, strict=True)])
            made.clear()
    receive(None)
    if made:
        yield record_batch(_NODE, [list(column) for column in zip(*made, strict=True)])


@dataclass(frozen=True)
class Sweep:
    """Nodes to start from (tree, size, slot, digest and others), and the nodes of up to three levels above them."""

    below: DataFrame
    nodes: DataFrame


def rise(leaves: DataFrame) -> tuple[list[Sweep], DataFrame]:
    """Builds all trees over ``tree, size, slot, digest``; returns the sweeps and the roots (tree, digest, sweep).

    ``sweep`` is the number of the last sweep of a tree.
    """
    largest = leaves.agg(F.max("size")).first()[0] or 0
    below, sweeps = leaves, []
    roots = leaves.where("size = 1").select("tree", "digest", F.lit(0).alias("sweep"))
    while True:
        several = below.where("size > 1").select("tree", "size", "slot", "digest")
        blocks = several.withColumn("block", F.floor(F.col("slot") / BLOCK)).repartition("tree", "block")
        nodes = blocks.sortWithinPartitions("tree", "block", "slot").drop("block").mapInArrow(_rise, ddl(_NODE))
        nodes = stored(nodes, "merkle-nodes")
        sweeps.append(Sweep(below, nodes))
        up = nodes.where("top").select(
            "tree", F.ceil(F.col("size") / BLOCK).alias("size"), F.col("block").alias("slot"), "digest"
        )
        roots = roots.union(up.where("size = 1").select("tree", "digest", F.lit(len(sweeps) - 1)))
        below, largest = up.where("size > 1"), -(-largest // BLOCK)
        if largest <= 1:
            return sweeps, roots


def _sink(carried: list[str], kinds: list[str]):
    schema = pa.struct([("left", pa.string()), ("right", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The reversed sweep over the blocks of a task: rows of nodes and leaves by falling label, each block after what is sent to its root."""
        queue: list[tuple] = []  # falling label of the receiver, its proof as a flat list of left and right
        subroot = None
        for batch in batches:
            kept, proofs, subroots = [], [], []
            names = ("size", "level", "place", "last", "children", "proof", "subroot")
            columns = (batch.column(name).to_pylist() for name in names)
            for row, (size, level, place, last, children, proof, own) in enumerate(zip(*columns, strict=True)):
                if level > LEVELS:  # what the block's root gets; the next row is the root
                    queue.clear()
                    subroot = own
                    queue.append((None, None, [part for pair in proof for part in (pair["left"], pair["right"])]))
                    continue
                _, _, above = queue.pop() if len(queue) == 1 else heapq.heappop(queue)
                if level == 0:
                    kept.append(row)
                    proofs.append(above)
                    subroots.append(subroot)
                    continue
                for i in range(len(children) // WIDTH):
                    child = place * ARITY + i
                    siblings = [children[: i * WIDTH], children[(i + 1) * WIDTH :]]
                    label = (-last_leaf(child, level - 1, size), 1 - level)
                    heapq.heappush(queue, (*label, siblings + above))
            if not kept:
                continue
            offsets, flat = [0], []
            for proof in proofs:
                flat += proof
                offsets.append(len(flat) // 2)
            pairs = pa.StructArray.from_arrays(
                [pa.array(flat[0::2], pa.string()), pa.array(flat[1::2], pa.string())], fields=list(schema)
            )
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
            leaf = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(leaf.column(f"c{i}") for i in range(len(carried))), lists, pa.array(subroots, pa.string())],
                names=[*carried, "proof", "subroot"],
            )

    fields = {**dict(zip(carried, kinds, strict=True)), "proof": PROOF, "subroot": "string"}
    return run, ddl(fields)


def sink(sweeps: list[Sweep], roots: DataFrame) -> DataFrame:
    """The leaves of the sweeps with all their columns, ``proof`` and ``subroot``.

    ``roots`` has ``tree, digest, sweep`` and the proof of each tree's root. The sweeps go down from the last to the
    first, each hands its leaves' proofs to the roots of the blocks below.
    """
    sent = None
    for number in range(len(sweeps) - 1, -1, -1):
        below, nodes = sweeps[number].below, sweeps[number].nodes
        own = roots.where(F.col("sweep") == number).select("tree", F.lit(0).cast("long").alias("block"), "proof", F.col("digest").alias("subroot"))
        sent = own if sent is None else own.union(sent)
        carried = below.columns
        kinds = [f.dataType.simpleString() for f in below.schema.fields]
        none = [F.lit(None).cast(kind).alias(f"c{i}") for i, kind in enumerate(kinds)]
        no_proof = [F.lit(None).cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot")]
        leaf_rows = below.select(
            "tree", "size", F.floor(F.col("slot") / BLOCK).alias("block"), F.lit(0).alias("level"), F.col("slot").alias("place"),
            F.col("slot").alias("last"), F.lit(None).cast("string").alias("children"), *no_proof,
            *[F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(carried)],
        )
        node_rows = nodes.select("tree", "size", "block", "level", "place", "last", "children", *no_proof, *none)
        zero = F.lit(0).cast("long")
        sent_rows = sent.select(
            "tree", zero.alias("size"), "block", F.lit(LEVELS + 1).alias("level"), zero.alias("place"),
            F.lit(2**63 - 1).alias("last"), F.lit(None).cast("string").alias("children"), "proof", "subroot", *none,
        )
        rows = leaf_rows.union(node_rows).union(sent_rows).repartition("tree", "block")
        rows = rows.sortWithinPartitions("tree", "block", F.desc("last"), F.desc("level"))
        run, schema = _sink(carried, kinds)
        done = rows.mapInArrow(run, schema)
        if number == 0:
            return done
        sent = done.select("tree", F.col("slot").alias("block"), "proof", "subroot")
    raise ValueError("no sweeps")


def manifest(rows: DataFrame, group: str, order: str, digest: str, carry: Sequence[str] = ()) -> DataFrame:
    """``order, group, leaf, subroot, root, proof`` and the ``carry`` columns of each row.

    ``digest`` names the column with the rows' digests, the leaves. In each group (null is one) leaves ascend by ``order``, nulls
    first, then by digest; 16 neighbours have a parent, until one node is left, the subroot. The subroots, by group, nulls first and bytewise, have a
    tree of the same kind. ``proof`` has a (left, right) pair of the siblings' digests for each level up to the root; see ``folded``.

    Rows are sorted once, by ranges, so a group of any size takes many tasks; sweeps read blocks of 4,096 nodes, three levels at a time, and
    the digests of a block are all a task holds. Only the root and the size of the largest group come to the driver. Repeated rows
    are leaves of their own; an empty table gives an empty manifest. Other columns, whatever their names, are left out.
    """
    own = [F.col(f"`{name}`").alias(f"x{i}") for i, name in enumerate((group, order, *carry))]
    leaves = stored(rows.select(*own, F.col(f"`{digest}`").alias("digest")), "merkle-leaves")
    names = [f"x{i}" for i in range(len(own))]
    sweeps, subroots = rise(numbered(leaves, "x0", ["x1", "digest"]))
    # A tree over the trees: their numbers are in the order of the groups.
    groups = subroots.select(F.lit(0).alias("all_of"), F.col("tree").alias("own_tree"), "digest", "sweep")
    top, root = rise(numbered(groups, "all_of", ["own_tree"]))
    root = root.withColumn("proof", F.array().cast(PROOF))
    to_trees = sink(top, root).select(F.col("own_tree").alias("tree"), "digest", "sweep", "proof")
    value = root.select("digest").first()
    out = sink(sweeps, to_trees)
    return out.select(
        F.col("x1").alias(order),
        F.col("x0").alias(group),
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(value["digest"] if value else None).cast("string").alias("root"),
        "proof",
        *[F.col(name).alias(c) for name, c in zip(names[2:], carry, strict=True)],
    )


def proof_digest(proof: str = "proof") -> Column:
    """SHA-256 of the siblings of a proof, level by level, left to right."""
    siblings = F.transform(F.col(proof), lambda level: F.concat(level["left"], level["right"]))
    return F.sha2(F.array_join(siblings, ""), 256)


def folded(leaf: str, proof: str = "proof") -> Column:
    """The root that a leaf and a proof lead to."""
    step = lambda digest, level: F.sha2(F.concat(level["left"], digest, level["right"]), 256)
    return F.aggregate(F.col(proof), F.col(leaf), step)
