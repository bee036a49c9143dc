"""Arrangements inside groups: ordered tuples of distinct members, and their combinations.

The members of a group are ranked and cut into blocks. A tuple's places take one block each; all choices of blocks
are one range of numbers per group, whose digits in a mixed radix are the blocks. The numbers are dealt out evenly, whatever the
sizes of groups, and a choice of blocks is turned into its tuples where it lands. So no join makes the tuples themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.expressions import keep_injective, named, quoted
from tagweave.operators.skew import BROADCAST_ROWS, SPLIT_ROWS, kept, skew_join, splits_from

#: Tuples that one choice of blocks makes at most.
CELL_ROWS = 1 << 18
#: Choices of blocks that are dealt out together.
CHUNK = 4096


def group_permutations(
    members: DataFrame, group: str, member: str, k: int, split_at: int = SPLIT_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """All ordered k-tuples of distinct members of each group: (group, m1, ..., mk).

    ``members`` holds each (group, member) once, both LONG.
    """
    return _tuples([(members, k)], group, member, [[f"m{j}" for j in range(1, k + 1)]], split_at, cell_rows)


def cross_tags(
    by_tag: Sequence[tuple[DataFrame, int]], root: str, member: str, split_at: int = SPLIT_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """For each root, every combination of its arrangements per tag.

    ``by_tag`` has one (members, k) per child tag: the candidates (root, member) of the
    tag and the number of children to place. Columns: root, then ``t<i>m<j>`` for the
    j-th child of the i-th tag. Roots that lack candidates of some tag have none.
    """
    names = [[f"t{i}m{j}" for j in range(1, k + 1)] for i, (_, k) in enumerate(by_tag, start=1)]
    return _tuples(by_tag, root, member, names, split_at, cell_rows)


def _tuples(
    by_tag: Sequence[tuple[DataFrame, int]], group: str, member: str, names: list[list[str]], split_at: int, cell_rows: int
) -> DataFrame:
    result = arrangement_cells(by_tag, group, member, split_at, cell_rows)
    done: list[str] = []
    slot = 0
    for own in names:
        for j, name in enumerate(own):
            waiting = [f"slot{i}" for i in range(slot + 1, sum(map(len, names)))]
            result = result.select(named(group), *map(named, done), F.explode(f"slot{slot}").alias(name), *waiting)
            result = keep_injective(result, name, own[:j])
            done.append(name)
            slot += 1
    return result


def arrangement_cells(
    by_tag: Sequence[tuple[DataFrame, int]], group: str, member: str, split_at: int = SPLIT_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Choices of blocks: (group, slot0, slot1, ...), an array of members for each place of a tuple.

    Every tuple, and those with a repeated member, is in the product of the arrays of exactly one row; no row's product has more than ``cell_rows`` tuples
    (or 2 members in each place). A group whose members are one block of each tag is one row.
    """
    if any(k < 1 for _, k in by_tag):
        raise ValueError("k must be at least 1")
    places = [i for i, (_, k) in enumerate(by_tag) for _ in range(k)]
    per_block = max(2, int(cell_rows ** (1 / len(places)) + 1e-9))
    large, n_large = [], 0
    for members, _ in by_tag:
        sizes = members.groupBy(named(group)).agg(F.count("*").alias("n"))
        table, n = kept(sizes.where(F.col("n") > per_block), "large-groups")
        large.append(table if n else None)
        n_large += n
    whole = [members.groupBy(named(group)).agg(F.collect_list(named(member)).alias("part")) for members, _ in by_tag]
    if not n_large:
        return _single_blocks(whole, group, places)
    several = reduce(DataFrame.union, [table.select(named(group)) for table in large if table is not None]).distinct()
    several = F.broadcast(several) if n_large <= BROADCAST_ROWS else several
    small = [
        members.join(several, group, "left_anti").groupBy(named(group)).agg(F.collect_list(named(member)).alias("part"))
        for members, _ in by_tag
    ]
    blocks = [
        kept(_blocks(members.join(several, group, "left_semi"), group, member, table, per_block, split_at), "group-blocks")
        for (members, _), table in zip(by_tag, large)
    ]
    counts = None
    for i, (table, _) in enumerate(blocks):
        own = table.groupBy(named(group)).agg(F.count("*").alias(f"blocks{i}"))
        counts = own if counts is None else counts.join(own, group)
    cells = cell_digits(counts, group, places)
    for slot, i in enumerate(places):
        table, n = blocks[i]
        own = table.select(named(group), F.col("block").alias(f"digit{slot}"), F.col("part").alias(f"slot{slot}"))
        cells = cells.join(F.broadcast(own) if n * per_block <= BROADCAST_ROWS else own, [group, f"digit{slot}"])
    cells = cells.select(named(group), *[f"slot{i}" for i in range(len(places))])
    return cells.unionByName(_single_blocks(small, group, places))


def _single_blocks(whole: Sequence[DataFrame], group: str, places: Sequence[int]) -> DataFrame:
    """One row for each group that has members of every tag."""
    result = None
    for i, table in enumerate(whole):
        own = table.withColumnRenamed("part", f"part{i}")
        result = own if result is None else result.join(own, group)
    return result.select(named(group), *[F.col(f"part{i}").alias(f"slot{slot}") for slot, i in enumerate(places)])


def _blocks(
    members: DataFrame, group: str, member: str, large: DataFrame | None, per_block: int, split_at: int
) -> DataFrame:
    """The members of each group in numbered blocks: (group, block, part).

    A group of more than ``split_at`` members is dealt by a hash into coarse parts, which are ranked and cut apart from each other; the
    blocks of all parts are then numbered through.
    """
    if large is None:
        return members.groupBy(named(group)).agg(F.lit(0).cast("long").alias("block"), F.collect_list(named(member)).alias("part"))
    splits = splits_from(large.where(F.col("n") > split_at), [group], "n", "1", split_at)
    sized = skew_join(members, large, [group], splits, "left")
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(1)) / split_at))
    placed = sized.select(named(group), named(member), F.pmod(F.xxhash64(named(member)), parts).alias("coarse"))
    rank = F.row_number().over(Window.partitionBy(named(group), "coarse").orderBy(named(member))) - 1
    cut = placed.withColumn("fine", F.floor(rank / per_block))
    cut = cut.groupBy(named(group), "coarse", "fine").agg(F.collect_list(named(member)).alias("part"))
    before = Window.partitionBy(named(group)).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(named(group), "coarse").agg(F.count("*").alias("n"))
    starts = starts.select(
        named(group), "coarse", F.coalesce(F.sum(F.ceil(F.col("n") / per_block)).over(before), F.lit(0)).alias("start")
    )
    return cut.join(starts, [group, "coarse"]).select(named(group), (F.col("start") + F.col("fine")).alias("block"), "part")


def cell_digits(counts: DataFrame, group: str, places: Sequence[int]) -> DataFrame:
    """All choices of blocks as digits: (group, digit0, digit1, ...), dealt evenly to the tasks.

    ``counts`` has a row per group with ``blocks<i>``, the blocks of its i-th tag, and ``places`` names the tag of each digit. The numbers from 0 to the
    product of the radices are dealt out in chunks and taken apart where they land.
    """
    radices = [f"blocks{i}" for i in places]
    numbered = counts.withColumn("cells", F.expr(" * ".join(f"bigint({radix})" for radix in radices)))
    chunks = numbered.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(cells - 1) div {CHUNK}"))))
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(partitions, named(group), "chunk")
    cells = chunks.withColumn(
        "rest", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(cells, (chunk + 1) * {CHUNK}) - 1)"))
    )
    for slot in reversed(range(len(places))):
        cells = cells.withColumns(
            {f"digit{slot}": F.expr(f"rest % {radices[slot]}"), "rest": F.expr(f"rest div {radices[slot]}")}
        )
    return cells.selectExpr(quoted(group), *[f"digit{slot}" for slot in range(len(places))])
