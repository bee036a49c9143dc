"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import ddl, extend, record_batch, stored

WINDOW = 10
#: Words in a block of the shift table.
BLOCK = 3
#: Bytes of window text in one search pass; more are searched in further passes.
PASS_BYTES = 8 << 20

#: Bytes of words stay, A-Z become a-z, all others become a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Columns that the search adds.
FOUND = {"n_words": "long", "ranges": "array<int>", "items": "array<string>"}


def words(raw: bytes | None) -> tuple[bytes, ...]:
    return tuple(raw.translate(WORD_BYTES).split()) if raw else ()


class WuManber:
    """Search for word sequences of one length.

    ``shift`` says, for the block of words that ends the current position, how far the next
    possible end is; a block of no pattern lets the search jump by nearly a whole pattern. Blocks that end
    a pattern lead to a bucket whose patterns are compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(BLOCK, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[str]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.jump), self.length - end)
            self.buckets.setdefault(pattern[-self.block :], []).append((pattern, items))

    def search(self, text: tuple[bytes, ...]) -> Iterator[tuple[int, list[str]]]:
        """The start of each occurrence and the items its pattern belongs to."""
        length, block, jump, shift = self.length, self.block, self.jump, self.shift
        end, n = length, len(text)
        while end <= n:
            tail = text[end - block : end]
            step = shift.get(tail, jump)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in self.buckets[tail]:
                if text[start:end] == pattern:
                    yield start, items
            end += 1


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id") -> DataFrame:
    """``item_id, window``: each distinct word window of each item, words joined by a space."""
    fields = {"item_id": "string", "window": "binary"}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(raw.as_py())
                found = {b" ".join(own[i : i + window]) for i in range(max(1, len(own) - window + 1))} - {b""}
                yield record_batch(fields, [[item] * len(found), list(found)])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col("text").cast("binary").alias("raw"))
    return rows.where("item_id is not null").mapInArrow(cut, ddl(fields)).distinct()


def merged(ranges: list[int]) -> list[int]:
    """Sorted, disjoint ranges ``[start, end, start, end, ...]``."""
    out: list[int] = []
    for start, end in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _search_pass(rows: DataFrame, pairs: list[tuple[bytes, str]], first: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(pairs)

    def prepare():
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for window, item in shared.value:
            pattern = tuple(window.split(b" "))
            by_length.setdefault(len(pattern), {}).setdefault(pattern, []).append(item)
        tables = [WuManber(patterns) for patterns in by_length.values()]

        def work(raw: bytes | None) -> tuple[int, list[int], list[str]]:
            text, hit, items = words(raw), [], set()
            for table in tables:
                for start, of in table.search(text):
                    hit += [start, start + table.length]
                    items.update(of)
            return len(text), merged(hit), sorted(items)

        return work

    if first:
        return extend(rows, prepare, FOUND)
    # A further pass adds columns of its own, which then join those of the passes before.
    more = extend(rows, prepare, {f"more_{name}": kind for name, kind in FOUND.items()})
    return more.withColumns(
        {"ranges": F.concat("ranges", "more_ranges"), "items": F.array_sort(F.array_union("items", "more_items"))}
    ).drop(*(f"more_{name}" for name in FOUND))


def _merge_ranges(rows: DataFrame) -> DataFrame:
    """Sorts and merges the ranges that several passes have left."""
    pairs = "array_sort(transform(sequence(0, size(ranges) - 1, 2), i -> struct(ranges[i] as a, ranges[i + 1] as b)))"
    step = """if(size(r) > 0 and p.a <= element_at(r, -1),
        concat(slice(r, 1, size(r) - 1), array(greatest(element_at(r, -1), p.b))), concat(r, array(p.a, p.b)))"""
    merge = f"aggregate({pairs}, cast(array() as array<int>), (r, p) -> {step})"
    return rows.withColumn("ranges", F.expr(f"if(size(ranges) > 2, {merge}, ranges)"))


def mark_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """``docs`` with the columns of ``FOUND``, in input order; see ``find_benchmark``."""
    windows = stored(item_windows(benchmark, window), "windows")
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item_id") + 16)).first()[0] or 0
    passes = max(1, math.ceil(size / pass_bytes))
    rows = docs
    for i in range(passes):
        part = windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(passes)) == i)
        pairs = [(bytes(r["window"]), r["item_id"]) for r in part.select("window", "item_id").collect()]
        rows = _search_pass(stored(rows, "searched") if i else rows, pairs, first=i == 0)
    return _merge_ranges(rows) if passes > 1 else rows


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """Where benchmark items occur in documents.

    Returns a row per document: ``doc_id, n_words, ranges`` (word positions that lie in an
    occurrence, as ``[start, end, ...]``) and ``items`` (ids as strings, sorted).

    Words are runs of ASCII digits, letters (A-Z lower-cased) and of all characters beyond
    ASCII. Null and empty texts have no words. An item shorter than ``window`` is one window,
    an item without words or with a null id is none, repeated items count once. Repeated
    documents give repeated rows. An empty benchmark leaves every document clean.

    Windows are searched in passes of at most ``pass_bytes``, so what is sent to the tasks
    is bounded whatever the size of the benchmark; between passes rows are written out.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mark_benchmark(own, benchmark, window, pass_bytes).select("doc_id", *FOUND)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item occurs, with all their columns, whatever their names."""
    names = {name: "text" if name == "text" else f"c{i}" for i, name in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{name}`").alias(alias) for name, alias in names.items()])
    clean = mark_benchmark(own, benchmark).where(F.size("items") == 0)
    return clean.select(*[F.col(alias).alias(name) for name, alias in names.items()])


def contamination(found: DataFrame) -> DataFrame:
    """The digest of ``find_benchmark``."""
    hit = F.expr("aggregate(transform(ranges, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )
