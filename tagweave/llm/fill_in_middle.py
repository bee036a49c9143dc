"""Fill-in-middle examples: two cuts in a text, found through counts over blocks of bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import ddl, id_and_text, record_batch

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a block.
BLOCK = 4096
#: Of 100 documents, those that are rearranged, and of 100 of these, those with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
UNITS = ("code_point", "word")

_OUT = {"doc_id": "long", "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def unit_starts(data: np.ndarray, unit: str) -> np.ndarray:
    """For each byte, whether a unit starts there.

    A ``word`` is a run of bytes other than ASCII white space with the white space after it; white space at the
    start of a text belongs to the first word.
    """
    if unit == "code_point":
        return (data & 0xC0) != 0x80
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    starts = ~blank
    starts[1:] &= blank[:-1]
    # The first word reaches back over the white space before it.
    first = int(starts.argmax()) if starts.any() else 0
    starts[first : first + 1] = False
    starts[:1] = True
    return starts


class BlockCounts:
    """Units and code points of a text, as Fenwick trees over its blocks of bytes."""

    def __init__(self, raw: bytes, unit: str = "code_point", block: int = BLOCK) -> None:
        data = np.frombuffer(raw, dtype=np.uint8)
        self._block, self._length = block, len(raw)
        self._points = unit_starts(data, "code_point")
        self._units = self._points if unit == "code_point" else unit_starts(data, unit)
        self._unit_tree = self._tree(self._units)
        self._point_tree = self._unit_tree if self._units is self._points else self._tree(self._points)
        self.n_units = int(np.count_nonzero(self._units))

    def _tree(self, starts: np.ndarray) -> list[int]:
        """Entry i holds the count of the lowest set bit of i blocks that end with block i."""
        tree = [0]
        if self._length:
            tree += np.add.reduceat(starts, np.arange(0, self._length, self._block), dtype=np.int64).tolist()
        for i in range(1, len(tree)):
            above = i + (i & -i)
            if above < len(tree):
                tree[above] += tree[i]
        return tree

    def cut(self, units: int) -> tuple[int, int]:
        """The byte where the text after so many units starts, and the code points before it."""
        if units >= self.n_units:
            return self._length, int(np.count_nonzero(self._points))
        at, rest, points = 0, units, 0
        step = 1 << (len(self._unit_tree) - 1).bit_length()
        while step:
            ahead = at + step
            if ahead < len(self._unit_tree) and self._unit_tree[ahead] <= rest:
                at, rest, points = ahead, rest - self._unit_tree[ahead], points + self._point_tree[ahead]
            step >>= 1
        start = at * self._block
        inside = int(np.flatnonzero(self._units[start : start + self._block])[rest])
        return start + inside, points + int(np.count_nonzero(self._points[start : start + inside]))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that follow from a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearrange(doc_id: int | None, raw: bytes, seed: int, unit: str, rearranged: int, suffix_first: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    counts = BlockCounts(raw, unit)
    one, two, kind, order = draws(doc_id, seed)
    n = counts.n_units
    if not raw or kind % 100 >= rearranged or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    (a, points_a), (b, points_b) = (counts.cut(k) for k in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if order % 100 < suffix_first:
        return n, "spm", points_a, points_b - points_a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", points_a, points_b - points_a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(
    docs: DataFrame, seed: int = 1, unit: str = "code_point", rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each document, by its ``doc_id`` and ``text``.

    ``n`` is the number of units (``code_point`` or ``word``) of the text. Two draws from the id cut it after two numbers of
    units into prefix, middle and suffix; ``output`` is the text in the form ``psm`` (prefix, suffix, middle),
    ``spm`` (suffix, prefix, middle) or ``plain``. ``prefix_chars`` and ``middle_chars`` count code points, null for
    ``plain``. A text that is empty or holds one of the marks stays plain.

    The cuts are found in counts over blocks of 4,096 bytes: a Fenwick tree over the blocks is descended to the block
    of the cut, the place inside is found there. A row depends on its own document alone, nothing is
    shuffled and one text is held at a time. Null texts are empty, a null id draws from the empty string, repeated rows give equal rows, and
    all other columns, whatever their names, are left out.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            done = [
                rearrange(doc_id, raw.as_py() or b"", seed, unit, rearranged, suffix_first)
                for doc_id, raw in zip(ids, batch.column(1), strict=True)
            ]
            n, form, prefix, middle, output = (list(column) for column in zip(*done, strict=True))
            # The pieces are whole code points of valid text.
            texts = pa.array(output, pa.binary()).cast(pa.string())
            yield record_batch(_OUT, [ids, n, form, prefix, middle, texts])

    return id_and_text(docs).mapInArrow(run, ddl(_OUT))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an example was made of.

    A rearranged text holds no mark of its own, and none can form where pieces and marks meet, so the marks cut the output into its pieces.
    """
    pieces = F.split(F.col(output), "<[PSM]>", -1)
    in_order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    text = F.col(output)
    for name, places in in_order.items():
        text = F.when(F.col(form) == name, F.concat(*[F.get(pieces, F.lit(i)) for i in places])).otherwise(text)
    return text
