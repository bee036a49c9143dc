"""Token ids on disk as wavelet matrices: one compressed file per shard that answers access, counting and occurrence lookup.

A shard is a row of its own Parquet file: the ids of some neighbouring documents as bit planes, highest bit first. Each plane is in the
order that the planes above it give: zeros first, then ones, otherwise as before. Ones before each block of 512 bits are
kept beside the plane, so a rank reads one number and one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.byte_bpe import ByteBpe
from tagweave.llm.common import ddl, record_batch, shuffle_partitions
from tagweave.session import new_folder

#: Ids of a shard; a longer document is a shard of its own.
SHARD_IDS = 1 << 21
#: Bytes of text that are encoded together.
TEXT_BYTES = 12 << 20
#: The id that ends a document.
END = 0
_WORDS = 8  # words of 64 bits in a block

_SHARD = {
    "part_no": "long", "shard_no": "int", "n_tokens": "long", "doc_ids": "array<long>", "sizes": "array<long>",
    "zeros": "array<long>", "planes": "array<binary>", "ones": "array<binary>",
}


class WaveletMatrix:
    """A sequence of ids as bit planes, with the ones before each block of each plane."""

    def __init__(self, n: int, zeros: Sequence[int], planes: Sequence[bytes], ones: Sequence[bytes]) -> None:
        self.n, self.zeros = n, list(zeros)
        self._words = [np.frombuffer(plane, dtype="<u8") for plane in planes]
        self._ones = [np.frombuffer(own, dtype="<u4") for own in ones]

    @property
    def width(self) -> int:
        return len(self.zeros)

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        """The matrix of ids below ``2**width``."""
        n, zeros, planes, ones = len(ids), [], [], []
        # Whole blocks, and one word more, so that the rank of the end has a word to look at.
        length = (n // (64 * _WORDS) + 1) * _WORDS * 8
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        for bit in range(width - 1, -1, -1):
            on = (ids & ids.dtype.type(1 << bit)).astype(bool)
            plane = np.zeros(length, dtype=np.uint8)
            plane[: (n + 7) // 8] = np.packbits(on, bitorder="little")
            per_block = np.bitwise_count(plane.view("<u8")).reshape(-1, _WORDS).sum(axis=1, dtype=np.uint32)
            before = np.zeros(len(per_block) + 1, dtype="<u4")
            np.cumsum(per_block, out=before[1:])
            planes.append(plane.tobytes())
            ones.append(before.tobytes())
            zeros.append(n - int(before[-1]))
            parted = np.empty_like(ids)
            np.compress(~on, ids, out=parted[: zeros[-1]])
            np.compress(on, ids, out=parted[zeros[-1] :])
            ids = parted
        return cls(n, zeros, planes, ones)

    def stored_parts(self) -> tuple[list[int], list[bytes], list[bytes]]:
        return self.zeros, [w.tobytes() for w in self._words], [o.tobytes() for o in self._ones]

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self._words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        words, block = self._words[level], at >> 9
        total = self._ones[level][block].astype(np.int64)
        last = at >> 6
        for i in range(_WORDS):
            word = block * _WORDS + i
            total += np.where(word < last, np.bitwise_count(words[word]), 0)
        part = words[last] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return total + np.bitwise_count(part)

    def _place_of_one(self, level: int, k: np.ndarray) -> np.ndarray:
        """Where the ones number ``k`` (from 0) of a plane are."""
        return self._place(level, k, self._ones[level].astype(np.int64), False)

    def _place_of_zero(self, level: int, k: np.ndarray) -> np.ndarray:
        blocks = np.arange(len(self._ones[level]), dtype=np.int64) * 64 * _WORDS
        return self._place(level, k, blocks - self._ones[level], True)

    def _place(self, level: int, k: np.ndarray, before: np.ndarray, invert: bool) -> np.ndarray:
        block = np.searchsorted(before, k, side="right") - 1
        rest, words = k - before[block], self._words[level]
        word, done = block * _WORDS, np.zeros(len(k), dtype=bool)
        for _ in range(_WORDS):
            here = words[word]
            count = np.bitwise_count(~here if invert else here).astype(np.int64)
            done |= rest < count
            rest = np.where(done, rest, rest - count)
            word = np.where(done, word, word + 1)
        bits = np.unpackbits(words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counted = np.cumsum(1 - bits if invert else bits, axis=1, dtype=np.int64)
        return word * 64 + (counted <= rest[:, None]).sum(axis=1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at = np.asarray(at, dtype=np.int64)
        ids = np.zeros(len(at), dtype=np.uint32)
        for level, zeros in enumerate(self.zeros):
            on, before = self._bit(level, at), self._ones_before(level, at)
            ids = (ids << np.uint32(1)) | on
            at = np.where(on, zeros + before, at - before)
        return ids

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id in a range of positions are below the lowest plane."""
        if not 0 <= token < 1 << self.width:
            return 0, 0
        ends = np.array([start, end], dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            before = self._ones_before(level, ends)
            ends = zeros + before if token >> (self.width - 1 - level) & 1 else ends - before
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in a range of positions."""
        first, last = self._range(token, start, self.n if end is None else end)
        return last - first

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of an id, ascending."""
        first, last = self._range(token, 0, self.n)
        at = np.arange(first, last, dtype=np.int64)
        if not len(at):
            return at
        for level in range(self.width - 1, -1, -1):
            if token >> (self.width - 1 - level) & 1:
                at = self._place_of_one(level, at - self.zeros[level])
            else:
                at = self._place_of_zero(level, at)
        return at

    def values(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        ids = np.zeros(self.n, dtype=np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            on = np.unpackbits(self._words[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            zeros, above = self.zeros[level], np.empty_like(ids)
            # By places: masks of bits in no order cost several times as much.
            above[np.flatnonzero(~on)] = ids[:zeros]
            above[np.flatnonzero(on)] = ids[zeros:] | ids.dtype.type(1 << (self.width - 1 - level))
            ids = above
        return ids.astype(np.uint32)


_encoders: dict[str, ByteBpe] = {}


def _encoder(path: str) -> ByteBpe:
    """The encoder of a file, kept with its words while a Python worker lives."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``TEXT_BYTES`` bytes of text."""
    sizes = [0 if raw is None else raw for raw in pc.binary_length(batch.column("raw")).to_pylist()]
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > TEXT_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of all documents, each with ``end`` after it, in ascending order of ``doc_id``, as shards below ``path``.

    ``docs`` has ``doc_id`` and ``text``; ``vocabulary`` names a file of the tokenizers library on every executor. Nulls in ``doc_id``
    come first, rows of one id are ordered by a hash of their texts; a null text is empty, an empty text is its ``end`` alone, repeated rows are
    documents of their own, and other columns, whatever their names, are left out. An empty table gives no shard.

    Texts are shuffled once, into ranges of (id, hash), so rows of one id may take several tasks. A task holds the ids of one shard. Spark
    commits the files, so those of a task that ran twice or was lost do not count.
    """
    text = F.col("text").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("own_hash"), text.alias("raw"))
    keys = ("doc_id", "own_hash")
    ranges = rows.repartitionByRange(shuffle_partitions(docs), *keys).sortWithinPartitions(*keys)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        width, last = max(1, int(max(encoder.size - 1, end)).bit_length()), np.array([end], dtype=np.uint32)
        doc_ids, sizes, own, held, part, number = [], [], [], 0, -1, 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(own)
            parts = WaveletMatrix.build(ids, width).stored_parts()
            return record_batch(_SHARD, [[part], [number], [len(ids)], [doc_ids], [sizes], *([p] for p in parts)])

        for batch in batches:
            for some in _in_parts(batch):
                ids, counts = encoder.encode_all([(raw.as_py() or b"").decode() for raw in some.column("raw")])
                at, part = 0, some.column("part_no")[0].as_py()
                for doc_id, n in zip(some.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    if own and held + n + 1 > shard_ids:
                        yield shard()
                        doc_ids, sizes, own, held, number = [], [], [], 0, number + 1
                    doc_ids.append(doc_id)
                    sizes.append(n + 1)
                    own += (ids[at : at + n], last)
                    at, held = at + n, held + n + 1
        if own:
            yield shard()

    numbered = ranges.select(F.spark_partition_id().cast("long").alias("part_no"), "doc_id", "raw")
    shards = numbered.mapInArrow(build, ddl(_SHARD))
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards below ``path`` with ``start``, the number of ids in all shards before.

    Starts follow from a row for each range and shard; the numbers of one range are added up apart from those of the ranges.
    """
    shards = spark.read.schema(ddl(_SHARD)).parquet(path)
    sizes = shards.select("part_no", "shard_no", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part_no").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part_no", F.coalesce(F.sum("n").over(before.orderBy("part_no")), F.lit(0)).alias("part_start"))
    in_part = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part_no").orderBy("shard_no")), F.lit(0))
    starts = sizes.select("part_no", "shard_no", in_part.alias("in_part")).join(parts, "part_no")
    starts = starts.select("part_no", "shard_no", (F.col("in_part") + F.col("part_start")).alias("start"))
    return shards.join(F.broadcast(starts) if _few_files(shards) else starts, ["part_no", "shard_no"])


def _few_files(shards: DataFrame, most: int = 50_000) -> bool:
    """Whether the starts, 20 bytes a shard, can be sent to all executors; each shard is a file."""
    return len(shards.inputFiles()) <= most


def _from_shards(shards: DataFrame, answer: Callable, fields: dict[str, str]) -> DataFrame:
    """Rows that ``answer(matrix, row)`` makes of each shard, as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                planes, ones = ([own.as_buffer() for own in row[name]] for name in ("planes", "ones"))
                matrix = WaveletMatrix(row["n_tokens"].as_py(), row["zeros"].as_py(), planes, ones)
                yield record_batch(fields, answer(matrix, row))

    return shards.mapInArrow(run, ddl(fields))


def documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document, with the end id; ``ids`` are little-endian unsigned 32-bit integers."""

    def answer(matrix: WaveletMatrix, row: dict) -> list:
        ids = matrix.values().astype("<u4")
        sizes = row["sizes"].values.to_numpy()
        ends = np.cumsum(sizes)
        own = [ids[b - n : b].tobytes() for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return [row["doc_ids"].values, pa.array(ends - sizes + row["start"].as_py()), row["sizes"].values, own]

    return _from_shards(shards, answer, {"doc_id": "long", "start": "long", "n_tokens": "long", "ids": "binary"})


def checksums(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, ids as in ``documents``."""

    def answer(matrix: WaveletMatrix, row: dict) -> list:
        ids = memoryview(matrix.values().astype("<u4")).cast("B")
        sizes = row["sizes"].values.to_numpy()
        ends = np.cumsum(sizes)
        sums = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return [row["doc_ids"].values, pa.array(ends - sizes + row["start"].as_py()), row["sizes"].values, sums]

    return _from_shards(shards, answer, {"doc_id": "long", "start": "long", "n_tokens": "long", "ids_crc32": "long"})


def token_counts(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """``token, n``: occurrences of some ids in all documents, by ranks alone."""
    wanted = list(dict.fromkeys(int(token) for token in tokens))

    def answer(matrix: WaveletMatrix, row: dict) -> list:
        return [wanted, [matrix.count(token) for token in wanted]]

    counted = _from_shards(shards, answer, {"token": "long", "n": "long"})
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def token_occurrences(shards: DataFrame, token: int) -> DataFrame:
    """``doc_id, position, offset`` of each occurrence of an id: its place among all ids, and in its document."""

    def answer(matrix: WaveletMatrix, row: dict) -> list:
        at = matrix.occurrences(int(token))
        ends = np.cumsum(row["sizes"].values.to_numpy())
        doc = np.searchsorted(ends, at, side="right")
        starts = np.concatenate(([0], ends))[doc]
        return [row["doc_ids"].values.take(pa.array(doc)), pa.array(at + row["start"].as_py()), pa.array(at - starts)]

    return _from_shards(shards, answer, {"doc_id": "long", "position": "long", "offset": "long"})


def tokens_at(shards: DataFrame, positions: DataFrame) -> DataFrame:
    """``position, token`` for each distinct ``position`` among all ids that there is; others and nulls have no row.

    Positions go to their shard by the ranges of ids that it overlaps; a shard holds at most as many positions as ids.
    """
    span = F.lit(SHARD_IDS)
    places = shards.select("part_no", "shard_no", "start", "n_tokens")
    first, last = F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("n_tokens") - 1) / span)
    places = places.withColumn("span", F.explode(F.sequence(first, last)))
    asked = positions.select(F.col("position").cast("long").alias("position")).distinct()
    asked = asked.withColumn("span", F.floor(F.col("position") / span)).join(places, "span")
    asked = asked.where("position >= start AND position < start + n_tokens")
    asked = asked.groupBy("part_no", "shard_no").agg(F.collect_list(F.col("position") - F.col("start")).alias("asked"))

    def answer(matrix: WaveletMatrix, row: dict) -> list:
        at = row["asked"].values.to_numpy()
        return [pa.array(at + row["start"].as_py()), pa.array(matrix.access(at).astype(np.int64))]

    return _from_shards(shards.join(asked, ["part_no", "shard_no"]), answer, {"position": "long", "token": "long"})


def token_files(docs: DataFrame, vocabulary: str, **options: int) -> DataFrame:
    """``write_tokens`` to a new folder in the shared one, and ``read_shards`` of it."""
    path = new_folder(docs.sparkSession, "token-files")
    write_tokens(docs, vocabulary, path, **options)
    return read_shards(docs.sparkSession, path)
