"""Packs of documents that ask buckets about keys, and get their answers back together with their texts.

A key that a third of all documents hold is asked once per pack, so no bucket is hot. A pack is named by
its content: a task that runs again asks under the same name.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from tagweave.llm.common import ddl, record_batch

#: Bytes of text in a pack; a longer text is a pack of its own.
PACK_BYTES = 4 << 20
#: How packs are stored: a few in a row group, since a reader holds a row group's packs at once.
STORE = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}

Document = tuple[int | None, bytes | None]
#: From the documents of a pack: a payload for each bucket.
Ask = Callable[[list[Document]], dict[int, object]]

_REQUEST = {"bucket": "int", "pack": "binary", "payload": "binary"}
_ANSWER = {"pack": "binary", "bucket": "int", "payload": "binary"}
_PACK = {"pack": "binary", "doc_ids": "array<long>", "sizes": "array<int>", "texts": "binary"}


def squeeze(payload: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(payload, protocol=5))


def expand(data: bytes) -> object:
    """What ``squeeze`` made in another task of the same job."""
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[Document]]]:
    """Names and documents of the packs of some record batches of ids and texts."""
    for batch in batches:
        own: list[Document] = []
        size = 0
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = raw.as_py()
            if own and size + len(raw or b"") > PACK_BYTES:
                yield _name(own), own
                own, size = [], 0
            own.append((doc_id, raw))
            size += len(raw or b"")
        if own:
            yield _name(own), own


def _name(docs: list[Document]) -> bytes:
    name = xxhash.xxh3_128()
    for doc_id, raw in docs:
        name.update(b"%s:%s " % (str(doc_id).encode(), b"-" if raw is None else b"%d" % len(raw)))
        name.update(raw or b"")
    return name.digest()


def _bytes_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def packed(source: DataFrame) -> DataFrame:
    """One row per pack of ``doc_id, raw`` rows, texts compressed together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for name, docs in packs(batches):
            sizes = [-1 if raw is None else len(raw) for _, raw in docs]
            data = compressor.compress(b"".join(raw or b"" for _, raw in docs))
            ids = [doc_id for doc_id, _ in docs]
            yield record_batch(_PACK, [_bytes_column([name]), [ids], [sizes], _bytes_column([data])])

    return source.mapInArrow(pack, ddl(_PACK))


def unpacked(group: pa.Table) -> Iterator[list[Document]]:
    """The documents of each pack row of a group."""
    for ids, sizes, texts in zip(*(group.column(n) for n in ("doc_ids", "sizes", "texts")), strict=True):
        data, at, docs = zstandard.ZstdDecompressor().decompress(texts.as_py()), 0, []
        for doc_id, size in zip(ids.as_py(), sizes.as_py(), strict=True):
            docs.append((doc_id, None if size < 0 else data[at : at + size]))
            at += max(size, 0)
        yield docs


def _request_rows(name: bytes, payloads: dict[int, object]) -> pa.RecordBatch:
    data = [squeeze(payload) for payload in payloads.values()]
    return record_batch(_REQUEST, [list(payloads), [name] * len(data), _bytes_column(data)])


def requests(source: DataFrame, ask: Ask) -> DataFrame:
    """What the packs of ``doc_id, raw`` rows ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, docs in packs(batches):
            if payloads := ask(docs):
                yield _request_rows(name, payloads)

    return source.mapInArrow(run, ddl(_REQUEST))


def packed_requests(packed_docs: DataFrame, ask: Ask) -> DataFrame:
    """What packs ask that are already cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, docs in zip(batch.column("pack"), unpacked(pa.Table.from_batches([batch])), strict=True):
                if payloads := ask(docs):
                    yield _request_rows(name.as_py(), payloads)

    return packed_docs.mapInArrow(run, ddl(_REQUEST))


def later_requests(packed_docs: DataFrame, answers: DataFrame, ask: Callable) -> DataFrame:
    """What packs ask once they know earlier answers: ``ask(docs, {bucket: answer})``."""

    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        replies = read_answers(known)
        # Packs of equal name hold equal documents: each counts, so each asks.
        made = []
        for i, docs in enumerate(unpacked(group)):
            name = group.column("pack")[i].as_py()
            made.append(_request_rows(name, ask(docs, replies)))
        empty = record_batch(_REQUEST, [[], [], []])
        return pa.Table.from_batches(made or [empty])

    return packed_docs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, ddl(_REQUEST))


def read_answers(known: pa.Table) -> dict[int, object]:
    return {
        bucket.as_py(): expand(payload.as_py())
        for bucket, payload in zip(known.column("bucket"), known.column("payload"), strict=True)
    }


def answers(asked: DataFrame, decide: Callable[[list[object]], list[object]]) -> DataFrame:
    """Each bucket sees the payloads of all packs together, and answers each."""

    def run(group: pa.Table) -> pa.Table:
        payloads = [expand(payload.as_py()) for payload in group.column("payload")]
        data = [squeeze(answer) for answer in decide(payloads)]
        columns = [group.column("pack"), group.column("bucket"), pa.chunked_array([_bytes_column(data)])]
        return pa.table(columns, names=list(_ANSWER))

    return asked.groupBy("bucket").applyInArrow(run, ddl(_ANSWER))
