"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import packs as pk
from tagweave.llm.common import ddl, id_and_text, record_batch, shuffle_partitions

#: Words encoded in one call.
_CALL = 4096

_OUT = {"doc_id": "long", "n_tokens": "long", "ids": "string", "decoded": "string"}

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer for a file, on one thread, kept while a Python worker lives."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        if own.decoder is not None:
            raise ValueError(f"{path} has a decoder, which joining pieces by a space does not apply")
        _tokenizers[path] = own
        _tokenizers[path].no_truncation()
        _tokenizers[path].no_padding()
    return _tokenizers[path]


def word_lists(docs: list[pk.Document], buckets: int) -> dict[int, list[bytes]]:
    """The distinct words of some documents, sorted, by bucket."""
    distinct: set[bytes] = set()
    for _, raw in docs:
        distinct.update((raw or b"").split())
    lists: dict[int, list[bytes]] = {}
    for word in sorted(distinct):
        lists.setdefault(zlib.crc32(word) % buckets, []).append(word)
    return lists


def planes(ids: np.ndarray) -> bytes:
    """Numbers as four rows of bytes, the lowest first: the upper rows compress to nothing."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _encode_words(path: str):
    def encode(asked: list[list[bytes]]) -> list[tuple[bytes, bytes]]:
        """Encodes each distinct word of the bucket once; for each list, how many ids its words have, and the ids."""
        table: dict[bytes, list[int]] = {}
        answers = []
        for words in asked:
            fresh = [word for word in words if word not in table]
            for i in range(0, len(fresh), _CALL):
                part = fresh[i : i + _CALL]
                done = tokenizer(path).encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                table.update(zip(part, (np.array(e.ids, dtype="<u4") for e in done), strict=True))
            found = [table[word] for word in words]
            answers.append((planes(np.array([len(ids) for ids in found])), planes(np.concatenate(found))))
        return answers

    return encode


def _join_pack(path: str, buckets: int):
    def join(group: pa.Table, known: pa.Table) -> pa.Table:
        """Puts ids, and the pieces they stand for, in the places of the words."""
        answers = pk.read_answers(known)
        piece = tokenizer(path).id_to_token
        out = [record_batch(_OUT, [[] for _ in _OUT])]
        for docs in pk.unpacked(group):
            pieces: dict[int, str] = {}
            ids_of: dict[bytes, str] = {}
            text_of: dict[bytes, str] = {}
            for bucket, words in word_lists(docs, buckets).items():
                # A pack that was cut otherwise in the second reading has no answers: its words are encoded here.
                sizes, flat = map(from_planes, answers.get(bucket) or _encode_words(path)([words])[0])
                flat, start = flat.tolist(), 0
                for i in set(flat).difference(pieces):
                    pieces[i] = piece(i)
                for word, size in zip(words, sizes.tolist(), strict=True):
                    own = flat[start : start + size]
                    ids_of[word] = " ".join(map(str, own))
                    text_of[word] = " ".join(map(pieces.__getitem__, own))
                    start += size
            silent = {word for word, own in ids_of.items() if not own}
            columns = ([], [], [], [])
            for doc_id, raw in docs:
                words = (raw or b"").split()
                if silent:
                    words = [word for word in words if word not in silent]
                ids = " ".join(map(ids_of.__getitem__, words))
                columns[0].append(doc_id)
                columns[1].append(ids.count(" ") + 1 if ids else 0)
                columns[2].append(ids)
                columns[3].append(" ".join(map(text_of.__getitem__, words)))
            out.append(record_batch(_OUT, list(columns)))
        return pa.Table.from_batches(out)

    return join


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of each document.

    ``ids`` are decimal ids joined by one space, ``decoded`` is the text the library decodes from them with
    special tokens kept: the pieces, joined by a space. A file with a decoder is refused. ``path`` names a vocabulary file of the
    tokenizers library, on every executor, whose pre-tokenizer drops white space; special strings in a text
    are handled as the library does.

    Documents form packs of some megabytes. Each pack sends its distinct words, in lists by hash, to buckets; a bucket
    encodes each distinct word once and answers every pack; the pack's texts meet the answers and ids are put in place
    by position. A word that a third of all documents hold is one entry per pack, so no bucket is hot. Packs are
    named by their content: a task that runs again asks under the same name. Where packs are cut otherwise in the second reading of the texts, since executors have come
    or gone, they find no answers under their name, and their words are encoded in the task that joins them.

    Null and empty texts have no tokens; null ids and repeated rows are kept, each as a row of its own.
    """
    source = id_and_text(docs)
    buckets = 4 * shuffle_partitions(docs)
    asked = pk.requests(source, lambda own: word_lists(own, buckets))
    answers = pk.answers(asked, _encode_words(path))
    packed = pk.packed(source)
    return packed.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_join_pack(path, buckets), ddl(_OUT))


def id_arrays(encoded: DataFrame) -> DataFrame:
    """``encoded`` with ``ids`` as an array of integers."""
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return encoded.withColumn("ids", ids)
