"""Removal of repeated byte strings by prefix-free parsing."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from tagweave.llm.repeats import Place, Strings, Units, covered, find_repeats

LENGTH = 100


def byte_units(length: int) -> Units:
    """Triggers are runs of half the length whose rolling hash is the least nearby, so every string of the length holds one."""
    gram = max(1, length // 2)
    return Units(
        length, gram, lambda raw: raw, lambda raw: np.frombuffer(raw, dtype=np.uint8).astype(np.uint64), lambda raw, a, b: raw[a:b]
    )


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position the rank of the ``depth`` bytes from there (positions too near the end have none).

    Prefix doubling as in suffix array construction, up to ``depth``: equal strings have equal ranks.
    """
    reach = min(8, depth)
    ranks = np.zeros(len(text) - reach + 1, dtype=np.uint64)
    for i in range(reach):
        ranks = ranks << np.uint64(8) | text[i : len(text) - reach + 1 + i]
    while True:
        ranks = np.unique(ranks, return_inverse=True)[1].astype(np.uint64)
        if reach == depth:
            return ranks
        step = min(reach, depth - reach)
        ranks = ranks[:-step] << np.uint64(32) | ranks[step:]
        reach += step


def _judge(length: int):
    def decide(payloads: list[Strings]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorts the suffixes of the bucket's dictionary and finds, for each string, what starts earlier in the corpus.

        The dictionary has each distinct string once, with its earliest place. Phrases whose trigger no other string shares
        have a place of their own in the order. The others' suffixes are ranked to the depth of ``length`` bytes.
        """
        first: dict[bytes, Place] = {}
        trigger: dict[bytes, int] = {}
        keys: dict[bytes, Place] = {}
        for asked in payloads:
            for string, place, anchor in zip(asked.strings, asked.places, asked.anchors, strict=True):
                if string not in first or place < first[string]:
                    first[string] = place
                trigger[string] = anchor
            for key, place in zip(asked.keys, asked.key_places, strict=True):
                if key not in keys or place < keys[key]:
                    keys[key] = place
        shared = Counter(trigger.values())
        flags = _repeated_windows([s for s in first if shared[trigger[s]] > 1], first, length)
        out = []
        for asked in payloads:
            own = []
            for string, n, place in zip(asked.strings, asked.n, asked.places, strict=True):
                if place != first[string]:
                    own.append(np.ones(n, dtype=bool))
                else:
                    own.append(flags[string] if string in flags else np.zeros(n, dtype=bool))
            single = [place != keys[key] for key, place in zip(asked.keys, asked.key_places, strict=True)]
            out.append((np.concatenate([np.zeros(0, dtype=bool), *own]), np.array(single, dtype=bool)))
        return out

    return decide


def _repeated_windows(strings: list[bytes], first: dict[bytes, Place], length: int) -> dict[bytes, np.ndarray]:
    """For each string: which of its windows, in its first place, start earlier in a first place of any string."""
    if not strings:
        return {}
    strings = sorted(strings, key=first.__getitem__)
    ranks = suffix_ranks(np.frombuffer(b"".join(strings), dtype=np.uint8), length)
    sizes = np.array([len(s) for s in strings])
    n = sizes - length + 1
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(strings)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rank = ranks[(ends - sizes)[owner] + inside].astype(np.int64)
    # Documents in their order, then starts: strings are sorted by place, so a document has a new number where it changes.
    docs = [first[s][:2] for s in strings]
    number = np.cumsum([0, *(a != b for a, b in zip(docs, docs[1:], strict=False))])
    start = np.array([first[s][2] for s in strings], dtype=np.int64)
    place = (number[owner].astype(np.int64) << 32) + start[owner] + inside
    order = np.lexsort((place, rank))
    new = np.ones(len(order), dtype=bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    earliest = place[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    flags = np.zeros(len(order), dtype=bool)
    flags[order] = place[order] > earliest
    return dict(zip(strings, np.split(flags, np.cumsum(n)[:-1]), strict=True))


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` of each document.

    Texts are UTF-8 bytes. A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in
    a document with a smaller id, or in the same one before. ``removed`` lists the maximal runs as ``[start, end, ...]``,
    ``kept`` has the remaining bytes. Strings do not cross documents and are judged on the input.

    Null and short texts lose nothing. Null ids come before all others; documents of equal id are ordered by a hash of their text, and a
    row that is in the table twice is one document, not its own copy. ``length`` must be at least 16.
    """
    if length < 16:
        raise ValueError("length must be at least 16")

    def finish(raw: bytes | None, ranges: np.ndarray) -> tuple:
        raw = raw or b""
        if not len(ranges):
            return len(raw), [], raw
        gone = covered(ranges, length, len(raw))
        edges = np.nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))[0]
        return len(raw), edges.tolist(), np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()

    fields = {"n_bytes": "long", "removed": "array<long>", "kept": "binary"}
    return find_repeats(docs, byte_units(length), _judge(length), finish, fields, later=True)
