"""Removal of repeated passages of words: super-k-mers dealt out by minimiser."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tagweave.llm.repeats import Strings, Units, covered, find_repeats

WINDOW = 35
#: Words in the k-mers of which the least hash is a window's minimiser.
MINIMISER = 8


def _values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def word_units(window: int) -> Units:
    gram = min(MINIMISER, window)
    return Units(window, gram, bytes.split, _values, lambda words, a, b: b" ".join(words[a:b]))


def windows_of(string: bytes, window: int) -> list[bytes]:
    """The windows packed in a super-k-mer."""
    data = np.frombuffer(string, dtype=np.uint8)
    ends = np.append(np.nonzero(data == 32)[0], len(data)).tolist()
    starts = [0, *(end + 1 for end in ends[:-1])]
    return [string[a:b] for a, b in zip(starts, ends[window - 1 :], strict=False)]


def _count_windows(window: int):
    def decide(payloads: list[Strings]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorts the windows of the bucket and counts equal ones; each super-k-mer is unpacked once, with a weight."""
        times: Counter[bytes] = Counter()
        minimiser: dict[bytes, int] = {}
        keys: Counter[bytes] = Counter()
        for asked in payloads:
            for string, t, m in zip(asked.strings, asked.times, asked.anchors, strict=True):
                times[string] += t
                minimiser[string] = m
            for key, t in zip(asked.keys, asked.key_times, strict=True):
                keys[key] += t
        groups: dict[int, list[bytes]] = defaultdict(list)
        for string, m in minimiser.items():
            groups[m].append(string)
        flags: dict[bytes, np.ndarray] = {}
        for group in groups.values():
            if len(group) == 1:
                continue  # its windows occur as often as it does
            rows = sorted(
                (own, times[string], i, k)
                for i, string in enumerate(group)
                for k, own in enumerate(windows_of(string, window))
            )
            marks = {i: [] for i in range(len(group))}
            at = 0
            while at < len(rows):
                end, total = at, 0
                while end < len(rows) and rows[end][0] == rows[at][0]:
                    total += rows[end][1]
                    end += 1
                if total > 1:
                    for _, _, i, k in rows[at:end]:
                        marks[i].append(k)
                at = end
            for i, string in enumerate(group):
                flags[string] = np.zeros(len(windows_of(string, window)), dtype=bool)
                flags[string][marks[i]] = True
        out = []
        for asked in payloads:
            own = [
                flags[s] if s in flags else np.full(n, times[s] > 1)
                for s, n in zip(asked.strings, asked.n, strict=True)
            ]
            out.append((np.concatenate([np.zeros(0, dtype=bool), *own]), np.array([keys[k] > 1 for k in asked.keys], dtype=bool)))
        return out

    return decide


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, removed, kept`` of each document.

    Words are what ASCII white space separates, unchanged. A word is removed if it lies in a window of ``window`` consecutive
    words of one document whose words also start anywhere else, in the same document or another one; all copies go.
    ``removed`` lists the positions as ``[start, end, ...]``, ``kept`` has the other words, joined by a space.

    Null texts, empty ones and those of fewer words than a window lose nothing. Each row is a document, so a row that is in the table twice is its own copy;
    null ids are kept. Windows are judged on the input.
    """

    def finish(raw: bytes | None, ranges: np.ndarray) -> tuple:
        words = (raw or b"").split()
        if not len(ranges):
            return len(words), [], b" ".join(words).decode()
        gone = covered(ranges, window, len(words))
        edges = np.nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))[0]
        kept = [words[i] for i in np.nonzero(~gone)[0].tolist()]
        return len(words), edges.tolist(), b" ".join(kept).decode()

    fields = {"n_words": "long", "removed": "array<long>", "kept": "string"}
    return find_repeats(docs, word_units(window), _count_windows(window), finish, fields, later=False)
