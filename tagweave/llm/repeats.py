"""Exact search for windows of text that occur more than once, through content-defined anchors.

A window holds ``window`` units (bytes or words). Its anchor is the least hash among the ``gram``-unit runs inside it, a
function of its content alone, so equal windows have equal anchors. Consecutive windows with the
same anchor travel as one string. Two rounds of questions go to buckets: how often does an anchor occur; and,
for anchors that occur again, what about these strings. What an operator does with the strings of a bucket is its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tagweave.llm import packs as pk
from tagweave.llm.common import ddl, id_and_text, record_batch, shuffle_partitions, stored

#: Anchors that occur more often are hot: their windows are dealt out one by one, by their own hash.
HOT = 1000
#: Stands for a null id, which comes before all others.
_FIRST_ID = -(1 << 63)
#: Windows hashed at once.
_CHUNK = 1 << 18

#: Place of an occurrence: document id, hash of its text, first unit.
Place = tuple[int, int, int]


@dataclass(frozen=True)
class Units:
    """How a text is a row of units. ``split`` gives the units, ``values`` a number for each, ``cut`` the string of a stretch."""

    window: int
    gram: int
    split: Callable
    values: Callable
    cut: Callable


@dataclass
class Strings:
    """What a pack asks of a bucket. Lists run in parallel; ``n`` counts the windows of a string."""

    anchors: list[int] = field(default_factory=list)
    strings: list[bytes] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    places: list[Place] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    #: Digests of single windows of hot anchors, their first places and how often they occur.
    keys: list[bytes] = field(default_factory=list)
    key_places: list[Place] = field(default_factory=list)
    key_times: list[int] = field(default_factory=list)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Rolling hash of each run of ``gram`` values, by doubling the length of hashed runs."""
    run, length, power = _spread(values + np.uint64(1)), 1, 0xBF58476D1CE4E5B9
    out, done = None, 0
    for bit in bin(gram)[:1:-1]:
        if bit == "1":
            n = len(values) - done - length + 1
            out = run[:n].copy() if out is None else out[:n] * np.uint64(power) + run[done : done + n]
            done += length
        n = len(run) - length
        if done == gram or n <= 0:
            break
        run = run[:n] * np.uint64(power) + run[length:]
        length, power = 2 * length, power * power % (1 << 64)
    return _spread(out)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values."""
    low, reach = values, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    n = len(values) - width + 1
    return np.minimum(low[:n], low[width - reach : width - reach + n])


def anchored_runs(text, units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, first windows and window counts of the runs of a text.

    Of equal least hashes the last counts, so the windows of a run hold the anchor at different places and are
    never equal to each other. Long texts are hashed in chunks of windows; a run ends where a chunk ends.
    """
    for at in range(0, len(text) - units.window + 1, _CHUNK):
        hashes = gram_hashes(units.values(text[at : at + _CHUNK + units.window - 1]), units.gram)
        least = least_of(hashes, units.window - units.gram + 1)
        changes = np.nonzero(least[1:] != least[:-1])[0] + 1
        starts = np.unique(np.concatenate(([0], changes, _entering_ties(hashes, least))))
        counts = np.diff(np.append(starts, len(least)))
        yield least[starts], starts + at, counts


def _entering_ties(hashes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Windows in which another gram with the anchor's hash comes in: a new run starts although the hash is the same."""
    width = len(hashes) - len(least) + 1
    edge = np.zeros(width - 1, dtype=np.uint64)
    # A gram is an anchor if it equals the greatest of the leasts of the windows that hold it.
    greatest = ~least_of(~np.concatenate((edge, least, edge)), width)
    anchors = np.nonzero(hashes == greatest)[0]
    same = (hashes[anchors[1:]] == hashes[anchors[:-1]]) & (np.diff(anchors) <= width)
    entering = anchors[1:][same] - (width - 1)
    return entering[(entering > 0) & (entering < len(least))]


def _text_tie(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw)


def _ordered(docs: list[pk.Document]) -> list[tuple[int, int, bytes]]:
    """Documents with text in the order in which places count as earlier; null ids come first."""
    return sorted((_FIRST_ID if doc_id is None else doc_id, _text_tie(raw), raw) for doc_id, raw in docs if raw)


def _ask_anchors(units: Units, buckets: int):
    def ask(docs: list[pk.Document]) -> dict[int, object]:
        found = [
            anchors
            for _, raw in docs
            if raw
            for anchors, _, _ in anchored_runs(units.split(raw), units)
        ]
        if not found:
            return {}
        anchors, times = np.unique(np.concatenate(found), return_counts=True)
        bucket = anchors % np.uint64(buckets)
        return {int(b): (anchors[own := bucket == b], times[own]) for b in np.unique(bucket)}

    return ask


def _decide_anchors(payloads: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The repeated anchors of each payload, and which of these are hot."""
    anchors = np.concatenate([a for a, _ in payloads])
    distinct, inverse = np.unique(anchors, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([t for _, t in payloads]), minlength=len(distinct))
    out, at = [], 0
    for own, _ in payloads:
        times = total[inverse[at : at + len(own)]]
        at += len(own)
        repeated = times > 1
        out.append((own[repeated], times[repeated] > HOT))
    return out


@dataclass
class PackPlan:
    """What a pack asks in the second round, and where the answers belong; made again, equal, when they are in."""

    requests: dict[int, Strings]
    #: For each text (by id and tie): first window, windows, bucket, entry, entry's kind, and whether the place is the asked one.
    runs: dict[tuple[int, int], list[tuple[int, int, int, int, bool, bool]]]
    _ends: dict[int, list[int]] = field(default_factory=dict)

    def ends(self, bucket: int) -> list[int]:
        """Where the flags of each string of a bucket end."""
        if bucket not in self._ends:
            self._ends[bucket] = list(accumulate(self.requests[bucket].n))
        return self._ends[bucket]


def plan_pack(docs: list[pk.Document], known: dict[int, tuple[np.ndarray, np.ndarray]], units: Units, buckets: int) -> PackPlan:
    plan = PackPlan({}, {})
    if not known:
        if _ask_anchors(units, buckets)(docs):
            raise RuntimeError("a pack has asked about its anchors and found no answers")
        return plan
    repeated = np.concatenate([anchors for anchors, _ in known.values()])
    hot = np.concatenate([flags for _, flags in known.values()])
    order = np.argsort(repeated)
    repeated, hot = repeated[order], hot[order]
    if not len(repeated):
        return plan
    entries: dict[bytes, tuple[int, int]] = {}
    single: dict[bytes, tuple[int, int]] = {}
    for doc_id, tie, raw in _ordered(docs):
        text = units.split(raw)
        again = (doc_id, tie) in plan.runs
        runs = [] if again else plan.runs.setdefault((doc_id, tie), [])
        for anchors, starts, counts in anchored_runs(text, units):
            at = np.minimum(np.searchsorted(repeated, anchors), len(repeated) - 1)
            of_interest = np.nonzero(repeated[at] == anchors)[0]
            for i in of_interest.tolist():
                start, n, anchor = int(starts[i]), int(counts[i]), int(anchors[i])
                if hot[at[i]]:
                    for k in range(start, start + n):
                        key = xxhash.xxh3_128_digest(units.cut(text, k, k + units.window))
                        place = single.get(key)
                        if first := place is None:
                            bucket = int.from_bytes(key[:4], "little") % buckets
                            asked = plan.requests.setdefault(bucket, Strings())
                            place = single[key] = (bucket, len(asked.keys))
                            asked.keys.append(key)
                            asked.key_places.append((doc_id, tie, k))
                            asked.key_times.append(1)
                        else:
                            plan.requests[place[0]].key_times[place[1]] += 1
                        runs.append((k, 1, *place, True, first))
                    continue
                string = units.cut(text, start, start + n - 1 + units.window)
                place = entries.get(string)
                if first := place is None:
                    bucket = anchor % buckets
                    asked = plan.requests.setdefault(bucket, Strings())
                    place = entries[string] = (bucket, len(asked.strings))
                    asked.anchors.append(anchor)
                    asked.strings.append(string)
                    asked.n.append(n)
                    asked.places.append((doc_id, tie, start))
                    asked.times.append(1)
                else:
                    plan.requests[place[0]].times[place[1]] += 1
                runs.append((start, n, *place, False, first))
    return plan


def repeated_ranges(plan: PackPlan, flags: dict[int, Flags], doc_id: int | None, raw: bytes | None, later: bool) -> np.ndarray:
    """Ranges ``[first, end)`` of repeated windows of a document, from the flags of all buckets; ``later`` as in ``find_repeats``."""
    key = (_FIRST_ID if doc_id is None else doc_id, _text_tie(raw or b""))
    ranges: list[tuple[int, int]] = []
    for start, n, bucket, entry, single, asked_here in plan.runs.get(key, ()):
        if later and not asked_here:
            ranges.append((start, start + n))
        elif single:
            if flags[bucket].keys[entry]:
                ranges.append((start, start + 1))
        else:
            end = plan.ends(bucket)[entry]
            repeated = flags[bucket].before[end] - flags[bucket].before[end - n]
            if repeated == n:
                ranges.append((start, start + n))
            elif repeated:
                own = np.nonzero(flags[bucket].windows[end - n : end])[0] + start
                ranges += zip(own.tolist(), (own + 1).tolist(), strict=True)
    return np.array(ranges, dtype=np.int64).reshape(-1, 2)


class Flags:
    """A bucket's answer: flags of windows, how many are set before each place, and flags of keys."""

    def __init__(self, windows: np.ndarray, keys: np.ndarray):
        self.windows = windows
        self.before = [0, *np.cumsum(windows, dtype=np.int64).tolist()]
        self.keys = keys.tolist()


#: For the payloads of a bucket: for each, the flags of all windows of its strings, one after another, and of its keys.
Decide = Callable[[list[Strings]], list[tuple[np.ndarray, np.ndarray]]]


def find_repeats(
    docs: DataFrame, units: Units, decide: Decide, finish: Callable, fields: dict[str, str], later: bool
) -> DataFrame:
    """``finish(raw, ranges)`` for each document, where ``ranges`` are those of its repeated windows.

    ``later`` says that a window in a further place of its pack is repeated whatever the answer is.
    """
    buckets = 4 * shuffle_partitions(docs)
    # Cut once: a second reading of the source may begin its packs elsewhere, where executors have come or gone.
    packed = stored(pk.packed(id_and_text(docs)), "packs", **pk.STORE)
    asked = pk.packed_requests(packed, _ask_anchors(units, buckets))
    anchors = stored(pk.answers(asked, _decide_anchors), "anchors")
    second = pk.later_requests(packed, anchors, lambda own, known: plan_pack(own, known, units, buckets).requests)

    def answer(payloads: list[Strings]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.packbits(a), np.packbits(b)) for a, b in decide(payloads)]

    replies = pk.answers(second, answer)
    # Both rounds' answers meet the texts under one name; buckets of the second round are told apart by their sign.
    shifted = replies.selectExpr("pack", "-1 - bucket as bucket", "payload")
    out = {"doc_id": "long", **fields}

    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        read = pk.read_answers(known)
        first = {bucket: reply for bucket, reply in read.items() if bucket >= 0}
        flags = {-1 - bucket: Flags(np.unpackbits(a), np.unpackbits(b)) for bucket, (a, b) in read.items() if bucket < 0}
        made = [record_batch(out, [[] for _ in out])]
        for own in pk.unpacked(group):
            plan = plan_pack(own, first, units, buckets)
            rows = []
            for doc_id, raw in own:
                rows.append(finish(raw, repeated_ranges(plan, flags, doc_id, raw, later)))
            if rows:
                columns = (list(column) for column in zip(*rows, strict=True))
                made.append(record_batch(out, [[doc_id for doc_id, _ in own], *columns]))
        return pa.Table.from_batches(made)

    both = anchors.union(shifted)
    return packed.groupBy("pack").cogroup(both.groupBy("pack")).applyInArrow(run, ddl(out))


def covered(ranges: np.ndarray, window: int, size: int) -> np.ndarray:
    """Which of ``size`` units lie in a window of one of the ranges."""
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, ranges[:, 0], 1)
    np.add.at(change, ranges[:, 1] - 1 + window, -1)
    return np.cumsum(change[:size]) > 0
