"""SimHash fingerprints and near duplicates found through Golay code keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import ddl, extend, fresh_name, map_texts, record_batch, stored
from tagweave.llm.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Low bit and width of the three segments of a fingerprint; a narrow one is padded with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: The exact segment and the fuzzy one of each kind of key.
KEY_PAIRS = ((0, 1), (1, 2), (2, 0))
#: Generator polynomial of the binary Golay code of 23 bits.
GENERATOR = 0xAE3

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Keys of 16 bytes that are sent to all executors at most.
FEW = 250_000
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits of a text: each is the majority of that bit over the shingles' hashes.

    Words are split at ASCII white space after lower-casing A-Z. Fewer words than ``shingle``
    are one shingle; a text without words, or null, has fingerprint 0.
    """
    text = raw.translate(_LOWER).split() if raw else []
    if not text:
        return 0
    joined = b" ".join(text)
    ends = np.cumsum(np.fromiter(map(len, text), dtype=np.int64, count=len(text)) + 1)
    starts = (np.concatenate(([0], ends[:-1])))[: max(1, len(text) - shingle + 1)].tolist()
    stops = (ends[min(shingle, len(text)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), _CHUNK):
        part = zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    return map_texts(docs, _signed(shingle), {"fp": "long"})


def _signed(shingle: int):
    return lambda: lambda raw: ((f := fingerprint(raw, shingle)) - (f >> 63 << 64),)


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and the error pattern of each remainder."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    upper = np.array([remainder(m << 11) for m in range(1 << 12)], dtype=np.int64)
    single = [remainder(1 << i) for i in range(23)]
    leader = np.zeros(1 << 11, dtype=np.int64)
    for i in range(23):
        leader[single[i]] = 1 << i
        for j in range(i):
            leader[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                leader[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return upper, leader


def codeword_index(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the code word nearest to each 23-bit value."""
    upper, leader = _golay()
    return (x ^ leader[upper[x >> 11] ^ (x & 0x7FF)]) >> 11


def fuzzy_indices(x: np.ndarray) -> np.ndarray:
    """Indices near each value, one row per value, repeats as -1.

    The code words nearest to the value and to its 23 neighbours: values that differ in at
    most two bits have a neighbour in common, so they share an index. Up to six differ.
    """
    flips = np.array([0, *(1 << i for i in range(23))], dtype=np.int64)
    found = np.sort(codeword_index(x[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of ``fps`` and their keys.

    Of the three segments of two fingerprints with at most two differing bits one is equal
    (pigeonhole), and one of ``KEY_PAIRS`` then has its exact segment equal and at most two bits of its
    fuzzy segment different, so they share a key.
    """
    bits = fps.astype(np.int64).view(np.uint64)
    parts = [((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys = [], []
    for kind, (exact, fuzzy) in enumerate(KEY_PAIRS):
        indices = fuzzy_indices(parts[fuzzy])
        row, column = np.nonzero(indices >= 0)
        rows.append(row)
        keys.append(kind << 40 | parts[exact][row] << 12 | indices[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints (column ``fp``, no repeats) with few differing bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys cover at most two differing bits")
    fields = {"key": "long", "fp": "long"}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            rows, keys = golay_keys(own)
            yield record_batch(fields, [pa.array(keys), pa.array(own[rows])])

    keyed = fps.select("fp").mapInArrow(emit, ddl(fields))
    left = keyed.select("key", F.col("fp").alias("a"))
    right = keyed.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id``: documents in groups of linked fingerprints.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked, and groups are what
    links reach; ``component_id`` is the least document id of the group. Equal fingerprints
    are one node, so copies never become pairs. Null ids are never least (a group of null ids alone
    has a null id); repeated rows are repeated in the result; empty and null texts have fingerprint 0 and form
    a group like any other. An empty table gives no rows.
    """
    return _grouped(stored(fingerprints(docs, shingle), "fingerprints"), max_bits)


def _grouped(marked: DataFrame, max_bits: int) -> DataFrame:
    """``doc_id, fp, component_id`` of stored ``doc_id, fp``."""
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(nodes, max_bits))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    labelled = labelled.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = labelled.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The document with the least id of each group, with all its columns, whatever their names and types.

    Of several rows with that id and fingerprint the one with the least text stays, of equal texts the first one stored. Fingerprints are
    computed once and stored beside the rows; only rows that repeat the id and fingerprint of a group's least document are compared by their texts.
    """
    fp, row, own_id, own_fp, n = (fresh_name(docs, name) for name in ("fp", "row", "kept_id", "kept_fp", "n"))
    marked = extend(docs, _signed(shingle), {fp: "long"}).withColumn(row, F.monotonically_increasing_id())
    marked = stored(marked, "marked")
    groups = _grouped(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp")), max_bits)
    least = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    least = stored(least.groupBy(F.col("doc_id").alias(own_id), F.col("fp").alias(own_fp)).agg(F.count("*").alias(n)), "least")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(fp) == F.col(own_fp))
    once = least.where(F.col(n) == 1).select(own_id, own_fp, F.lit(None).cast("long").alias(n))
    several = least.where(F.col(n) > 1).select(own_id, own_fp)
    m = several.count()
    if m:
        # Which row stays is decided by row numbers; the texts of the others meet no further join.
        again = marked.join(F.broadcast(several) if m <= FEW else several, same)
        place = F.row_number().over(Window.partitionBy(own_id, own_fp).orderBy("text", row))
        again = again.select(own_id, own_fp, "text", row).withColumn(n, place).where(F.col(n) == 1)
        once = once.union(stored(again.select(own_id, own_fp, F.col(row).alias(n)), "first-rows"))
    kept = marked.join(once, same & (F.col(n).isNull() | (F.col(n) == F.col(row))), "left_semi")
    return kept.select(*[F.col(f"`{name}`") for name in docs.columns])
