"""Byte and passage dedup against plain versions over all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tagweave.llm import byte_dedup, packs, repeats, substring_dedup


def plain_bytes(docs, length):
    """``docs``: (id, bytes) in order of ids."""
    seen, out = set(), {}
    for doc_id, raw in sorted(docs):
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        out[doc_id] = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
    return out


def plain_words(docs, window):
    count = Counter(
        tuple(words[i : i + window]) for _, raw in docs for words in [raw.split()] for i in range(len(words) - window + 1)
    )
    out = {}
    for doc_id, raw in docs:
        words = raw.split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if count[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[doc_id] = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
    return out


@pytest.fixture(params=[(8 << 20, 1000), (2000, 1000), (2000, 3)], ids=["one pack", "many packs", "hot anchors"])
def sizes(request, monkeypatch):
    """Pack size and bound of hot anchors; both are read where packs are made or decided."""
    monkeypatch.setattr(packs, "PACK_BYTES", request.param[0])
    monkeypatch.setattr(repeats, "HOT", request.param[1])
    return request.param


@pytest.mark.parametrize("length", [100, 33])
def test_bytes_against_all_windows(sizes, corpus, length):
    docs = [(i, t.encode()) for i, t in enumerate(corpus)]
    units = byte_dedup.byte_units(length)
    got = in_process(docs, units, byte_dedup._judge(length), True)
    expected = plain_bytes(docs, length)
    for doc_id, raw in docs:
        gone = repeats.covered(got[doc_id], length, len(raw))
        assert np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes() == expected[doc_id]


@pytest.mark.parametrize("window", [35, 5])
def test_words_against_all_windows(sizes, corpus, window):
    docs = [(i, t.encode()) for i, t in enumerate(corpus)]
    got = in_process(docs, substring_dedup.word_units(window), substring_dedup._count_windows(window), False)
    expected = plain_words(docs, window)
    for doc_id, raw in docs:
        words = raw.split()
        gone = repeats.covered(got[doc_id], window, len(words))
        assert b" ".join(w for w, g in zip(words, gone, strict=True) if not g) == expected[doc_id]


def in_process(docs, units, decide, later, buckets=5):
    """The rounds of ``find_repeats`` without Spark: packs by size, answers by bucket."""
    split, own, size = [], [], 0
    for doc in docs:
        if own and size + len(doc[1]) > packs.PACK_BYTES:
            split, own, size = [*split, own], [], 0
        own.append(doc)
        size += len(doc[1])
    split.append(own)

    def round_of(asked, decided):
        answers = [{} for _ in asked]
        for b in range(buckets):
            which = [i for i, a in enumerate(asked) if b in a]
            for i, answer in zip(which, decided([asked[i][b] for i in which]) if which else [], strict=True):
                answers[i][b] = answer
        return answers

    known = round_of([repeats._ask_anchors(units, buckets)(p) for p in split], repeats._decide_anchors)
    plans = [repeats.plan_pack(p, k, units, buckets) for p, k in zip(split, known, strict=True)]
    decided = round_of([plan.requests for plan in plans], decide)
    flags = [{b: repeats.Flags(*answer) for b, answer in own.items()} for own in decided]
    return {
        doc_id: repeats.repeated_ranges(plan, answer, doc_id, raw, later)
        for own, plan, answer in zip(split, plans, flags, strict=True)
        for doc_id, raw in own
    }


def test_spark_form_of_bytes(spark, make_docs, corpus):
    rows = byte_dedup.remove_repeated_bytes(make_docs(corpus)).collect()
    expected = plain_bytes([(i, t.encode()) for i, t in enumerate(corpus)], 100)
    assert {r["doc_id"]: bytes(r["kept"]) for r in rows} == expected
    for r in rows:
        removed = sum(b - a for a, b in zip(r["removed"][::2], r["removed"][1::2], strict=True))
        assert r["n_bytes"] - removed == len(r["kept"])


def test_spark_form_of_words(spark, make_docs, corpus):
    rows = substring_dedup.remove_repeated_passages(make_docs(corpus)).collect()
    expected = plain_words([(i, t.encode()) for i, t in enumerate(corpus)], 35)
    assert {r["doc_id"]: r["kept"].encode() for r in rows} == expected


@pytest.mark.parametrize("remove", [byte_dedup.remove_repeated_bytes, substring_dedup.remove_repeated_passages])
def test_splits_that_change_between_two_actions(spark, make_docs, corpus, tmp_path, monkeypatch, remove):
    def files(n):
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", str(n))

    def stored_then_split(*args, stored=repeats.stored, **options):
        out = stored(*args, **options)
        files(1000)
        return out

    make_docs(corpus).repartition(6).write.parquet(f"{tmp_path}/docs")
    expected = {r["doc_id"]: r["kept"] for r in remove(make_docs(corpus)).collect()}
    monkeypatch.setattr(repeats, "stored", stored_then_split)
    try:
        files(1)
        docs = spark.read.parquet(f"{tmp_path}/docs")
        assert docs.rdd.getNumPartitions() == 1
        assert {r["doc_id"]: r["kept"] for r in remove(docs).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_missing_answers_are_an_error():
    units = byte_dedup.byte_units(100)
    assert repeats.plan_pack([(1, b"short"), (2, None)], {}, units, 5).requests == {}
    with pytest.raises(RuntimeError):
        repeats.plan_pack([(1, b"long enough " * 20)], {}, units, 5)


@pytest.mark.parametrize("remove", [byte_dedup.remove_repeated_bytes, substring_dedup.remove_repeated_passages])
def test_odd_rows(odd_docs, remove):
    rows = remove(odd_docs).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [0, 1, 2, 3, 3, 4, 5, 6]
    assert sum(r["doc_id"] is None for r in rows) == 2
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert len(kept[0]) == len(kept[1]) == 0
    assert remove(odd_docs.limit(0)).count() == 0
    if remove is byte_dedup.remove_repeated_bytes:  # 50,000 times x: all but the first 100 bytes start earlier
        assert bytes(kept[6]) == b"x" * 1 or len(kept[6]) == 1
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_a_row_twice_is_its_own_copy_for_words_only(make_docs):
    text = " ".join(f"w{i}" for i in range(50))
    twice = make_docs([text, text], [7, 7])
    assert {r["kept"] for r in substring_dedup.remove_repeated_passages(twice).collect()} == {""}
    assert {bytes(r["kept"]) for r in byte_dedup.remove_repeated_bytes(twice).collect()} == {text.encode()}


def test_suffix_ranks():
    data = np.frombuffer(b"abcabcabcabcabcabcabcabdabc", dtype=np.uint8)
    for depth in (3, 8, 11, 16):
        ranks = byte_dedup.suffix_ranks(data, depth).tolist()
        strings = [data[i : i + depth].tobytes() for i in range(len(data) - depth + 1)]
        order = sorted(set(strings))
        assert ranks == [order.index(s) for s in strings]
