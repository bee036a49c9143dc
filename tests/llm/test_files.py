"""Manifest, token files and fill-in-middle examples against plain versions over whole tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm import fill_in_middle as fim
from tagweave.llm import merkle, queries, wavelet
from tagweave.llm.byte_bpe import ByteBpe
from tagweave.llm.common import importable

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Manifest


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root over some digests, and for each its siblings (left, right) on every level."""
    proofs, places, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for proof, place in zip(proofs, places):
            run = level[place - place % 16 : place - place % 16 + 16]
            proof.append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        places = [place // 16 for place in places]
    return level[0], proofs


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """(order, group, leaf) rows to (order, group, leaf, subroot, root, proof)."""
    groups: dict = {}
    for order, group, leaf in rows:
        groups.setdefault(group, []).append((order is not None, order or 0, leaf, order))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([leaf for _, _, leaf, _ in sorted(groups[g], key=lambda m: m[:3])]) for g in names}
    root, upper = plain_tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper):
        for (_, _, leaf, order), proof in zip(sorted(groups[g], key=lambda m: m[:3]), trees[g][1]):
            out.append((order, g, leaf, trees[g][0], root, proof + above))
    return out


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1, 1], [4096], [4097, 15, 1], [300] * 20, [70_000, 3, 257]])
def test_manifest_equals_plain_trees(spark, sizes):
    importable(spark)
    rows = [
        (None if i == 5 else i // 2, None if g == 1 else f"ü{g % 3}s{g}", sha(f"{g} {i}"))
        for g, size in enumerate(sizes)
        for i in range(size)
    ]
    random.Random(3).shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(5)
    found = merkle.manifest(table, "source", "doc_id", "leaf")
    key = lambda row: (row[1] or "", row[0] is not None, row[0] or 0, row[2])
    got = sorted(
        ((r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in found.collect()), key=key
    )
    assert got == sorted(plain_manifest(rows), key=key)
    if len(rows) < 5000:
        assert found.where(merkle.folded("leaf") != F.col("root")).count() == 0


def test_manifest_of_odd_rows(spark, odd_docs):
    importable(spark)
    digest = merkle.row_digest([F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")])
    rows = odd_docs.withColumns({"leaf": digest, "proof": F.lit(1), "tree": F.lit("x"), "c0": F.lit(2), "root": F.lit(None)})
    found = merkle.manifest(rows, "source", "doc_id", "leaf", carry=["lang", "tree"])
    assert found.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof", "lang", "tree"]
    assert found.count() == 10 and {(r.lang, r.tree) for r in found.collect()} == {("en", "x")}
    assert merkle.manifest(rows.limit(0), "source", "doc_id", "leaf").count() == 0


def test_a_leaf_is_a_digest_of_lengths_and_values(spark):
    row = spark.sql("select 12L a, null b, 'é|' c").select(merkle.row_digest([F.col("a"), F.col("b"), F.col("c")])).first()
    assert row[0] == sha("2:12-3:é|")


def test_tampered_rows_do_not_verify(spark, make_docs, tmp_path):
    texts = ["Upper Case" if i % 2 else "lower case" for i in range(200)] + [None, ""]
    make_docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    for row in queries.op11_merkle(spark, str(tmp_path)).collect():
        changed = zlib.crc32(str(row.doc_id).encode()) % 5 == 0 and (texts[row.doc_id] or "").startswith("Upper")
        assert row.verified == (not changed) == (row.folded_root == row.root)


# Token files


@pytest.mark.parametrize("n,width,top", [(0, 4, 16), (1, 1, 2), (64, 3, 5), (512, 16, 60_000), (5000, 16, 300), (3000, 17, 70_000)])
def test_wavelet_matrix(n, width, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    built = wavelet.WaveletMatrix.build(ids, width)
    matrix = wavelet.WaveletMatrix(n, *built.stored_parts())
    assert matrix.values().tolist() == ids.tolist()
    at = np.random.default_rng(1).integers(0, max(n, 1), 700 if n else 0)
    assert matrix.access(at).tolist() == ids[at].tolist()
    for token in [*set(ids[:20].tolist()), 0, top - 1, 1 << width]:
        assert matrix.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert matrix.count(token) == int((ids == token).sum())
        assert matrix.count(token, n // 3, n // 2) == int((ids[n // 3 : n // 2] == token).sum())


TEXTS = [
    None, "", " ", "  two  blanks \n\n\tand\r\n", "don't we'll I'd '' 's", "x<|endoftext|>y <|endoftext|>", "é ß ñ 漢字 🙂 ԧԨ",
    "a\x1cb\x85c\xa0d　e", "1234 5 ²³ ½", "word " * 300, "!" * 1000, "՘֋ mixed", "Αθήνα Москва", "日本語" * 50,
]


def random_texts(n: int) -> list[str]:
    rnd = random.Random(9)
    letters = ["abcXYZ 0189 '.,!\n\t  éüΩж漢🙂\x1c\x85\xa0", "ab 's.é\n ", "ab  c"]
    return ["".join(rnd.choice(letters[i % 3]) for _ in range(rnd.randrange(60))) for i in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_library(name, monkeypatch):
    library, own = Tokenizer.from_file(public_tokenizers.path(name)), ByteBpe(public_tokenizers.path(name))
    texts = [t or "" for t in TEXTS] + random_texts(1500)
    for _ in range(2):
        for text in texts:
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        expected = [library.encode(text, add_special_tokens=False).ids for text in texts]
        ids, sizes = own.encode_all(texts)
        assert sizes.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
        assert own.encode_all([])[1].tolist() == [] == own.encode_all([""])[0].tolist()
        monkeypatch.setattr("tagweave.llm.byte_bpe.PART", 20)
        monkeypatch.setattr("tagweave.llm.byte_bpe.REMEMBERED", 50)
        monkeypatch.setattr("tagweave.llm.byte_bpe._CALL", 7)
    long = " ".join(texts)
    assert own.encode(long).tolist() == library.encode(long, add_special_tokens=False).ids


def token_rows(library, texts) -> list[list[int]]:
    return [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


@pytest.mark.parametrize("shard_ids", [1, 100, 1 << 20])
def test_token_files(spark, make_docs, shard_ids):
    importable(spark)
    texts = TEXTS + random_texts(60)
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    docs = make_docs([texts[i] for i in order], [i - 7 for i in order]).withColumn("raw", F.lit(1)).withColumn("planes", F.lit(2))
    shards = wavelet.token_files(docs, BYTES, shard_ids=shard_ids)
    shards.persist()
    expected = token_rows(Tokenizer.from_file(BYTES), texts)
    flat = np.array([i for own in expected for i in own])
    starts = np.cumsum([0, *map(len, expected)]).tolist()
    found = sorted(wavelet.documents(shards).collect())
    assert [r.doc_id for r in found] == [i - 7 for i in range(len(texts))]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == expected
    assert [(r.start, r.n_tokens) for r in found] == [(a, len(own)) for a, own in zip(starts, expected)]
    sums = [zlib.crc32(np.array(own, dtype="<u4").tobytes()) for own in expected]
    assert [r.ids_crc32 for r in sorted(wavelet.checksums(shards).collect())] == sums
    tokens = [0, 220, int(flat[30]), 50_000, 70_000]
    assert dict(wavelet.token_counts(shards, tokens).collect()) == {t: int((flat == t).sum()) for t in tokens}
    at = np.flatnonzero(flat == 220)
    where = sorted((r.position, r.doc_id, r.offset) for r in wavelet.token_occurrences(shards, 220).collect())
    doc_of = np.searchsorted(starts, at, side="right") - 1
    assert where == [(int(p), int(d) - 7, int(p - starts[d])) for p, d in zip(at, doc_of)]
    asked = [0, 1, 5, 5, 77, len(flat) - 1, len(flat), -1, None]
    positions = spark.createDataFrame([(p,) for p in asked], "position long")
    assert dict(wavelet.tokens_at(shards, positions).collect()) == {p: int(flat[p]) for p in asked[:6]}
    shards.unpersist()


def test_token_files_of_odd_tables(spark, odd_docs):
    importable(spark)
    found = wavelet.documents(wavelet.token_files(odd_docs, BYTES, shard_ids=500)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(["0", "1", "2", "3", "3", "4", "5", "6", "None", "None"])
    found.sort(key=lambda r: r.start)
    assert [r.doc_id for r in found][:3] == [None, None, 0]
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)]).tolist()[:-1]
    assert wavelet.documents(wavelet.token_files(odd_docs.limit(0), BYTES)).count() == 0


def test_rows_of_one_id_take_several_tasks(spark, make_docs):
    importable(spark)
    texts = [f"text {i}" for i in range(300)]
    shards = wavelet.token_files(make_docs(texts, [4] * 300), BYTES)
    assert shards.select("part_no").distinct().count() > 1
    assert wavelet.documents(shards).count() == 300


# Fill-in-middle


def plain_example(doc_id, text):
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_examples_equal_slices(spark, make_docs):
    importable(spark)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab<PSM>é漢🙂 ") for _ in range(rnd.randrange(40))) for _ in range(300)]
    texts += ["é漢🙂x" * 5000, "a" * 4096, "🙂" * 1024, "<P", "has <M> inside", "", None]
    found = fim.fill_in_middle(make_docs(texts)).withColumn("back", fim.restored()).collect()
    assert len(found) == len(texts) and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        text = texts[r.doc_id] or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_example(r.doc_id, text)
        assert r.back == text


@pytest.mark.parametrize("unit", fim.UNITS)
def test_cuts_equal_a_scan(unit):
    rnd = random.Random(6)
    for _ in range(300):
        text = "".join(rnd.choice("ab é\n漢🙂  ") for _ in range(rnd.randrange(80)))
        raw = text.encode()
        counts = fim.BlockCounts(raw, unit, block=rnd.choice([1, 3, 8, 64]))
        starts = list(range(len(text)))
        if unit == "word":
            blank = " \n\t"
            starts = [i for i in starts if text[i] not in blank and (i == 0 or text[i - 1] in blank)]
            starts = ([0, *starts[1:]] if starts else [0]) if text else []
        assert counts.n_units == len(starts)
        for k in range(len(starts) + 1):
            at = starts[k] if k < len(starts) else len(text)
            assert counts.cut(k) == (len(text[:at].encode()), at)


def test_examples_of_odd_rows(spark, odd_docs):
    importable(spark)
    found = fim.fill_in_middle(odd_docs.withColumn("form", F.lit("psm")).withColumn("output", F.lit("")), unit="word").collect()
    assert len(found) == 10
    by_id = {r.doc_id: r for r in found}
    assert by_id[0].form == by_id[1].form == "plain" and by_id[0].output == "" and by_id[5].n == 40_000
    assert by_id[2].n == 1
    assert fim.fill_in_middle(odd_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(odd_docs, unit="line")
