"""Near duplicates and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagweave.llm import cover_tree, simhash
from tagweave.llm.components import connected_components


def roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)] + [(9, 9), (9999, 9999)]
    table = spark.createDataFrame([*edges, (None, 5), (5, None)], "x long, y long")
    expected = roots({n for e in edges for n in e}, edges)
    assert {r["node"]: r["root"] for r in connected_components(table).collect()} == expected
    assert connected_components(table.limit(0)).count() == 0


def plain_fingerprint(text, n=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(corpus):
    for text in [*corpus, "", None, "a", "A b", "É b c"]:
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_golay_keys_meet():
    rng = np.random.default_rng(0)
    fps = rng.integers(-(2**63), 2**63 - 1, 3000)
    own = {}
    for row, key in zip(*simhash.golay_keys(fps), strict=True):
        own.setdefault(row, set()).add(key)
    assert max(map(len, own.values())) <= 18
    for bits in (1, 2):
        near = fps.view(np.uint64).copy()
        for i in range(len(near)):
            for b in rng.choice(64, bits, replace=False):
                near[i] ^= np.uint64(1) << np.uint64(b)
        met = {row for row, key in zip(*simhash.golay_keys(near.view(np.int64)), strict=True) if key in own[row]}
        assert len(met) == len(fps)


def test_every_pair_of_flips_meets():
    fps = np.array([0x0123456789ABCDEF, 0, -1], dtype=np.int64)
    for fp in fps:
        keys = set(simhash.golay_keys(np.array([fp]))[1].tolist())
        for a in range(64):
            for b in range(64):
                other = np.array([fp]).view(np.uint64) ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))
                assert keys & set(simhash.golay_keys(other.view(np.int64))[1].tolist())


def test_groups(make_docs, corpus):
    texts = [*corpus, None, "", corpus[2]]
    fps = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    expected = roots(range(len(fps)), pairs)
    rows = simhash.simhash_groups(make_docs(texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in rows} == dict(enumerate(fps))
    kept = simhash.one_of_each_group(make_docs(texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(expected.values()))
    assert all(r["text"] == texts[r["doc_id"]] for r in kept)


def test_simhash_odd_rows(odd_docs):
    rows = simhash.simhash_groups(odd_docs).collect()
    group = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == 10 and group[0] == group[1] == group[2] == 0 and group[3] == 3
    assert simhash.simhash_groups(odd_docs.limit(0)).count() == 0
    kept = simhash.one_of_each_group(odd_docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert sum(r["doc_id"] == 3 for r in kept) == 1
    with pytest.raises(ValueError):
        simhash.fingerprint_links(odd_docs.selectExpr("doc_id as fp"), 3)


def plain_links(vectors, cosine=0.93):
    unit = {}
    for i, label, v in vectors:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = (label, np.array(v, dtype=float) / np.linalg.norm(v))
    return [
        (a, b) for a in unit for b in unit
        if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= cosine
    ]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    out = []
    for _ in range(12):
        centre, spread = rng.normal(size=8), rng.choice([0.02, 0.1, 0.3])
        out += [centre + spread * rng.normal(size=8) for _ in range(15)]
    rows = [(i, int(rng.integers(3)), [float(x) for x in np.float32(v)]) for i, v in enumerate(out)]
    rows += [(1000, 1, rows[0][2]), (1001, rows[0][1], rows[0][2]), (1002, rows[0][1], [2 * x for x in rows[0][2]])]
    rows += [(2000, 1, None), (2001, 1, [0.0] * 8), (2002, 1, [1.0, None] + [0.0] * 6), (2003, None, rows[0][2])]
    rows += [(2004, 1, [float("nan")] * 8), (2005, 1, [float("inf")] + [1.0] * 7), (2006, 1, []), (2007, 1, [1.0, 2.0]), (2008, 1, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("block, pivots", [(2048, 64), (4, 8)])
def test_embedding_links(spark, vectors, monkeypatch, block, pivots):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "PIVOTS", pivots)
    table = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").repartition(3)
    rows = cover_tree.embedding_links(table).collect()
    pairs = plain_links(vectors)
    expected = roots([v[0] for v in vectors], pairs)
    degree = {v[0]: sum(v[0] in p for p in pairs) for v in vectors}
    assert len(pairs) > 100
    assert {r["vec_id"]: r["component_id"] for r in rows} == expected
    assert {r["vec_id"]: r["n_links"] for r in rows} == degree


@pytest.mark.parametrize("levels, dealt", [(24, 5), (1, 16_384), (0, 16_384)])
def test_embedding_links_in_cells_of_all_kinds(spark, vectors, monkeypatch, levels, dealt):
    """Many levels with cells dealt in parts, and cells that the levels do not divide far enough."""
    for name, value in (("BLOCK", 3), ("PIVOTS", 3), ("LEVELS", levels), ("DEALT", dealt)):
        monkeypatch.setattr(cover_tree, name, value)
    table = spark.createDataFrame(vectors[:90], "vec_id long, label int, embedding array<float>")
    pairs = plain_links(vectors[:90])
    degree = {v[0]: sum(v[0] in p for p in pairs) for v in vectors[:90]}
    assert {r["vec_id"]: r["n_links"] for r in cover_tree.embedding_links(table).collect()} == degree


def test_copies_of_clustered_vectors_grow_with_their_number(spark, monkeypatch):
    """Twice the clusters, twice the vectors of one label: the rows sent to pairs of blocks grow by 2.5 at most."""
    monkeypatch.setattr(cover_tree, "BLOCK", 32)
    rng = np.random.default_rng(3)
    copies = []
    for clusters in (10, 20):
        rows = []
        for _ in range(clusters):
            centre = rng.normal(size=24)
            rows += [(len(rows) + i, 1, (centre + 0.02 * rng.normal(size=24)).tolist()) for i in range(120)]
        units = cover_tree._unit_rows(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
        classes = units.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
        classes = cover_tree.stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        copies.append(cover_tree._sides(classes, 0.93).count())
    assert copies[1] <= 2.5 * copies[0], copies


def test_embeddings_empty_and_repeated(spark, vectors):
    table = spark.createDataFrame(vectors[:5] + vectors[:5], "vec_id long, label int, embedding array<float>")
    rows = cover_tree.embedding_links(table).collect()
    assert len(rows) == 10 and min(r["n_links"] for r in rows) >= 1
    assert cover_tree.embedding_links(table.limit(0)).count() == 0


@pytest.mark.parametrize("n, d, spread", [(300, 3, 0.2), (300, 16, 0.05), (50, 2, 0.0), (1, 4, 0.1), (200, 64, 3.0)])
def test_dual_traversal_finds_every_pair(n, d, spread):
    rng = np.random.default_rng(n + d)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(12, size=n)] + spread * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = cover_tree.CoverTree(x)
    for node, rows in enumerate(tree.rows):
        assert cover_tree._distances(x[[tree.centre[node]]], x[rows]).max() <= tree.radius[node] + 1e-7
        if len(tree.children[node]):
            assert sorted(r for c in tree.children[node] for r in tree.rows[c]) == sorted(rows)
    for cosine in (0.5, 0.93):
        near = x @ x.T >= cosine
        found = {tuple(sorted(p)) for a, b in cover_tree.linked_pairs(tree, tree, cosine) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert found == {(i, j) for i in range(n) for j in range(i + 1, n) if near[i, j]}
        other = cover_tree.CoverTree(x[: n // 2 + 1])
        count = sum(len(a) for a, _ in cover_tree.linked_pairs(tree, other, cosine))
        assert count == (x @ other.x.T >= cosine).sum()
