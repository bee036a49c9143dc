"""Classifiers by their held-out accuracy and against plain formulas; the pipeline stage by stage."""

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import decontamination, language_id, quality, secret_scan, word_table

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x = {label: rng.normal(size=(200, d)) @ rng.normal(size=(d, d)) + 2 * label for label in (0, 1)}
    model = quality.fit({label: (len(v), v.sum(axis=0), v.T @ v) for label, v in x.items()})
    pooled = sum((v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in x.values()) / 400
    logs = []
    points = rng.normal(size=(20, d))
    for v in x.values():
        own = 0.8 * np.cov(v.T, bias=True) + 0.2 * pooled
        own = 0.95 * own + 0.05 * np.trace(own) / d * np.eye(d)
        away = points - v.mean(axis=0)
        logs.append(-0.5 * (away @ np.linalg.inv(own) * away).sum(axis=1) - 0.5 * np.linalg.slogdet(own)[1])
    assert np.allclose(model.scores(points), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))


def test_constant_models():
    assert quality.fit({}) == 0.5
    assert quality.fit({1: (3, np.zeros(12), np.zeros((12, 12)))}) == 1.0
    assert quality.fit({0: (3, np.zeros(12), np.zeros((12, 12)))}) == 0.0


@needs_tables
def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(known[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in known]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) >= 0.95
    flipped = labels.withColumn("quality", labels["quality"] + 5)  # no usable label
    assert {r["score"] for r in quality.score_quality(docs, flipped).collect()} == {0.5}


def test_quality_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 1), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score_quality(odd_docs, labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(odd_docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}


@needs_tables
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = language_id.identify_languages(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = [truth[r["doc_id"]] == r["lang_pred"] for r in held]
    assert len(held) > 150 and np.mean(right) >= 0.97
    accepted = [ok for ok, r in zip(right, held, strict=True) if not r["rejected"]]
    assert len(accepted) > 0.8 * len(held) and np.mean(accepted) >= 0.97


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LEARNED", 10)
    rows = [(i, f"text of number {i}", f"l{i % 40}", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = language_id.sample(docs, 4, 2, 500)
    assert {lang for _, _, lang in found} == {f"l{i}" for i in range(40)} and len(found) < 200


def test_language_odd_rows(odd_docs):
    rows = language_id.identify_languages(odd_docs).collect()
    assert len(rows) == 10
    named = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert named[0] == named[1] == named[2] == "und" and named[3] == named[4] == named[5] == "en"
    assert {r["lang_pred"] for r in rows if r["doc_id"] is None} == {"und"}
    assert language_id.identify_languages(odd_docs.limit(0)).count() == 0


def test_subwords_of_long_texts_are_counted_in_chunks(monkeypatch):
    text = ("Überall wird gesprochen, 12 Wörter! " * 40).encode()
    whole = language_id.subwords(text)
    monkeypatch.setattr(language_id, "_CHUNK", 37)
    assert np.array_equal(whole, language_id.subwords(text)) and whole.sum() > 2000


@needs_tables
def test_pipeline(spark, monkeypatch):
    """Each stage on what the one before kept, against plain versions."""
    import corpus_pipeline
    from .test_near import plain_fingerprint, roots

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    monkeypatch.chdir("/tmp")
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(250)
    stages = dict(corpus_pipeline.STAGES)
    held = lambda df: {r["doc_id"]: r for r in df.collect()}

    good = stages["quality"](spark, rows, SF_DIR).cache()
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 0").collect()}
    kept = held(good)
    assert good.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {r["doc_id"] for r in rows.collect()} - bad
    assert len(kept.keys() & bad) <= 0.1 * len(bad & held(rows).keys()) + 1 and len(clean - kept.keys()) <= 0.1 * len(clean)

    single = stages["near_duplicates"](spark, good, SF_DIR).cache()
    fps = {i: plain_fingerprint(r["text"]) for i, r in kept.items()}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert held(single).keys() == set(roots(fps, pairs).values())
    assert held(single) == {i: kept[i] for i in held(single)}

    fresh = stages["decontamination"](spark, single, SF_DIR).cache()
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    windows = set()
    for item in items:
        own = decontamination.words(item["text"].encode())
        windows |= {own[i : i + 10] for i in range(max(1, len(own) - 9))}
    dirty = set()
    for i, r in held(single).items():
        own = decontamination.words(r["text"].encode())
        if any(own[a : a + n] in windows for n in {len(w) for w in windows} for a in range(len(own) - n + 1)):
            dirty.add(i)
    assert dirty and held(fresh).keys() == held(single).keys() - dirty

    safe = stages["secrets"](spark, fresh, SF_DIR).cache()
    novelty = secret_scan.Novelty(secret_scan.primer(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY)))
    assert held(safe).keys() == held(fresh).keys()
    for i, r in held(safe).items():
        before = held_text = held(fresh)[i]["text"] if i < 60 else None
        if held_text is not None:
            found, _ = secret_scan.spans(before.encode(), novelty)
            assert r["text"] == (secret_scan.redacted(before.encode(), found) if found else before)

    last = stages["encoding"](spark, safe, SF_DIR)
    own = word_table.tokenizer(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY))
    texts = {i: r["text"] for i, r in held(safe).items()}
    for i, r in held(last).items():
        assert r["ids"] == " ".join(map(str, own.encode(texts[i], add_special_tokens=False).ids))
    assert held(last).keys() == texts.keys()


def test_stages_without_rows(spark, odd_docs):
    import corpus_pipeline

    for rows in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF_DIR).cache()
            ids = Counter(r["doc_id"] for r in rows.collect())
            assert ids.total() <= 10 and (name == "encoding" or rows.columns == odd_docs.columns)


def test_stages_keep_columns_of_any_name_and_type(spark, make_docs):
    """Names that the operators use themselves, and a map, which has no order."""
    import corpus_pipeline

    texts = ["the same text of some words"] * 2 + ["another text, which is not like it at all", None, ""]
    docs = make_docs(texts, [7, 7, 9, None, 11])
    names = ["items", "ranges", "n_words", "fp", "own_fp", "kept_id", "row", "own_row", "quality_score", "features", "own_features", "new_text", "n", "c0"]
    docs = docs.withColumns({name: F.lit(i) for i, name in enumerate(names)} | {"extra": F.create_map(F.lit("a"), F.lit(1))})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF_DIR)
        assert rows.columns == docs.columns, name
        for r in rows.collect():
            assert [r[n] for n in names] == list(range(len(names))) and r["extra"] == {"a": 1}
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in rows.collect()) == [7, 9, 11]
