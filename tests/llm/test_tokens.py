"""Token counts, encoding and decoding against the tokenizers library."""

import random
import re
import tracemalloc

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from tagweave.llm import token_counts, word_table

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(2)
    letters = "abcdefghinorst'é́ÀſKİΣς1２½   \x1c\x85<|>/w!?.漢字🙂‍ ñßǅ\n\t"
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(400)]
    return out + ["<|endoftext|> a<|startoftext|>b</w> x</w>", "don't I'LL we've 'S", "a" * 3000, "</w>", "International law"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_prefix_of_a_word():
    own = token_counts.PrefixCounter(PATH)
    for word in ("international", "thereandthere", "xylophonically", "zzzzzzz"):
        assert own.piece_counts(word) == [len(ids(word[:k])) for k in range(1, len(word) + 1)]


def test_counts_are_the_librarys():
    own = token_counts.PrefixCounter(PATH)
    for text in texts():
        assert own.measure(text.encode(), [10])[1] == len(ids(text)), text


def test_full_tables_start_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 20)
    own = token_counts.PrefixCounter(PATH)
    for text in texts()[:200]:
        assert own.measure(text.encode(), [10])[1] == len(ids(text))


@pytest.mark.parametrize("unit", ["a", "!", "漢", "thequickbrownfox"])
def test_a_very_long_piece_takes_memory_in_proportion(unit):
    own = token_counts.PrefixCounter(PATH)
    for n in (60, 70, 1500):
        text = (unit * n)[:n]
        assert own.measure(text.encode(), [10])[1] == len(ids(text))
    own = token_counts.PrefixCounter(PATH)
    tracemalloc.start()
    text = (unit * 30_000)[:30_000]
    assert own.measure(text.encode(), [10])[1] == len(ids(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    assert sum(map(len, own.prefixes)) + sum(map(len, own.words)) < 100_000


@pytest.mark.parametrize("unit", ["a", "!"])
def test_a_million_characters(unit):
    text = unit * 1_000_000
    assert token_counts.PrefixCounter(PATH).measure(text.encode(), [10])[:2] == (len(text), len(ids(text)))


def prefix_ends(text):
    """Where a prefix may end: in white space, and between the grapheme clusters of words and of what special strings leave of them."""
    ends = {0, len(text)}
    for word in re.finditer(r"[^\x20\x09-\x0D]+", text):
        at = word.start()
        for part in re.split(r"(<\|startoftext\|>|<\|endoftext\|>)", word[0]):
            units = list(part) if part.startswith("<|") and part.endswith("|>") else regex.findall(r"\X", part)
            for unit in units:
                ends.add(at)
                at += len(unit)
        ends.add(at)
    white = {m.start() + i for m in re.finditer(r"[\x20\x09-\x0D]+", text) for i in range(len(m[0]) + 1)}
    return sorted(ends | white)


def longest_fit(text, budget):
    return max((k, len(ids(text[:k]))) for k in prefix_ends(text) if len(ids(text[:k])) <= max(0, budget))


def test_longest_fitting_prefix():
    own = token_counts.PrefixCounter(PATH)
    rnd = random.Random(8)
    some = [*texts()[:150], "one two  three\nfour five", "  international!!law don't<|endoftext|>we'll ", "supercalifragilistic" * 4, "漢字漢字漢字" * 4]
    for text in some:
        total = len(ids(text))
        budgets = sorted({0, 1, 2, total - 1, total, total + 1, *(rnd.randrange(total + 1) for _ in range(4))})
        fits = own.measure(text.encode(), budgets)[2]
        for budget, (size, tokens) in zip(budgets, fits):
            end, expected = longest_fit(text, budget)
            assert (size, tokens) == (len(text[:end].encode()), expected), (text, budget)


def test_a_text_without_white_space_is_cut_inside():
    own = token_counts.PrefixCounter(PATH)
    for unit in ("thequickbrownfox", "漢字", "!?x1"):
        text = unit * 3000
        (size, tokens), = own.measure(text.encode(), [2048])[2]
        prefix = text.encode()[:size].decode()
        assert tokens == len(ids(prefix)) <= 2048 < len(ids(text[: len(prefix) + 1])) and size > 2048


def test_budgets(spark, make_docs, odd_docs):
    rows = texts()[:40]
    found = token_counts.fit_budgets(make_docs(rows), PATH, [5, 0, 3, 5]).collect()
    assert len(found) == 3 * len(rows)
    for r in found:
        end, tokens = longest_fit(rows[r["doc_id"]], r["budget"])
        assert (r["fit_bytes"], r["fit_tokens"]) == (len(rows[r["doc_id"]][:end].encode()), tokens)
    odd = token_counts.fit_budgets(odd_docs, PATH, [-1, 2048]).collect()
    assert len(odd) == 20 and all(r["fit_tokens"] <= max(0, r["budget"]) for r in odd)
    assert token_counts.fit_budgets(odd_docs, PATH, []).count() == 0 == token_counts.fit_budgets(odd_docs.limit(0), PATH, [1]).count()



def test_spark_forms(make_docs):
    docs = make_docs(texts())
    counted = {r["doc_id"]: r for r in token_counts.count_tokens(docs, PATH).collect()}
    encoded = {r["doc_id"]: r for r in word_table.encode(docs, PATH).collect()}
    for i, text in enumerate(texts()):
        expected = ids(text)
        assert counted[i]["n_tokens"] == encoded[i]["n_tokens"] == len(expected)
        assert counted[i]["n_bytes"] == len(text.encode())
        assert encoded[i]["ids"] == " ".join(map(str, expected))
        assert encoded[i]["decoded"] == LIBRARY.decode(expected, skip_special_tokens=False)
    arrays = {r["doc_id"]: r["ids"] for r in word_table.id_arrays(word_table.encode(docs, PATH)).collect()}
    assert all(arrays[i] == ids(text) for i, text in enumerate(texts()))


@pytest.mark.parametrize("count", [token_counts.count_tokens, word_table.encode])
def test_odd_rows(odd_docs, count):
    rows = count(odd_docs, PATH).collect()
    assert len(rows) == 10 and sum(r["doc_id"] is None for r in rows) == 2
    tokens = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert tokens[0] == tokens[1] == tokens[2] == 0 and tokens[3] == 1
    assert tokens[6] == len(ids("x" * 50_000))
    assert count(odd_docs.limit(0), PATH).count() == 0


def test_packs_without_answers_encode_their_words(make_docs, monkeypatch):
    """As if the packs of the second reading had been cut otherwise: no answer comes under their names."""
    rows = texts()[:60]
    monkeypatch.setattr(word_table.pk, "answers", lambda asked, decide: asked.selectExpr("pack", "bucket", "payload").where("bucket < 0"))
    for r in word_table.encode(make_docs(rows), PATH).collect():
        assert r["ids"] == " ".join(map(str, ids(rows[r["doc_id"]])))


def test_planes():
    import numpy as np

    values = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert word_table.from_planes(word_table.planes(values)).tolist() == values.tolist()
    assert word_table.from_planes(word_table.planes(values[:0])).tolist() == []


def test_a_file_with_a_decoder_is_refused(tmp_path):
    from tokenizers import decoders

    other = Tokenizer.from_file(PATH)
    other.decoder = decoders.ByteLevel()
    other.save(f"{tmp_path}/other.json")
    with pytest.raises(ValueError):
        word_table.tokenizer(f"{tmp_path}/other.json")
    assert word_table.tokenizer(PATH).decoder is None
