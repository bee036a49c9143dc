"""Token counts by dynamic programming over the prefixes of words."""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate, islice

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm.common import map_texts

LIMIT = 2048
#: Entries a task keeps of counts by word and of checked token pairs; full tables start anew.
CACHE_ENTRIES = 300_000
#: Longer pieces and words are in none of these tables, so entries are small; their prefixes are kept by position while they are counted.
SHARED = 64

_CHUNK = re.compile(rb"[^\x20\x09-\x0D]+")


class PrefixCounter:
    """Exact token counts for a byte-level BPE vocabulary file that drops white space.

    A word is a row of symbols, one per byte. For each prefix a table entry holds its last token and its number of tokens.
    A token ends the encoding of a prefix exactly if the encoding of what lies before it ends in a token that BPE leaves
    apart from it, so an entry follows from a shorter one, without merging the prefix again.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = tuple(token["content"] for token in spec["added_tokens"])
        merges = [tuple(pair) for pair in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.split = {left + right: (left, right) for left, right in merges}
        ended = {token for token in model["vocab"] if self.suffix and token.endswith(self.suffix)}
        self.plain = set(model["vocab"]) - ended
        self.ended = {token[: -len(self.suffix)] for token in ended} if self.suffix else self.plain
        self.longest = max(map(len, self.plain | self.ended))
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Last token and number of tokens by prefix, number of tokens by piece and by word.
        self.prefixes: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.pieces: dict[str, int] = {}
        self.words: dict[bytes, int] = {}
        # The byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes follow from 256.
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = (b for b in range(256) if b not in visible)
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _symbols(self, token: str) -> list[str]:
        if token not in self.split:
            return [token]
        left, right = self.split[token]
        return self._symbols(left) + self._symbols(right)

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether BPE, given the symbols of both tokens, ends with these two tokens (``left`` may be empty)."""
        known = self.pairs.get((left, right))
        if known is None and (left, right) in self.rank:
            return False
        if known is None:
            row = (self._symbols(left) if left else []) + self._symbols(right)
            while len(row) > 1:
                pair = min(zip(row, row[1:]), key=lambda p: self.rank.get(p, len(self.rank)))
                if pair not in self.rank:
                    break
                i = next(i for i, p in enumerate(zip(row, row[1:])) if p == pair)
                row[i : i + 2] = [pair[0] + pair[1]]
            known = row == ([left] if left else []) + [right]
            if len(self.pairs) >= CACHE_ENTRIES:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _prefix(self, stem: str) -> tuple[str, int]:
        """Last token and number of tokens of a prefix that does not end its word.

        Entries are filled from shorter to longer, only those that some entry asks for, and are shared by all words.
        """
        waiting = [stem]
        while waiting:
            own = waiting[-1]
            if own in self.prefixes:
                waiting.pop()
                continue
            for j in range(max(0, len(own) - self.longest), len(own)):
                token = own[j:]
                if token in self.plain:
                    before = self.prefixes.get(own[:j])
                    if before is None:
                        waiting.append(own[:j])
                        break
                    if self._stay_apart(before[0], token):
                        self.prefixes[own] = (token, before[1] + 1)
                        break
        return self.prefixes[stem]

    def _fill(self, stem: str) -> tuple[array, array]:
        """Length of the last token, and number of tokens, of each prefix that does not end its word, by position."""
        last, count = array("i", [0]), array("q", [0])
        for end in range(1, len(stem) + 1):
            for j in range(max(0, end - self.longest), end):
                if stem[j:end] in self.plain and self._stay_apart(stem[j - last[j] : j], stem[j:end]):
                    last.append(end - j)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError("a symbol is not in the vocabulary")
        return last, count

    def _close(self, piece: str, end: int, last: array, count: array) -> int:
        """Tokens of the first ``end`` symbols as a whole word, from the entries of ``_fill``."""
        for j in range(max(0, end - self.longest), end):
            if piece[j:end] in self.ended and self._stay_apart(piece[j - last[j] : j], piece[j:end] + self.suffix):
                return count[j] + 1
        raise ValueError("a symbol is not in the vocabulary")

    def _count_piece(self, piece: str) -> int:
        if len(piece) > SHARED:
            return self._close(piece, len(piece), *self._fill(piece[:-1]))
        known = self.pieces.get(piece)
        if known is None:
            if len(self.prefixes) >= CACHE_ENTRIES:
                self.prefixes = {"": ("", 0)}
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            known = self.pieces[piece] = self._count_whole(piece)
        return known

    def _count_whole(self, piece: str) -> int:
        for j in range(max(0, len(piece) - self.longest), len(piece)):
            if piece[j:] in self.ended:
                last, count = self._prefix(piece[:j])
                if self._stay_apart(last, piece[j:] + self.suffix):
                    return count + 1
        raise ValueError("a symbol is not in the vocabulary")

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece, as if the prefix were the whole word."""
        entries = self._fill(piece[:-1])
        return [self._close(piece, k, *entries) for k in range(1, len(piece) + 1)]

    def _count_word(self, word: bytes) -> int:
        text = word.decode()
        body = text[:-1] if text[-1] in ".,;:!?" else text
        if body.isalpha() and max(body) < "\u0100":
            # Letters that are composed and have one small form: one piece, and perhaps one of punctuation.
            piece = body.lower().encode().decode("latin-1").translate(self.alphabet)
            return self._count_piece(piece) + (self._count_piece(text[-1]) if body is not text else 0)
        extra, parts = 0, [text]
        for special in self.specials:
            cut = [part.split(special) for part in parts]
            extra += sum(len(rest) - 1 for rest in cut)
            parts = [part for rest in cut for part in rest]
        for part in filter(None, parts):
            normal = self.tokenizer.normalizer.normalize_str(part)
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                extra += self._count_piece(piece)
        return extra

    def word_counts(self, words: list[bytes]) -> list[int]:
        """Tokens of each word, where words are what ASCII white space separates."""
        known = self.words
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            fresh = {word: self._count_word(word) for word in set(words).difference(known)}
            if len(known) + len(fresh) > CACHE_ENTRIES:
                fresh = {word: fresh[word] if word in fresh else known[word] for word in set(words)}
                known.clear()
            short = (entry for entry in fresh.items() if len(entry[0]) <= SHARED)
            known.update(islice(short, CACHE_ENTRIES))
            return [fresh[word] if word in fresh else known[word] for word in words]

    def measure(self, raw: bytes | None, limits: Sequence[int]) -> tuple[int, int, list[tuple[int, int]]]:
        """Bytes, tokens, and for each limit bytes and tokens of the longest prefix with at most so many tokens.

        The counts at the ends of words tell which word crosses a limit. Any longer prefix has all of that word, so the longest one that fits
        ends in it, and the counts of its prefixes decide.
        """
        if not raw:
            return 0, 0, [(0, 0)] * len(limits)
        counts = self.word_counts(raw.split())
        until = list(accumulate(counts))
        total = until[-1] if until else 0
        limits = [max(0, limit) for limit in limits]
        crossing = [bisect_right(until, limit) for limit in limits]
        wanted, places = set(crossing), {}
        for i, word in zip(range(max(wanted) + 1), _CHUNK.finditer(raw)):
            if i in wanted:
                places[i] = word.span()
        fits = []
        for limit, i in zip(limits, crossing):
            if i == len(until):
                fits.append((len(raw), total))
                continue
            before, (start, end) = until[i - 1] if i else 0, places[i]
            own, tokens = self._fit_word(raw[start:end].decode(), limit - before)
            fits.append((start + own, before + tokens))
        return len(raw), total, fits

    def _fit_word(self, word: str, limit: int) -> tuple[int, int]:
        """Bytes and tokens of the longest prefix of a word with at most ``limit`` tokens; the word has more."""
        at = tokens = 0
        while True:
            found = [(word.find(special, at), special) for special in self.specials]
            cut, special = min((f for f in found if f[0] >= 0), default=(len(word), ""))
            own = self._count_text(word[at:cut])
            if not special or tokens + own + 1 > limit:
                # What is left of a special string that is cut is ordinary text.
                length, own = self._fit_text(word[at : cut + max(0, len(special) - 1)], limit - tokens)
                return len(word[: at + length].encode()), tokens + own
            tokens, at = tokens + own + 1, cut + len(special)

    def _count_text(self, text: str) -> int:
        return sum(self._count_piece(piece) for piece, _ in self._split_text(text)[1])

    def _split_text(self, text: str) -> tuple[str, list[tuple[str, tuple[int, int]]]]:
        normal = self.tokenizer.normalizer.normalize_str(text) if text else ""
        return normal, self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if normal else []

    def _fit_text(self, text: str, limit: int) -> tuple[int, int]:
        """Characters and tokens of the longest prefix that ends between two grapheme clusters, in a text without special strings."""
        normal, pieces = self._split_text(text)
        if text.isascii() and len(normal) == len(text):
            clusters, own = text, normal
        else:
            clusters = regex.findall(r"\X", text)
            own = [self.tokenizer.normalizer.normalize_str(cluster) for cluster in clusters]
        if "".join(own) != normal:  # clusters that change each other: all prefixes, the longest first
            for k in range(len(clusters), 0, -1):
                prefix = "".join(clusters[:k])
                if (tokens := self._count_text(prefix)) <= limit:
                    return len(prefix), tokens
            return 0, 0
        ends = [0, *accumulate(map(len, own))]
        tokens, first, last = 0, len(normal), len(normal)
        for piece, (start, end) in pieces:
            more = self._count_piece(piece)
            if tokens + more > limit:
                first, last = start, end
                break
            tokens += more
        inside = self._counts_inside(piece, normal[first:last], limit - tokens) if first < last else {}
        for k in range(bisect_right(ends, last) - 1, 0, -1):
            at = ends[k]
            if at > first:
                if at - first not in inside:
                    continue
                count = tokens + inside[at - first]
            else:
                # A cluster that begins in an earlier piece ends between pieces at times.
                count = tokens if at == first else self._count_text("".join(clusters[:k]))
            if count <= limit:
                return sum(map(len, clusters[:k])), count
        return 0, 0

    def _counts_inside(self, piece: str, text: str, limit: int) -> dict[int, int]:
        """Tokens of the prefixes of a piece, by their characters in ``text``, as far as they can have at most ``limit``.

        A prefix has one token more than some prefix before it that is shorter by no more than the longest token.
        """
        if text[0] == "'":  # a contraction that is cut is two pieces
            return {k: self._count_text(text[:k]) for k in range(1, len(text))}
        symbols = list(accumulate(len(c.encode()) for c in text[:-1]))
        last, count = self._fill(piece[:-1])
        fitting = next((j for j in range(len(count) - 1, -1, -1) if count[j] < limit), -1)
        most = bisect_right(symbols, fitting + self.longest)
        known: dict[int, int] = {}
        for k in range(most, 0, -1):
            known[k] = self._close(piece, symbols[k - 1], last, count)
            # Prefixes that are shorter by more than a token cannot be the longest that fits.
            if known[k] <= limit and k < most - self.longest:
                break
        return known


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a file, kept while a Python worker lives."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, fit_bytes`` of each document, in input order and without a shuffle.

    ``path`` names a vocabulary file of the tokenizers library on every executor, with a pre-tokenizer that drops
    white space. Counts are those of the library for the whole text, without added special
    tokens. ``fit_bytes`` is the length of the longest prefix with at most ``limit`` tokens, see ``fit_budgets``. Null and empty texts have 0 of all;
    repeated rows and null ids are kept; a very long word costs time and memory in proportion to its length.
    """

    def prepare():
        own = counter(path)

        def work(raw):
            n_bytes, n_tokens, ((fit, _),) = own.measure(raw, [limit])
            return n_bytes, n_tokens, fit

        return work

    return map_texts(docs, prepare, {"n_bytes": "long", "n_tokens": "long", "fit_bytes": "long"})


def fit_budgets(docs: DataFrame, path: str, budgets: Sequence[int]) -> DataFrame:
    """``doc_id, budget, fit_bytes, fit_tokens``: a row for each document and each of the token ``budgets``, of one pass over its text.

    ``fit_bytes`` is the length in bytes of the longest prefix that the library encodes with at most ``budget`` tokens, and ``fit_tokens`` how many
    these are. A prefix ends anywhere between two grapheme clusters, inside words too, and has the white space that follows it. Nothing is encoded
    for it: counts of words are added up, and those of the prefixes of one word follow from the entries of the dynamic program. Null and
    empty texts fit every budget with 0 of both; a budget below 0 counts as 0. Repeated budgets count once;
    without budgets there are no rows.
    """
    limits = [int(budget) for budget in dict.fromkeys(budgets)]

    def prepare():
        own = counter(path)

        def work(raw):
            fits = own.measure(raw, limits)[2] if limits else []
            return [fit for fit, _ in fits], [tokens for _, tokens in fits]

        return work

    found = map_texts(docs, prepare, {"fits": "array<long>", "tokens": "array<long>"})
    wanted = F.array(*[F.lit(limit).cast("long") for limit in limits]).cast("array<long>")
    rows = found.select("doc_id", F.explode(F.arrays_zip(wanted.alias("budget"), "fits", "tokens")).alias("fit"))
    return rows.select("doc_id", F.col("fit.budget").alias("budget"), F.col("fit.fits").alias("fit_bytes"), F.col("fit.tokens").alias("fit_tokens"))
