"""Ids of texts by a vocabulary file of the tokenizers library, each distinct word encoded once while it is remembered."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that all versions of Unicode put in the same classes; a text with others is encoded as one word.
_OTHER = re.compile("[^\x00-ԧ]")
#: A byte-level file splits a text before a blank between two visible characters, whatever stands further away. Where blanks
#: have other white space beside them only those between visible characters are looked for.
_RUNS = ("  ", "\n ", " \n")
_RARE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
#: Ends of words that are pieces of their own after a letter or a digit.
_ENDS = ".,;:!?"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Where a text with other characters can be cut.
_CUT = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
#: Characters of a part of such a text, and words that are remembered, some 250 bytes each; a full table starts anew.
PART, REMEMBERED = 1 << 16, 1_000_000
#: Words encoded in one call.
_CALL = 2048


#: The byte-level letter for a blank (fixed value).
_BLANK = "Ġ"


class ByteBpe:
    """Encodes texts exactly as the library does with ``add_special_tokens=False``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self.size = self._library.get_vocab_size(with_added_tokens=True)
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        self._special = [token["content"] for token in file["added_tokens"]]
        splits = file["pre_tokenizer"] or {}
        self._by_word = (
            file["normalizer"] is None
            and splits.get("type") == "ByteLevel"
            and splits.get("use_regex") is True
            and splits.get("add_prefix_space") is False
            and not file["model"].get("dropout")
            and not any(re.search(r"\s", special) for special in self._special)
        )
        # Ids of pieces that start with a blank, the first ones of words.
        self._opens = np.zeros(self.size, dtype=bool)
        for piece, number in self._library.get_vocab().items():
            self._opens[number] = piece.startswith(_BLANK)
        self.forget()

    def forget(self) -> None:
        """Drops the remembered words."""
        # All words by number, and the numbers of words at the start of a text, inside, and at its end; the ids of the first ``_known`` are in the table.
        self._words: list[str] = []
        self._first: dict[str, int] = {}
        self._inner: dict[str, int] = {}
        self._last: dict[str, int] = {}
        # Ends of inner words, and words that are the ids of two others: (number, first, second).
        self._ends: dict[str, int] = {}
        self._pairs: list[tuple[int, int, int]] = []
        # Inner words start with their only blank and end visibly: their pieces stay the same when such words are joined.
        self._joining: list[int] = []
        self._known = 0
        self._ids, self._used = np.zeros(1 << 16, dtype=np.uint32), 0
        self._starts, self._sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and their number in each text."""
        if len(self._words) > REMEMBERED:
            self.forget()
        simple = [i for i, text in enumerate(texts) if self._by_word and self._is_simple(text)]
        numbers: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
        self._split_simple([texts[i] for i in simple], simple, numbers)
        for i in sorted(set(range(len(texts))).difference(simple)):
            numbers[i] = np.array(self._split(texts[i]) if self._by_word else [self._whole(texts[i])], dtype=np.int64)
        self._fill()
        of_word = np.concatenate([np.zeros(0, dtype=np.int64), *numbers])
        sizes = self._sizes[of_word]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        places = np.repeat(self._starts[of_word] - after + sizes, sizes)
        places += np.arange(total)
        ends = np.cumsum([len(own) for own in numbers], dtype=np.int64)
        bounds = np.concatenate(([0], after)).astype(np.int64)[np.concatenate(([0], ends)).astype(np.int64)]
        return self._ids[places], np.diff(bounds)

    def _is_simple(self, text: str) -> bool:
        """Whether blanks are the only places to split at, since each has visible characters beside it."""
        return (
            not any(run in text for run in _RUNS)
            and self._is_plain(text)
            and not any(c in text and (f"{c} " in text or f" {c}" in text) for c in _RARE)
        )

    def _is_plain(self, text: str) -> bool:
        return (text.isascii() or not _OTHER.search(text)) and not any(special in text for special in self._special)

    def _split_simple(self, texts: list[str], places: list[int], numbers: list[np.ndarray]) -> None:
        """Splits many texts at blanks, and looks up each distinct inner word once."""
        if not texts:
            return
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets, flat = words.offsets.to_numpy(), words.flatten()
        inner = np.ones(len(flat), dtype=bool)
        inner[offsets[:-1]] = False
        inner[offsets[1:] - 1] = False
        found = flat.filter(pa.array(inner)).dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._inner
        of_distinct = [known.get(word, -1) for word in distinct]
        for i, number in enumerate(of_distinct):
            if number < 0:
                of_distinct[i] = self._inner_number(distinct[i])
        of_distinct = np.array(of_distinct, dtype=np.int64)
        of_word = np.zeros(len(flat), dtype=np.int64)
        of_word[inner] = of_distinct[found.indices.to_numpy()]
        bounds = offsets.tolist()
        ends = pa.array(np.stack((offsets[:-1], offsets[1:] - 1), axis=1).ravel())
        edges = flat.take(ends).to_pylist()
        for i, place in enumerate(places):
            of_word[bounds[i]] = self._number(self._first, edges[2 * i], "")
            if bounds[i + 1] - bounds[i] > 1:
                of_word[bounds[i + 1] - 1] = self._number(self._last, edges[2 * i + 1], " ")
            numbers[place] = of_word[bounds[i] : bounds[i + 1]]

    def _inner_number(self, word: str) -> int:
        """The number of a new inner word; what it shares with others before its end is noted as a word by itself."""
        base = word.rstrip(_ENDS)
        if base and len(base) < len(word) and base[-1].isalnum():
            first = self._inner.get(base)
            if first is None:
                first = self._inner_number(base)
            self._inner[word] = number = len(self._words)
            self._words.append("")
            self._pairs.append((number, first, self._number(self._ends, word[len(base) :], "")))
            return number
        self._inner[word] = number = len(self._words)
        self._words.append(" " + word)
        self._joining.append(number)
        return number

    def _number(self, table: dict[str, int], word: str, blank: str) -> int:
        number = table.get(word)
        if number is None:
            table[word] = number = len(self._words)
            self._words.append(blank + word)
        return number

    def _split(self, text: str) -> list[int]:
        if not self._is_plain(text):
            return [self._whole(part) for part in self._parts(text)]
        first, *later = _BETWEEN.split(text)
        return [self._number(self._first, first, ""), *(self._number(self._last, word, " ") for word in later)]

    def _whole(self, text: str) -> int:
        """The text as one word that is not remembered."""
        self._words.append(text)
        return len(self._words) - 1

    @staticmethod
    def _parts(text: str):
        at = 0
        while len(text) - at > PART:
            cut = _CUT.search(text, at + PART)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _fill(self) -> None:
        """Encodes the words that are not in the table yet, many in one text where they join."""
        fresh = self._words[self._known :]
        if not fresh:
            return
        sizes, parts, order = np.zeros(len(fresh), dtype=np.int64), [], []
        together = [number - self._known for number in self._joining]
        self._joining.clear()
        for start in range(0, len(together), _CALL):
            own = together[start : start + _CALL]
            ids = np.array(self._encoded("".join([fresh[i] for i in own])), dtype=np.uint32)
            sizes[own] = np.diff(np.flatnonzero(self._opens[ids]), append=len(ids))
            parts.append(ids)
            order += own
        pairs = np.array(self._pairs, dtype=np.int64).reshape(-1, 3)
        self._pairs.clear()
        alone = sorted(set(range(len(fresh))).difference(together, (pairs[:, 0] - self._known).tolist()))
        for i in alone:
            ids = self._encoded(fresh[i])
            sizes[i] = len(ids)
            parts.append(np.array(ids, dtype=np.uint32))
            order.append(i)
        # The table is in the order of encoding; starts say where each word is.
        flat = np.concatenate(parts)
        starts = np.zeros(len(fresh), dtype=np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order] + self._used
        self._reserve(len(flat))
        self._ids[self._used : self._used + len(flat)] = flat
        self._starts = np.concatenate((self._starts, starts))
        self._sizes = np.concatenate((self._sizes, sizes))
        self._used += len(flat)
        # Only the numbers count from here on.
        self._words[self._known :] = [""] * len(fresh)
        self._known = len(self._words)
        if len(pairs):
            self._put_together(pairs)

    def _put_together(self, pairs: np.ndarray) -> None:
        """Writes the ids of words that are two others one after the other."""
        number, halves = pairs[:, 0], pairs[:, 1:].ravel()
        sizes = self._sizes[halves]
        after = np.cumsum(sizes)
        places = np.repeat(self._starts[halves] - after + sizes, sizes) + np.arange(int(after[-1]))
        self._reserve(len(places))
        self._ids[self._used : self._used + len(places)] = self._ids[places]
        self._sizes[number] = sizes.reshape(-1, 2).sum(axis=1)
        self._starts[number] = self._used + after[1::2] - self._sizes[number]
        self._used += len(places)

    def _reserve(self, more: int) -> None:
        if self._used + more > len(self._ids):
            self._ids = np.concatenate((self._ids[: self._used], np.zeros(self._used + 2 * more, dtype=np.uint32)))

    def _encoded(self, text: str) -> list[int]:
        return self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids
