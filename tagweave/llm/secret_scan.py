"""Secrets in texts: fixed patterns, and strings that a primed compressor finds novel."""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import extend, fresh_name, map_texts

# The patterns of the three base kinds, in the order kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

# Identifiers as they stand near credentials; they prime the compressor.
IDENTIFIERS = (
    "access_key access_token account_id api_key apikey app_secret auth_token authorization aws_access_key_id "
    "aws_secret_access_key basic bearer certificate client_id client_secret config connection_string const cookie "
    "credential credentials database_url default encryption_key endpoint environment export false from header host "
    "http https id_rsa import json key keyfile license localhost login master_key null oauth passphrase passwd password "
    "port private_key production public_key pwd refresh_token return root secret secret_key self server session_id "
    "settings sha256 signature signing_key ssh-rsa string test token true url user user_id username value version webhook "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 changeme example placeholder xxxxxxxx 00000000"
)

#: What makes a place sensitive, how far before a candidate it may stand, and what a candidate is.
SENSITIVE = re.compile(r"secret|token|passw|pwd|passphrase|credential|auth|bearer|private|api_?key|access_?key|signature", re.I | re.A)
#: Letters, digits and ``+/_-``, inside also ``!#$%^&*~``. A candidate ends after ``=``: what stands before is its padding, or the name of
#: what follows. Points, quotes, brackets and blanks end it.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-](?:[A-Za-z0-9+/_!#$%^&*~-]*[A-Za-z0-9+/_-])?=*|=+")
LEAST = 12
#: A candidate that holds a sensitive word, has no digit and stands before one of these is the name of what follows.
NAMES = re.compile(r"""["']?\x20*[:=]""")
REACH = 40
#: Characters before and after a candidate that are compressed with it, and the marginal bits a character from which a candidate is novel.
BEFORE, AFTER = 512, 128
MIN_BITS = 5.4
#: Longer candidates are measured in pieces of this many characters; one novel piece suffices.
PIECE = 64
#: Bytes of the dictionary, and the words of a vocabulary in one of the samples that it is trained on.
DICTIONARY_BYTES, SAMPLE_WORDS = 1 << 19, 20
#: Characters of the start of each frame, and of 100 of them capitals, digits and other signs; the others are small letters.
START, CAPITALS, DIGITS, SIGNS = 2048, 8, 5, 15
_SIGNS = " =\"'()_-/.,:;{}<>\n"

_GATES = (b"passw", b"secret", b"token", b"api_key", b"apikey")
_SENSITIVE_GATES = (b"secret", b"token", b"passw", b"passphrase", b"pwd", b"credential", b"auth", b"bearer", b"private", b"key", b"signature")
_HEX_RUN = b"\x01" * HEX_CHARS
_HEX_MAP = bytes(1 if b in b"0123456789abcdef" else 0 for b in range(256))

Span = tuple[str, int, int]


def base_spans(raw: bytes) -> list[Span]:
    """Spans of the base kinds in code points, in no order. Cheap byte searches decide which pattern can match."""
    folded = raw.lower()
    assign = any(gate in folded for gate in _GATES)
    access = b"AKIA" in raw
    hexes = _HEX_RUN in raw.translate(_HEX_MAP)
    if not (assign or access or hexes):
        return []
    text = raw.decode()
    found = []
    if assign:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if access:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    if hexes:
        found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= HEX_CHARS]
    return found


def _words(vocabulary: str) -> list[str]:
    """The lower-case pieces of four letters or more of a vocabulary file, in the order of their ids."""
    vocab = json.loads(Path(vocabulary).read_text(encoding="utf-8"))["model"]["vocab"]
    pieces = (piece.removesuffix("</w>") for piece in sorted(vocab, key=vocab.get))
    return [piece for piece in pieces if re.fullmatch("[a-z]{4,}", piece)]


@dataclass(frozen=True)
class Primer:
    """What the compressor knows before it sees a text: a dictionary, and how often letters occur, as the start of each frame."""

    dictionary: bytes
    start: str


def primer(vocabulary: str) -> Primer:
    """Trains a zstandard dictionary on the words of a vocabulary file, as text and code write them.

    Words are joined as text, as names in the usual ways of writing them, with years, and as paths. The start of a frame is letters in no order, with
    the frequencies that they have in the words, and some other signs: it makes a string none of whose parts the dictionary knows
    cost what its letters cost in names and words, however short the text around it is.
    """
    words = _words(vocabulary)
    samples = []
    for i in range(0, len(words), SAMPLE_WORDS):
        part, year = words[i : i + SAMPLE_WORDS], 1990 + i // SAMPLE_WORDS % 45
        names = "_".join(part)
        camel = "".join(word.capitalize() for word in part)
        samples += [" ".join(part), names, camel, names.upper(), f"{'-'.join(part)}-{year}", "/".join(part)]
    samples += [IDENTIFIERS, "0123456789 1234567890 abcdefghijklmnopqrstuvwxyz"] * 20
    trained = zstandard.train_dictionary(DICTIONARY_BYTES, [sample.encode() for sample in samples], level=19)
    counts, drawn = Counter("".join(words)), random.Random(2)
    letters, often = list(counts), list(counts.values())
    small = drawn.choices(letters, often, k=START)
    kinds = drawn.choices("capital digit sign small".split(), [CAPITALS, DIGITS, SIGNS, 100 - CAPITALS - DIGITS - SIGNS], k=START)
    other = {"capital": str.upper, "digit": lambda _: drawn.choice("0123456789"), "sign": lambda _: drawn.choice(_SIGNS), "small": str}
    return Primer(trained.as_bytes(), "".join(other[kind](letter) for kind, letter in zip(kinds, small)))


class Novelty:
    """Measures what a string adds to its compressed surroundings."""

    def __init__(self, primer: Primer) -> None:
        primed = zstandard.ZstdCompressionDict(primer.dictionary)
        primed.precompute_compress(level=19)
        self._start = primer.start
        self._zstd = zstandard.ZstdCompressor(
            level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def _size(self, text: str) -> int:
        return len(self._zstd.compress((self._start + text).encode()))

    def marginal_bits(self, candidate: str, before: str, after: str) -> float:
        """Bits a character by which the compressed surroundings grow with the candidate in its place: all of it is one frame."""
        return 8 * (self._size(before + candidate + after) - self._size(before + after)) / len(candidate)

    def most_bits(self, candidate: str, before: str, after: str, enough: float) -> float:
        """The largest ``marginal_bits`` of the candidate's pieces, or the first that is ``enough``."""
        most = 0.0
        for i in range(0, len(candidate), PIECE):
            piece = candidate[i : i + PIECE]
            if len(piece) >= LEAST and most < enough:
                most = max(most, self.marginal_bits(piece, before, after))
        return most


def _left(start: int, end: int, taken: list[tuple[int, int]], first: int) -> Iterator[tuple[int, int]]:
    """What the spans of ``taken``, sorted, from the one at ``first`` on leave of a candidate, where it is long enough."""
    while first < len(taken) and taken[first][0] < end:
        if taken[first][0] - start >= LEAST:
            yield start, taken[first][0]
        start = max(start, taken[first][1])
        first += 1
    if end - start >= LEAST:
        yield start, end


def candidates(text: str, known: list[Span]) -> Iterator[tuple[int, int]]:
    """Strings in sensitive places, or what spans of ``known`` leave of them, that are long enough to be measured."""
    sensitive = [m.end() for m in SENSITIVE.finditer(text)]
    if not sensitive:
        return
    taken = sorted((start, end) for _, start, end in known)
    s = t = 0
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() < LEAST:
            continue
        while t < len(taken) and taken[t][1] <= m.start():
            t += 1
        for start, end in _left(*m.span(), taken, t):
            while s + 1 < len(sensitive) and sensitive[s + 1] <= start:
                s += 1
            own = text[start:end]
            is_name = (own[-1] == "=" or NAMES.match(text, end)) and SENSITIVE.search(own) and not re.search(r"\d", own)
            if start - REACH <= sensitive[s] <= start and not is_name:
                yield start, end


def spans(raw: bytes | None, novelty: Novelty, min_bits: float = MIN_BITS) -> tuple[list[Span], int]:
    """All spans by start, then by kind, and the number of candidates that were measured."""
    if not raw:
        return [], 0
    found, measured = base_spans(raw), 0
    folded = raw.lower()
    if any(gate in folded for gate in _SENSITIVE_GATES):
        text = raw.decode()
        for start, end in list(candidates(text, found)):
            measured += 1
            around = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
            if novelty.most_bits(text[start:end], *around, min_bits) >= min_bits:
                found.append(("novel", start, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]))), measured


def scan_secrets(docs: DataFrame, vocabulary: str, min_bits: float = MIN_BITS) -> DataFrame:
    """``doc_id, kinds, starts, ends, n_measured`` of each document: three arrays with an entry for each secret.

    Positions are code points, ends exclusive, entries in the order of starts and then of ``KINDS``. Base kinds
    may overlap each other; ``novel`` spans overlap no base span. Strings of 12 characters or more that follow a sensitive word within 40 characters are
    measured, see ``CANDIDATE`` for their letters; ``n_measured`` is their number. Those that add 5.4 bits a character or more to
    the compressed surroundings are novel. ``vocabulary`` names a file of the tokenizers library, on the driver, whose words the dictionary
    is trained on. Null and empty texts have empty arrays, repeated rows
    and null ids are kept, other columns, whatever their names, are left out. Candidates of any length are measured, in pieces of bounded size.
    """
    known = primer(vocabulary)

    def prepare():
        novelty = Novelty(known)

        def work(raw):
            found, measured = spans(raw, novelty, min_bits)
            return [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], measured

        return work

    return map_texts(
        docs, prepare, {"kinds": "array<string>", "starts": "array<long>", "ends": "array<long>", "n_measured": "long"}
    )


def _listed(entries: Column) -> Column:
    text = F.transform(entries, lambda e: F.concat_ws(":", e["kinds"], e["starts"].cast("string"), e["ends"].cast("string")))
    return F.array_join(text, ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and listings of ``scan_secrets``."""
    entries = F.arrays_zip("kinds", "starts", "ends")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    base = _listed(F.filter(entries, lambda e: e["kinds"] != "novel"))
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(base, 256).alias("base_sha256"),
        _listed(entries).alias("spans"),
        "n_measured",
    )


def redacted(raw: bytes, found: list[Span], mark: str = "[secret]") -> str:
    """The text with each stretch covered by spans replaced by ``mark``."""
    text, out, at = raw.decode(), [], 0
    for _, start, end in sorted(found, key=lambda x: x[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, vocabulary: str, min_bits: float = MIN_BITS) -> DataFrame:
    """``docs`` with secrets replaced in ``text``, and ``n_chars``, where there is such a column, counted anew where that happened.

    All columns of ``docs`` are kept, whatever their names. Null texts stay null.
    """
    known = primer(vocabulary)
    new_text, new_chars = fresh_name(docs, "text"), fresh_name(docs, "chars")

    def prepare():
        novelty = Novelty(known)

        def work(raw):
            found, _ = spans(raw, novelty, min_bits)
            text = redacted(raw, found) if found else None
            return text, None if text is None else len(text)

        return work

    rows = extend(docs, prepare, {new_text: "string", new_chars: "long"})
    changed = {"text": F.coalesce(new_text, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.col(new_chars).cast(docs.schema["n_chars"].dataType), "n_chars")
    return rows.withColumns(changed).select(*[F.col(f"`{name}`") for name in docs.columns])
