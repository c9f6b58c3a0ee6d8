"""Exact splitting of text at spaces, so that encodings of pieces can be kept.

The byte-level pre-tokenizer's pattern never lets a token run across a space that
follows a character other than white space. Text may therefore be cut before each
space, and a piece gives the same ids wherever it stands.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import regex
from tokenizers import Tokenizer

#: The pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_PLAIN = regex.compile(PATTERN)
#: Below this character all versions of Unicode agree on what is a letter or number.
SETTLED = "\u0530"


def newer_letters(file_text: str) -> str:
    """Characters that ``regex`` takes for letters or numbers and the library doesn't.

    The two follow different versions of Unicode, so the library is asked about every
    such character that Python's own, older version doesn't list. Gives the inside of
    a character class.
    """
    split = Tokenizer.from_str(file_text).pre_tokenizer.pre_tokenize_str
    unlisted = "".join(
        chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"
    )
    differing = [
        ord(c)
        for c in regex.findall(r"[\p{L}\p{N}]", unlisted)
        if len(split(f"a{c}b")) > 1 and len(split(f"1{c}1")) > 1
    ]
    ranges: list[list[int]] = []
    for c in differing:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def splitter(newer: str) -> Callable[[str], list[str]]:
    """The pre-tokenizer's split; ``newer`` comes from :func:`newer_letters`."""
    if not newer:
        return _PLAIN.findall
    exact = regex.compile(
        rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{newer}]]+| ?[\p{{N}}--[{newer}]]+"
        rf"| ?[[^\s\p{{L}}\p{{N}}]||[{newer}]]+|\s+(?!\S)|\s+"
    ).findall
    plain = _PLAIN.findall

    def split(text: str) -> list[str]:
        return plain(text) if text.isascii() or max(text) < SETTLED else exact(text)

    return split


def is_word(text: str) -> bool:
    """Whether the split surely leaves ``text`` whole: ASCII letters, maybe after a space."""
    return text.isascii() and text[text[:1] == " " :].isalpha()


#: White space before a space: a cut there would be inside a run of white space.
_ASCII_RUNS = tuple(c + " " for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")
_OTHER_RUNS = tuple(
    chr(c) + " "
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
LONG = 64


def cuttable(text: str) -> bool:
    """Whether every space of ``text`` is a place to cut."""
    # One character is found much faster than two.
    if any(run[0] in text and run in text for run in _ASCII_RUNS):
        return False
    return text.isascii() or not any(run[0] in text and run in text for run in _OTHER_RUNS)


class Cache(dict):
    """Ids of pieces, as bytes; emptied when it holds ``limit`` of them.

    ``encode`` takes strings and gives the ids of each as bytes. A piece is kept when it
    comes up for the second time, as many never do, and if it has ``LONG`` characters at
    most.
    """

    _MARKS = 1 << 22

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = 400_000):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.met = bytearray(self._MARKS)

    def __missing__(self, piece: str) -> bytes:
        (ids,) = self.encode([piece])
        self.keep(piece, ids)
        return ids

    def keep(self, piece: str, ids: bytes) -> None:
        mark = hash(piece) % self._MARKS
        if not self.met[mark]:
            self.met[mark] = 1
        elif len(piece) <= LONG:
            if len(self) >= self.limit:
                self.clear()
                self.met = bytearray(self._MARKS)
            self[piece] = ids
