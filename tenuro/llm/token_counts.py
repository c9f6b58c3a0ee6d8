"""Token counts of texts of any length, from overlapping chunks that are spliced.

A huge text is encoded in chunks that overlap. Each encoding tells where its words (the
units of the pre-tokenizer) begin. A place where a word begins in both of two neighbouring
chunks, and which passes the tests of :meth:`ChunkedCounter._stable`, is a border of the
whole text's encoding too: tokens before it are counted in the left chunk, those from it
on in the right one. Where the overlap has no such place, it is widened.

Why such a place is a border. The pre-tokenizer's pattern is matched from left to right,
without looking back, so two encodings that begin a word at the same place go on alike
from there. Normalisation doesn't reach over a character that composes with nothing
before it. A special token that lies across the place would be whole in both chunks, as
they go on further than the longest of them on both sides. And merges stay within words.

Where a file drops white space, a space is a border of that kind wherever it stands, so
shorter texts need no chunks: what stands between their spaces is counted once and
remembered. Chunks of longer texts are counted in the same way, and spliced after a space,
unless a text has a stretch without spaces that an overlap may not reach across.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from tenuro.llm.common import map_texts, table

#: Normalizers that work on a character, or on one with those that compose with it, or on
#: runs of white space, and pre-tokenizers that look ahead by a character at most.
_NORMALIZERS = {"NFC", "Lowercase", "Replace", "Sequence"}
_PRE_TOKENIZERS = {"Split", "ByteLevel", "Sequence"}
#: Patterns that look ahead by a character at most and never back (fixed values).
_PATTERNS = {
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    r"\s+",
}

#: Longer pieces aren't remembered, and others from the second time on, as many come up once.
_KEPT = 64
_MARKS = 1 << 22


class Count(NamedTuple):
    n_tokens: int
    n_chunks: int
    n_widened: int


def _steps(node: dict | None, inner: str) -> list[dict]:
    if node is None:
        return []
    if node["type"] != "Sequence":
        return [node]
    return [step for part in node[inner] for step in _steps(part, inner)]


def _splices(file: dict) -> bool:
    """Whether the argument at the head of this module holds for a tokenizer file."""
    normalizers = _steps(file["normalizer"], "normalizers")
    splits = _steps(file["pre_tokenizer"], "pretokenizers")
    if not splits or any(s["type"] not in _PRE_TOKENIZERS for s in splits):
        return False
    if any(s["type"] not in _NORMALIZERS for s in normalizers):
        return False
    if any(s["type"] == "ByteLevel" and s["add_prefix_space"] for s in splits):
        return False
    patterns = [s["pattern"] for s in (*normalizers, *splits) if "pattern" in s]
    if any(p.get("Regex") not in _PATTERNS for p in patterns):
        return False
    if not any(s["type"] == "Split" or s.get("use_regex") for s in splits):
        return False  # all of a text would be one word
    flags = ("lstrip", "rstrip", "single_word", "normalized")
    return not any(t[flag] for t in file["added_tokens"] for flag in flags)


@lru_cache(maxsize=1)
def _composing() -> frozenset[str]:
    """Characters that may become one with a character before them."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c)
        if parts and not parts.startswith("<"):
            found.update(chr(int(p, 16)) for p in parts.split()[1:])
    return frozenset(found)


def begins_anew(c: str) -> bool:
    """Whether normalisation to NFC never joins ``c`` with what stands before it."""
    if c < "\u0300":
        return True
    known = unicodedata.category(c) not in ("Cn", "Mn", "Mc", "Me", "Cs")
    return known and unicodedata.combining(c) == 0 and c not in _composing()


def _drops_spaces(file: dict) -> bool:
    """Whether no token of a file that can be spliced has a space in it."""
    removed = [
        s for s in _steps(file["pre_tokenizer"], "pretokenizers")
        if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]
    ]
    return bool(removed) and not any(" " in t["content"] for t in file["added_tokens"])


class ChunkedCounter:
    """Counts the tokens that a tokenizer file gives for whole texts.

    Texts of up to ``chunk`` characters are taken at once, longer ones in chunks that
    share ``overlap`` characters. A file for which splicing isn't proven has all texts
    encoded at once. Up to about ``held`` pieces are remembered.
    """

    def __init__(
        self, file_text: str, chunk: int = 65_536, overlap: int = 512, held: int = 400_000
    ):
        file = json.loads(file_text)
        self.tokenizer = Tokenizer.from_str(file_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.splices = _splices(file)
        self.remembers = self.splices and _drops_spaces(file)
        self.known: dict[str, int] = {}
        #: Marks at hashes of the pieces that have come up.
        self.met = bytearray(_MARKS)
        self.held = held
        longest = max((len(t["content"]) for t in file["added_tokens"]), default=0)
        #: Characters that a place keeps from the ends of chunks.
        self.margin = max(longest, 8)
        if overlap <= 2 * self.margin or chunk <= overlap:
            raise ValueError(f"2 * {self.margin} < overlap < chunk is needed")
        self.chunk, self.overlap = chunk, overlap

    def counts(self, texts: Sequence[str]) -> list[Count]:
        short = [t for t in texts if not self._is_long(t)]
        found = iter(self._remembered(short) if self.remembers else self._whole(short))
        return [
            self._spliced(t) if self._is_long(t) else Count(next(found), 1, 0) for t in texts
        ]

    def _whole(self, texts: list[str]) -> list[int]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return list(map(len, found))

    def _remembered(self, texts: list[str]) -> list[int]:
        """The same, from the counts of what stands between spaces.

        Pieces that come up for the first time are counted together, text by text.
        """
        split = [t.split(" ") for t in texts]
        counts = self._look_up(split)
        first: list[list[str]] = []
        left: list[list[str]] = []
        for pieces, found in zip(split, counts):
            first.append([])
            left.append([])
            if None in found:
                for piece, n in zip(pieces, found):
                    if n is None:
                        (first if self._is_first(piece) else left)[-1].append(piece)
        together = iter(self._whole([" ".join(pieces) for pieces in first if pieces]))
        sums = [next(together) if pieces else 0 for pieces in first]
        again = self._count_each({p for pieces in left for p in pieces})
        return [
            n + sum(filter(None, found)) + sum(map(again.__getitem__, pieces))
            for n, found, pieces in zip(sums, counts, left)
        ]

    def _of_pieces(self, pieces: list[str]) -> list[int]:
        """The tokens of each piece."""
        (found,) = self._look_up([pieces])
        missing = {p for p, n in zip(pieces, found) if n is None}
        new = self._count_each(missing, {p for p in missing if not self._is_first(p)})
        return [new[p] if n is None else n for p, n in zip(pieces, found)]

    def _look_up(self, split: list[list[str]]) -> list[list[int | None]]:
        if len(self.known) > self.held:
            self.known.clear()
            self.met = bytearray(_MARKS)
        return [list(map(self.known.get, pieces)) for pieces in split]

    def _is_first(self, piece: str) -> bool:
        """Whether a piece has not come up before, as far as marks can tell them apart."""
        mark = hash(piece) % _MARKS
        if self.met[mark]:
            return False
        self.met[mark] = 1
        return True

    def _count_each(self, pieces: set[str], kept: set[str] | None = None) -> dict[str, int]:
        """The tokens of each piece; those ``kept`` (all by default) are remembered."""
        each = list(pieces)
        new = dict(zip(each, self._whole(each)))
        kept = pieces if kept is None else kept
        self.known.update((p, n) for p, n in new.items() if p in kept and len(p) <= _KEPT)
        return new

    def _is_long(self, text: str) -> bool:
        return self.splices and len(text) > self.chunk

    def _words(self, text: str, start: int, stop: int) -> dict[int, int]:
        """Where words of text[start:stop] begin, and how many tokens come before each.

        The end of the part, and the number of all its tokens, comes last.
        """
        found = self.tokenizer.encode(text[start:stop], add_special_tokens=False)
        begins: dict[int, int] = {}
        previous = None
        for i, (word, (at, _)) in enumerate(zip(found.word_ids, found.offsets)):
            if word != previous:
                begins[start + at] = i
                previous = word
        begins[stop] = len(found)
        return begins

    def _after_spaces(self, text: str, start: int, stop: int) -> dict[int, int]:
        """The same for the places after spaces, and the begin of the part."""
        pieces = text[start:stop].split(" ")
        counts = self._of_pieces(pieces)
        begins = dict(
            zip(
                accumulate((len(p) + 1 for p in pieces), initial=start),
                accumulate(counts, initial=0),
            )
        )
        del begins[stop + 1]
        begins[stop] = sum(counts)
        return begins

    def _spaced(self, text: str) -> bool:
        """Whether spaces are borders and every overlap has one, away from its ends."""
        reach = self.overlap - 2 * self.margin
        return self.remembers and max(map(len, text.split(" "))) < reach

    def _stable(self, text: str, place: int, left_stop: int, right_start: int) -> bool:
        """Whether a common begin of words in two chunks is one in the whole text too."""
        inside = right_start + self.margin <= place <= left_stop - self.margin
        return inside and begins_anew(text[place])

    def _spliced(self, text: str) -> Count:
        size, counted, n_chunks, widened = len(text), 0, 1, 0
        start, stop = 0, self.chunk
        begun = 0  # tokens of the left chunk that come before the last splice
        words = self._after_spaces if self._spaced(text) else self._words
        left = words(text, start, stop)
        overlap = self.overlap
        while stop < size:
            right_start = max(start, stop - overlap)
            right_stop = min(size, right_start + max(self.chunk, 2 * overlap))
            right = words(text, right_start, right_stop)
            n_chunks += 1
            places = [
                p for p in left.keys() & right.keys() if self._stable(text, p, stop, right_start)
            ]
            if places:
                # The middle of the overlap is farthest from what either chunk lacks.
                middle = (right_start + stop) // 2
                place = min(places, key=lambda p: (abs(p - middle), p))
                counted += left[place] - begun
                left, begun = right, right[place]
                start, stop, overlap = place, right_stop, self.overlap
                continue
            # No border in common: the left chunk takes in more, and shares more.
            widened += 1
            overlap *= 2
            longer = min(size, stop + overlap)
            more = words(text, start, longer)
            n_chunks += 1
            # A character may become several words, the last of which was spliced at.
            left, begun, stop = more, more[start] if start else 0, longer
        return Count(counted + left[size] - begun, n_chunks, widened)


@lru_cache(maxsize=2)
def _counter(file_text: str, chunk: int, overlap: int) -> ChunkedCounter:
    """One for each worker, kept from task to task."""
    return ChunkedCounter(file_text, chunk, overlap)


def count_tokens(
    df: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    limit: int = 2048,
    chunk: int = 65_536,
    overlap: int = 512,
) -> DataFrame:
    """The tokens of every whole text, without begin, end or other added tokens.

    Gives columns ``keep``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than
    ``limit`` tokens), ``n_chunks`` (encodings made) and ``n_widened`` (overlaps that had to
    grow). Texts of more than ``chunk`` characters are encoded in chunks that share
    ``overlap`` characters; counts don't depend on either. Strings of special tokens inside
    a text count as the file says. A null text counts as empty, with no tokens; repeated
    rows repeat; other columns are left aside; an empty table gives an empty result.
    Memory follows the longest text, and its longest stretch without a border of words.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def prepare():
        counter = _counter(shared.value, chunk, overlap)

        def measure(texts: list[str]) -> list[list]:
            counts = counter.counts(texts)
            return [
                [len(t.encode()) for t in texts],
                [c.n_tokens for c in counts],
                [c.n_tokens > limit for c in counts],
                [c.n_chunks for c in counts],
                [c.n_widened for c in counts],
            ]

        return measure

    fields = "n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long"
    return map_texts(df, text, keep, fields, prepare, chunk_chars=1_000_000)


def op12_resynchronised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document with the 49k vocabulary of lower-cased words."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(
        documents, public_tokenizers.path("word_bpe_49k.json"), chunk=16_384, overlap=512
    )
