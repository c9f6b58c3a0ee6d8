"""Sets of hashed word shingles, for a chunk of texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

SHINGLE = 5
_SEGMENT = 1_000_000
_RADIX = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64."""

    def powers(base: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    return powers(_RADIX), powers(pow(_RADIX, -1, 2**64))


def _raw_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in ``data`` a sum over its letters, its length and where it starts."""
    letters = np.frombuffer(data, np.uint8)
    size = 1 << max(16, len(data).bit_length())
    powers, inverse = (p[: len(data)] for p in _powers(size))
    white = _WHITE[letters]
    edges = np.flatnonzero(np.diff(np.r_[True, white, True].astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    sums = np.r_[np.uint64(0), np.cumsum((letters + np.uint64(1)) * powers)]
    raw = (sums[stops] - sums[starts]) * inverse[starts]
    return raw, (stops - starts).astype(np.uint64), starts


def _hashes(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return _mixed(raw + lengths * np.uint64(0xD6E8FEB86659FD93))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word in ``data`` and where it starts; the place has no influence."""
    raw, lengths, starts = _raw_hashes(data)
    return _hashes(raw, lengths), starts


def _long_word_hashes(data: bytes) -> np.ndarray:
    """The same hashes, taken a part at a time; a word may go on over any number of them."""
    found = []
    raw_open = lengths_open = np.zeros(0, np.uint64)  # of the word that goes on
    for start in range(0, len(data), _SEGMENT):
        part = data[start : start + _SEGMENT]
        raw, lengths, starts = _raw_hashes(part)
        if len(raw_open):
            if not _WHITE[part[0]]:
                moved = np.uint64(pow(_RADIX, int(lengths_open[0]), 2**64))
                raw[:1] = raw_open + raw[:1] * moved
                lengths[:1] += lengths_open
            else:
                raw, lengths = np.r_[raw_open, raw], np.r_[lengths_open, lengths]
        closed = len(raw) - (not _WHITE[part[-1]])
        found.append(_hashes(raw[:closed], lengths[:closed]))
        raw_open, lengths_open = raw[closed:], lengths[closed:]
    return np.concatenate([*found, _hashes(raw_open, lengths_open)])


def _of_words(words: np.ndarray) -> np.ndarray:
    """The shingles that begin at each word; of fewer words, one of them all."""
    n = min(SHINGLE, len(words))
    if n == 0:
        return words
    last = len(words) - n + 1
    hashed = _mixed(words[:last] + np.uint64(n))
    for i in range(1, n):
        hashed = _mixed(hashed * np.uint64(0xFF51AFD7ED558CCD) + words[i : last + i])
    return hashed


def shingle_sets(texts: Sequence[str]) -> Iterator[np.ndarray]:
    """For each text the sorted set of its shingles' 64-bit hashes, in order.

    A-Z are lower-cased; words end at ASCII white space. Memory follows ``_SEGMENT``
    bytes, or eight bytes a word of the longest text.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode().lower()
        if len(data) > _SEGMENT:
            yield from _sets(held)
            held, size = [], 0
            yield np.unique(_of_words(_long_word_hashes(data)))
            continue
        if size + len(data) > _SEGMENT:
            yield from _sets(held)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    yield from _sets(held)


def _sets(held: list[bytes]) -> Iterator[np.ndarray]:
    if not held:
        return
    words, starts = _word_hashes(b"\n".join(held) + b"\n")
    ends = np.cumsum([len(d) + 1 for d in held])
    at = np.r_[0, np.searchsorted(starts, ends)]
    shingles = _of_words(words) if len(words) >= SHINGLE else words
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(shingles[a : b - SHINGLE + 1])
        else:
            yield np.unique(_of_words(words[a:b]))


def set_id(members: np.ndarray) -> int:
    """A 64-bit id of a set, the same wherever the set occurs."""
    digest = hashlib.blake2b(members.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)
