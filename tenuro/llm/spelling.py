"""Groups of spelling variants: words one edit apart, found through Bloom filters.

The vocabulary is put into blocked Bloom filters, one for each length of word, whose size
is bounded and which every executor gets. Each word's edits are then probed: all its
deletions, and all replacements by a later letter, so that every pair of near words comes
up from one side. The hash of an edit follows from the hash of the word, so edits are
only spelled out where a filter says yes. Those go to a join with the vocabulary, which
removes the false ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenuro.functions.lineage import written
from tenuro.llm.common import slices, table

#: Letters of words, lower-cased from A-Z only (fixed values).
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_CODES = np.array([ord(c) for c in LETTERS], np.int64)
#: Words of more letters share one filter.
_LONGEST = 64
#: Words of a block of 512 bits at least, and bits set in it for each.
_BLOCK_WORDS, _PROBES = 32, 7
_RADIX = 0x9E3779B97F4A7C15
#: Edits whose hashes are taken at a time.
_CELLS = 2_000_000


# ---------------------------------------------------------------- the vocabulary


def occurring_words(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_letters: int = 6,
    least_n: int = 5,
    slip_every: int | None = 199,
    held: int = 500_000,
) -> DataFrame:
    """(``word``, ``n``): words of ``least_letters`` or more that occur ``least_n`` times.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. With
    ``slip_every``, where it divides the CRC-32 of ``key:word``, the word loses the letter
    at the place that the CRC-32 gives modulo its length: slips of known places, the same
    on each run. Each task counts with at most ``held`` different words in memory; sums
    cover all texts. A null text has no words and a null key counts as an empty one.
    """
    longest = max(1, least_letters)
    pattern = re.compile(f"[A-Za-z\\u00C0-\\u00FF]{{{longest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())],
                names=["word", "n"],
            )
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                rows = zip(part.column("key").to_pylist(), part.column("text").to_pylist())
                for name, value in rows:
                    if not value:
                        continue
                    # Bytes are lower-cased in ASCII only.
                    runs = pattern.findall(value.encode().lower().decode())
                    if slip_every is None:
                        counts.update(runs)
                    else:
                        begin = zlib.crc32(f"{name}:".encode())
                        for word, n in Counter(runs).items():
                            h = zlib.crc32(word.encode(), begin)
                            if h % slip_every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_letters:
                                    continue
                            counts[word] += n
                    if len(counts) > held:
                        yield flushed()
        yield flushed()

    rows = df.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text")
    )
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word")
    return counted.agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# ---------------------------------------------------------------- filters


@lru_cache(maxsize=4)
def _powers(size: int) -> np.ndarray:
    factors = np.full(size, _RADIX, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(codes: np.ndarray) -> np.ndarray:
    """A sum over the letters of each word (a row of ``codes``), not yet mixed."""
    powers = _powers(max(64, 1 << int(codes.shape[1]).bit_length()))[: codes.shape[1]]
    return (codes.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)


def _places(sums: np.ndarray, length: int, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each word, and a hash that gives its bits in the block."""
    first = _mixed(sums + np.uint64(length * 0xD6E8FEB86659FD93 % 2**64))
    second = _mixed(first + np.uint64(0x632BE59BD9B4E019))
    return (first % np.uint64(n_blocks)).astype(np.int64), second


def _shard(length: int) -> int:
    return min(length, _LONGEST + 1)


class Shard(NamedTuple):
    """The filter of words of one length: blocks of eight 64-bit integers."""

    letters: np.ndarray  # code points that occur in its words
    blocks: np.ndarray

    def holds(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Indexes of the words that the filter has, with some that it hasn't."""
        block, bits = _places(sums, length, len(self.blocks))
        left = np.arange(len(sums))
        for _ in range(_PROBES):
            bit = bits & np.uint64(511)
            word = self.blocks[block, (bit >> np.uint64(6)).astype(np.int64)]
            hit = (word >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
            left, block, bits = left[hit], block[hit], bits[hit] >> np.uint64(9)
        return left


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Words of one length at a time: the length, their letters' code points, the words."""
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    for length, group in groups.items():
        step = max(1, _CELLS // length)
        for i in range(0, len(group), step):
            part = group[i : i + step]
            # All letters are below U+0100, so Latin-1 has one byte for each.
            letters = np.frombuffer("".join(part).encode("latin-1"), np.uint8)
            yield length, letters.reshape(len(part), length).astype(np.int64), part


def build_filters(vocabulary: DataFrame, most_bytes: int = 32 << 20) -> dict[int, Shard]:
    """The filters of all words, of ``most_bytes`` at most in all.

    Sixteen bits a word as long as that suffices; then fewer, and more edits go to the
    join, whose result is the same.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for length, codes, words in _by_length(batch.column(0).to_pylist()):
                held = found.setdefault(_shard(length), [0, np.zeros(256, bool)])
                held[0] += len(words)
                held[1][np.unique(codes)] = True
        masks = [np.packbits(seen, bitorder="little").view("<i8") for _, seen in found.values()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(found), pa.int32()),
                pa.array([n for n, _ in found.values()], pa.int64()),
                *(pa.array([int(m[i]) for m in masks], pa.int64()) for i in range(4)),
            ],
            names=["shard", "n", *(f"letters{i}" for i in range(4))],
        )

    four = [f"letters{i}" for i in range(4)]
    # One row for each length up to _LONGEST.
    rows = (
        vocabulary.select("word")
        .mapInArrow(sizes, "shard int, n long, " + ", ".join(f"{c} long" for c in four))
        .groupBy("shard")
        .agg(F.sum("n").alias("n"), *(F.bit_or(c).alias(c) for c in four))
        .collect()
    )
    total = sum(row.n for row in rows)
    bounded = max(1, most_bytes // 64 - len(rows))
    share = min(1.0, bounded * _BLOCK_WORDS / total) if total else 1.0
    n_blocks = {row.shard: int(row.n * share) // _BLOCK_WORDS + 1 for row in rows}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, codes, _ in _by_length(batch.column(0).to_pylist()):
                shard = _shard(length)
                block, bits = _places(_sums(codes), length, n_blocks[shard])
                masks = np.zeros((len(block), 8), np.uint64)
                each = np.arange(len(block))
                for i in range(_PROBES):
                    bit = bits >> np.uint64(9 * i) & np.uint64(511)
                    masks[each, (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (
                        bit & np.uint64(63)
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(block), shard, np.int32)),
                        pa.array(block),
                        *(pa.array(masks[:, i].view(np.int64)) for i in range(8)),
                    ],
                    names=["shard", "block", *eight],
                )

    eight = [f"bits{i}" for i in range(8)]
    blocks = (
        vocabulary.select("word")
        .mapInArrow(marked, "shard int, block long, " + ", ".join(f"{c} long" for c in eight))
        .groupBy("shard", "block")
        .agg(*(F.bit_or(c).alias(c) for c in eight))
    )
    filters = {}
    for row in rows:
        mask = np.array([row[c] for c in four], "<i8").view(np.uint8)
        letters = np.flatnonzero(np.unpackbits(mask, bitorder="little"))
        filters[row.shard] = Shard(letters, np.zeros((n_blocks[row.shard], 8), np.uint64))
    for row in blocks.toLocalIterator():
        filters[row.shard].blocks[row.block] = np.array(row[2:], np.int64).view(np.uint64)
    return filters


# ---------------------------------------------------------------- neighbourhoods


def _positive_edits(word_list: list[str], filters: dict[int, Shard]) -> Iterator[tuple[str, str]]:
    """Pairs of a word and an edit of it that a filter has."""
    for length, codes, words in _by_length(word_list):
        sums = _sums(codes)
        powers = _powers(max(64, 1 << length.bit_length()))
        step = max(1, _CELLS // len(words))
        shorter, same = filters.get(_shard(length - 1)), filters.get(_shard(length))
        if shorter is not None and length > 1:
            # The sum without letter i: those before it stay, those behind move up by one.
            terms = codes.astype(np.uint64) * powers[:length]
            upto = np.cumsum(terms, axis=1, dtype=np.uint64)
            behind = (sums[:, None] - upto) * np.uint64(pow(_RADIX, -1, 2**64))
            without = (upto - terms + behind).ravel()
            for start in range(0, len(without), _CELLS):
                for at in (start + shorter.holds(without[start : start + _CELLS], length - 1)).tolist():
                    word, i = words[at // length], at % length
                    # Of equal letters in a row one deletion is enough.
                    if i == 0 or word[i - 1] != word[i]:
                        yield word, word[:i] + word[i + 1 :]
        if same is None:
            continue
        letters = same.letters
        step = max(1, _CELLS // (len(words) * max(1, len(letters))))
        for start in range(0, length, step):
            part = codes[:, start : start + step]
            more = letters[None, None, :] - part[:, :, None]
            row, i, j = np.nonzero(more > 0)
            new = sums[row] + more[row, i, j].astype(np.uint64) * powers[start + i]
            for at in same.holds(new, length).tolist():
                word, place = words[row[at]], start + int(i[at])
                yield word, word[:place] + chr(letters[j[at]]) + word[place + 1 :]


def near_words(vocabulary: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """(``word``, ``n``, ``near``, ``near_n``): words one insertion, deletion or
    replacement apart, each pair in both directions.

    ``vocabulary`` has distinct words (``word``, ``n``) of letters in ``LETTERS``. No two
    words are compared but those that a filter proposes.
    """
    filters = build_filters(vocabulary, most_bytes)
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = dict(zip(*(c.to_pylist() for c in batch.columns)))
            found: list[tuple[str, str]] = []
            size = 0
            for pair in _positive_edits(list(counts), shared.value):
                found.append(pair)
                size += len(pair[0]) + len(pair[1]) + 16
                if size > _CELLS:
                    yield batch_of(found, counts)
                    found, size = [], 0
            if found:
                yield batch_of(found, counts)

    def batch_of(found: list[tuple[str, str]], counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([w for w, _ in found], pa.string()),
                pa.array([counts[w] for w, _ in found], pa.int64()),
                pa.array([e for _, e in found], pa.string()),
            ],
            names=["word", "n", "near"],
        )

    # Words are few bytes and much work, more than their size tells adaptive execution.
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = vocabulary.select("word", "n").repartition(tasks, "word")
    edits = spread.mapInArrow(run, "word string, n long, near string")
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = written(edits.join(known, "near").select("word", "n", "near", "near_n"), "near-words")
    shared.unpersist()
    turned = pairs.select(
        F.col("near").alias("word"),
        F.col("near_n").alias("n"),
        F.col("word").alias("near"),
        F.col("n").alias("near_n"),
    )
    return pairs.unionByName(turned)


# ---------------------------------------------------------------- groups


def spelling_groups(
    vocabulary: DataFrame, factor: int = 5, most_bytes: int = 32 << 20
) -> DataFrame:
    """Per word: ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    ``form`` is the near word of largest ``n`` (of equals the first in code-point order),
    if that is at least ``factor`` (2 or more) times the word's; else null. ``root`` is
    what following forms leads to, the word itself without one. A form occurs ``factor``
    times as often, so chains are short, and each round doubles what they have followed.
    """
    if factor < 2:
        raise ValueError("chains of forms end only for factors of 2 or more")
    near = near_words(vocabulary, most_bytes)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    common = -F.col("best.less") >= factor * F.col("n")
    words = written(
        vocabulary.join(best, "word", "left").select(
            "word",
            F.when(common, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, -F.col("best.less")).alias("form_n"),
        ),
        "words",
    )
    followed = words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = followed.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = followed.join(further, "root", "left")
        followed = written(
            joined.select("word", F.coalesce("further", "root").alias("root"), "further"),
            "roots",
        )
        if followed.where("further IS NOT NULL").isEmpty():
            break
        followed = followed.drop("further")
    roots = followed.select("word", "root")
    return words.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return spelling_groups(written(occurring_words(documents), "vocabulary"))
