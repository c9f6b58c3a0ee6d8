"""Byte-pair encoding with a lexicon of frequent words kept as a transducer.

The words that are frequent in the corpus are compiled into a minimal acyclic
automaton. Its arcs carry numbers that add up to the index of the word, and the index
leads to the word's ids. All of it is one flat file that executors map into memory.
Words that the lexicon lacks are merged pair by pair, exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenuro.functions.lineage import scratch_path, written
from tenuro.llm.common import map_texts, releasing, table
from tenuro.llm.pieces import (
    LONG,
    PATTERN,
    SETTLED,
    Cache,
    cuttable,
    is_word,
    newer_letters,
    splitter,
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves, the others for the characters
    from U+0100 on, in order.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(others)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, file_text: str):
        file = json.loads(file_text)
        model = file["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("a byte-level BPE file without byte fallback is needed")
        if file["normalizer"] or file["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level file without a normalizer is needed")
        if file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("files that put a space before the text aren't supported")
        ids: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = [ids[s] for s in symbols]
        self.merges: dict[int, int] = {}  # pair -> rank and id of what it becomes
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = rank << 24 | ids[left + right]
            self.merges.setdefault(ids[left] << 24 | ids[right], made)
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("special tokens that take in white space aren't supported")
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = b"".join(
                bytes([byte_of[c]]) if c in byte_of else c.encode() for c in token
            )
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        # tiktoken merges the pair with the least id first, which is the same if ids rise
        # with ranks, and if no character of the word is one that it might split at.
        order = [made & 0xFFFFFF for made in self.merges.values()]
        self.fast = None
        if order == sorted(order) and max(self.byte_ids) < min(order, default=1 << 24):
            ranks = {self.token_bytes[i]: i for i in [*self.byte_ids, *order]}
            if len(ranks) == len(self.byte_ids) + len(order):
                self.fast = tiktoken.Encoding(
                    "words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
                ).encode_ordinary
        self.split_specials = (
            regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
            if self.specials
            else None
        )

    def ids_of(self, word: str) -> list[int]:
        """The ids of one pre-tokenized word of any length."""
        # On very long white space tiktoken's pattern would overflow its stack.
        if self.fast is not None and len(word) <= _FAST:
            if word.isascii() or max(word) < SETTLED:
                return self.fast(word)
        return self.merge(word.encode())

    def all_ids_of(self, words: Sequence[str]) -> list[bytes]:
        """The ids of each word as bytes; most words are merged in one call."""
        sep = self.byte_ids[10]
        together = [self._joinable(w) for w in words] if self.fast is not None else []
        some = [w for w, joined in zip(words, together) if joined]
        # A line feed between two words is a word of its own, and no such word has one.
        ids = np.array(self.fast("\n".join(some)) if some else [], "<u4")
        at = np.flatnonzero(ids == sep)
        if len(at) != len(some) - 1:
            return [array("I", self.ids_of(w)).tobytes() for w in words]
        blob = ids.tobytes()
        edges = zip([0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(blob)])
        found = iter([blob[a:b] for a, b in edges])
        return [
            next(found) if joined else array("I", self.ids_of(w)).tobytes()
            for w, joined in zip(words, together)
        ]

    @staticmethod
    def _joinable(word: str) -> bool:
        if not word.isprintable() or " " in (word[1:] or word) or len(word) > _FAST:
            return False
        return word.isascii() or max(word, default="") < SETTLED

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of least rank goes first, leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        return self._merge_long(ids) if len(ids) > LONG else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        find = self.merges.get
        best = [find(a << 24 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while best and (least := min(best)) is not _NONE:
            at = best.index(least)
            ids[at : at + 2] = [least & 0xFFFFFF]
            del best[at]
            if at:
                best[at - 1] = find(ids[at - 1] << 24 | ids[at], _NONE)
            if at < len(best):
                best[at] = find(ids[at] << 24 | ids[at + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, for words of any length.

        An entry of the heap is the rank of a pair and its place in one number; an entry
        whose place doesn't hold a pair of that rank any more is passed over.
        """
        find, n = self.merges.get, len(ids)
        now = array("i", ids)
        before, after = array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        heap = [
            made >> 24 << 40 | i
            for i in range(n - 1)
            if (made := find(now[i] << 24 | now[i + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            least = heapq.heappop(heap)
            i = least & _PLACE
            j = after[i]
            if now[i] < 0 or j >= n:
                continue
            made = find(now[i] << 24 | now[j])
            if made is None or made >> 24 != least >> 40:
                continue
            now[i], now[j] = made & 0xFFFFFF, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (new := find(now[i] << 24 | now[j])) is not None:
                    heapq.heappush(heap, new >> 24 << 40 | i)
            if (h := before[i]) >= 0 and (new := find(now[h] << 24 | now[i])) is not None:
                heapq.heappush(heap, new >> 24 << 40 | h)
        return [i for i in now if i >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode(errors="replace")


_NONE = 1 << 62
_PLACE = (1 << 40) - 1
#: Longer words, in characters, aren't left to tiktoken.
_FAST = 4096

# ---------------------------------------------------------------- the transducer


def _minimal(words: Sequence[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """States (byte -> state) and final flags of the least automaton; words are sorted."""
    arcs: list[dict[int, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}

    def settled(node: tuple[dict[int, int], bool]) -> int:
        key = (node[1], *node[0].items())
        if key not in known:
            known[key] = len(arcs)
            arcs.append(node[0])
            final.append(node[1])
        return known[key]

    path: list[list] = [[{}, False]]  # the states of the word before, not yet settled
    previous = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        for depth in range(len(previous), shared, -1):
            path[depth - 1][0][previous[depth - 1]] = settled(tuple(path.pop()))
        path.extend([{}, False] for _ in range(shared, len(word)))
        path[-1][1] = True
        previous = word
    for depth in range(len(previous), 0, -1):
        path[depth - 1][0][previous[depth - 1]] = settled(tuple(path.pop()))
    return arcs, final, settled(tuple(path[0]))


def compile_lexicon(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The file of a lexicon that maps words to ids.

    The arc of a state for byte b lies in cell base + b. A cell holds the base of the
    state it belongs to, the base it leads to, and how many words sort before those
    behind it; so the numbers on the way add up to the index of the word.
    """
    words = sorted(w for w in entries if w)
    arcs, final, root = _minimal(words)
    size = [0] * len(arcs)  # words from a state on; arcs lead to earlier states
    for s, targets in enumerate(arcs):
        size[s] = final[s] + sum(size[t] for t in targets.values())
    base, cells, taken, end = [0] * len(arcs), set(), set(), 1
    least = [1] * 256  # below it no state with an arc for that byte finds a place
    for s in sorted(range(len(arcs)), key=lambda s: -len(arcs[s])):
        labels = list(arcs[s])
        for b in labels:
            while least[b] in taken or least[b] + b in cells:
                least[b] += 1
        at = first = max((least[b] for b in labels), default=end)
        while at in taken or any(at + b in cells for b in labels):
            at += 1
            if at == first + 200:  # rather more room than more time
                at = max(at, end - min(labels))
        base[s], end = at, max(end, at + max(labels, default=0) + 1)
        taken.add(at)
        cells.update(at + b for b in labels)
    n_cells = end + 257
    owner, leads, skips = (array("I", bytes(4 * n_cells)) for _ in range(3))
    ends = array("I", bytes(4 * n_cells))
    for s in range(len(arcs)):
        ends[base[s]] = final[s]
        passed = int(final[s])
        for b in sorted(arcs[s]):
            cell, target = base[s] + b, arcs[s][b]
            owner[cell], leads[cell], skips[cell] = base[s], base[target], passed
            passed += size[target]
    starts, ids = array("I", [0]), array("I")
    for word in words:
        ids.extend(entries[word])
        starts.append(len(ids))
    head = struct.pack("<4I", n_cells, base[root] if words else 0, len(words), len(ids))
    return head + b"".join(a.tobytes() for a in (owner, leads, skips, ends, starts, ids))


class Lexicon:
    """A compiled lexicon; ``buffer`` may be a mapped file."""

    def __init__(self, buffer):
        cells, self.root, self.n_words, n_ids = struct.unpack_from("<4I", buffer)
        view = memoryview(buffer)[16:].cast("I")
        parts, at = [], 0
        for length in (cells, cells, cells, cells, self.n_words + 1, n_ids):
            parts.append(view[at : at + length])
            at += length
        self.owner, self.leads, self.skips, self.ends, self.starts, self.ids = parts

    def get(self, word: bytes) -> bytes | None:
        """The ids of ``word`` as bytes, or None for a word that isn't listed."""
        state, index = self.root, 0
        owner, leads, skips = self.owner, self.leads, self.skips
        if not state:
            return None
        for byte in word:
            cell = state + byte
            if owner[cell] != state:
                return None
            state = leads[cell]
            index += skips[cell]
        if not self.ends[state]:
            return None
        return self.ids[self.starts[index] : self.starts[index + 1]].tobytes()

    def all_of(self, words: Sequence[bytes]) -> list[bytes | None]:
        """``get`` for each of many words, which walk the automaton together."""
        found: list[bytes | None] = [None] * len(words)
        if not self.root:
            return found
        owner, leads, skips = (np.asarray(x) for x in (self.owner, self.leads, self.skips))
        letters = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        walking = np.flatnonzero(lengths)
        state = np.full(len(walking), self.root, np.int64)
        index = np.zeros(len(walking), np.int64)
        step = 0
        while len(walking):
            cell = state + letters[starts[walking] + step]
            on = owner[cell] == state
            walking, cell, index = walking[on], cell[on], index[on]
            state, index = leads[cell].astype(np.int64), index + skips[cell]
            step += 1
            done = lengths[walking] == step
            for word, end, i in zip(*(x[done].tolist() for x in (walking, state, index))):
                if self.ends[end]:
                    found[word] = self.ids[self.starts[i] : self.starts[i + 1]].tobytes()
            walking, state, index = walking[~done], state[~done], index[~done]
        return found


# ---------------------------------------------------------------- encoding


class Encoder:
    """Encodes texts: lexicon first, merging for the rest; pieces are kept for reuse."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, newer: str = ""):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.split = splitter(newer)
        self.words = Cache(self._words, 60_000)
        self.pieces = Cache(self._pieces, 150_000)

    def _words(self, words: list[str]) -> list[bytes]:
        found = self.lexicon.all_of([w.encode() for w in words])
        rest = [w for w, ids in zip(words, found) if ids is None]
        merged = iter(self.vocabulary.all_ids_of(rest))
        return [next(merged) if ids is None else ids for ids in found]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return self._strings([f" {piece}" for piece in pieces])

    def _strings(self, strings: list[str]) -> list[bytes]:
        """The ids of each; words that aren't remembered are looked up together."""
        words: list[str] = []
        ends = []
        for string in strings:
            if is_word(string):
                words.append(string)
            else:
                words.extend(self.split(string))
            ends.append(len(words))
        new = list(set(words).difference(self.words))
        ids_of_new = dict(zip(new, self._words(new)))
        found = [ids_of_new[w] if w in ids_of_new else self.words[w] for w in words]
        for word, ids in ids_of_new.items():
            self.words.keep(word, ids)
        starts = [0, *ends[:-1]]
        return [
            found[a] if b == a + 1 else b"".join(found[a:b]) for a, b in zip(starts, ends)
        ]

    def plain(self, text: str) -> bytes:
        return self._strings([text])[0]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """``encode`` for each of some texts; what isn't remembered is worked out together."""
        special, split = self.vocabulary.specials, self.vocabulary.split_specials
        parts = [
            split.split(text) if split and any(s in text for s in special) else [text]
            for text in texts
        ]
        done = iter(self._parts([p for of_text in parts for p in of_text if p not in special]))
        return [
            b"".join(
                struct.pack("<I", special[p]) if p in special else next(done) for p in of_text
            )
            for of_text in parts
        ]

    def _parts(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that have no special tokens."""
        cut = [text.split(" ") if cuttable(text) else [text] for text in texts]
        begun = {pieces[0] for pieces in cut}
        new = set().union(*(pieces[1:] for pieces in cut)).difference(self.pieces)
        starts, new = list(begun), list(new)
        ids = self._strings(starts + [f" {piece}" for piece in new])
        first = dict(zip(starts, ids))
        of_new = dict(zip(new, ids[len(starts) :]))
        known = {**self.pieces, **of_new}
        found = [
            first[pieces[0]] + b"".join(map(known.__getitem__, pieces[1:])) for pieces in cut
        ]
        for piece, value in of_new.items():
            self.pieces.keep(piece, value)
        return found


def frequent_words(
    df: DataFrame, text: str = "text", size: int = 131_072, held: int = 200_000
) -> DataFrame:
    """Words that make up at least one in ``size`` of all: ``word`` (binary), ``n``.

    There are ``size`` of them at most. Each task counts the pieces between spaces, with
    at most ``held`` different ones in memory, and hands on the words that reach the share
    in what it has counted, as one that reaches it nowhere doesn't reach it overall. A
    word's ``n`` leaves out the parts where it is rarer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: Counter[str] = Counter()  # pieces with no space before them
        pieces: Counter[str] = Counter()
        split = splitter("")

        def flushed() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for prefix, counts in (("", begun), (" ", pieces)):
                # Those met once are split together, at the spaces that they stood between.
                once = [p for p, n in counts.items() if prefix and n == 1 and p[-1:].isprintable()]
                words.update(split(prefix + " ".join(filter(None, once))) if any(once) else [])
                for piece, n in counts.items():
                    if n == 1 and prefix and piece and piece[-1:].isprintable():
                        continue
                    if is_word(piece):
                        words[prefix + piece] += n
                        continue
                    for word in split(prefix + piece):
                        words[word] += n
                counts.clear()
            total = words.total()
            shown = [(w.encode(), n) for w, n in words.items() if n * size >= total]
            shown.append((None, total))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([w for w, _ in shown], pa.binary()),
                    pa.array([n for _, n in shown], pa.int64()),
                ],
                names=["word", "n"],
            )

        for batch in batches:
            for value in batch.column(0).to_pylist():
                if not value:
                    continue
                if cuttable(value):
                    first, *rest = value.split(" ")
                    begun[first] += 1
                    pieces.update(rest)
                else:
                    begun.update(split(value))
                if len(pieces) + len(begun) > held:
                    yield flushed()
        yield flushed()

    counted = written(
        df.select(text)
        .mapInArrow(releasing(run), "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n")),
        "word-counts",
    )
    total = counted.where("word IS NULL").select(F.sum("n")).first()[0] or 0
    return counted.where(F.col("word").isNotNull() & (F.col("n") * size >= total))


def build_lexicon(
    df: DataFrame, vocabulary: Vocabulary, text: str = "text", size: int = 131_072
) -> bytes:
    """A compiled lexicon of the words of up to 64 bytes that are one in ``size``.

    ``size`` bounds what comes to the driver; counts cover all rows. Which words are
    in the lexicon has no influence on ids, only on the time they take.
    """
    rows = frequent_words(df, text, size).where(F.length("word") <= LONG).collect()
    words = [bytes(row.word) for row in rows]
    return compile_lexicon({w: vocabulary.merge(w) for w in words})


def share_file(spark: SparkSession, content: bytes, name: str) -> str:
    """Write a small file to the shared folder and have every executor fetch it."""
    name = f"{name}-{uuid.uuid4().hex}"
    path = f"{scratch_path(spark, 'files')}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = system.create(target)
    stream.write(bytearray(content))
    stream.close()
    spark.sparkContext.addFile(str(system.makeQualified(target).toString()))
    return name


@lru_cache(maxsize=2)
def _encoder(vocabulary_name: str, lexicon_name: str, newer: str) -> Encoder:
    """One for each worker and lexicon, kept from task to task."""
    with open(SparkFiles.get(vocabulary_name), encoding="utf-8") as file:
        vocabulary = Vocabulary(file.read())
    with open(SparkFiles.get(lexicon_name), "rb") as file:
        mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    return Encoder(vocabulary, Lexicon(mapped), newer)


def encode_texts(
    df: DataFrame,
    vocabulary_path: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    lexicon_words: int = 131_072,
    with_ids: bool = False,
) -> DataFrame:
    """Encode every text and decode the ids again.

    Gives columns ``keep``, ``n_tokens``, ``ids_sha256`` of the ids as little-endian
    unsigned 32-bit integers, ``decoded_sha256`` of the decoded text in UTF-8, and with
    ``with_ids`` also ``ids`` (array of int) and ``decoded``. One row each, also for
    repeated rows; a null counts as the empty text, which has no ids. Strings of special
    tokens inside a text become their ids, as in the ``tokenizers`` library.
    """
    spark = df.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        file_text = file.read()
    lexicon = build_lexicon(df, Vocabulary(file_text), text, lexicon_words)
    names = (
        share_file(spark, file_text.encode(), "vocabulary"),
        share_file(spark, lexicon, "lexicon"),
        newer_letters(file_text),
    )

    def prepare():
        encoder = _encoder(*names)

        def measure(texts: list[str]) -> list[list]:
            rows = []
            for blob in encoder.encode_all(texts):
                ids = np.frombuffer(blob, "<u4")
                decoded = encoder.vocabulary.decode(ids.tolist())
                row = (
                    len(ids),
                    hashlib.sha256(blob).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                )
                rows.append((*row, ids.astype("<i4"), decoded) if with_ids else row)
            return [list(column) for column in zip(*rows, strict=True)]

        return measure

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += ", ids array<int>, decoded string"
    return map_texts(df, text, keep, fields, prepare)


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_texts(documents, public_tokenizers.path("byte_bpe_50k.json"))
