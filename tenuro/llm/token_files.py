"""Token ids in binary shards, with a minimal perfect hash index over document keys.

A shard is one file: a head, the index, and the raw ids, little-endian, two bytes each
if every id fits and four otherwise. The index maps a key to a slot in constant time,
by levels of bit arrays that hold each key where it doesn't collide. The slot has a
fingerprint, which tells keys that aren't there, and the number of the key's first
record; records know where their ids start. A shard may be mapped into memory.

Shards are written by tasks, each under a name of its own, and count only once the
manifest, a table in the same folder, lists them. A task that is run again leaves a
file that nobody reads.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tenuro.functions.lineage import scratch_path
from tenuro.llm.common import slices, table
from tenuro.llm.pieces import cuttable

MAGIC = b"TIDS0001"
_HEAD = struct.Struct("<8s6Q")  # magic, id bytes, records, nulls, keys, levels, ids
_LEVEL_GROWTH = 2.0
MANIFEST = (
    "part int, seq int, path string, n_docs long, n_ids long, "
    "first_key long, last_key long"
)


# ---------------------------------------------------------------- minimal perfect hash


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers that differs with ``seed``."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 0x5EED) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Numbers distinct 64-bit keys from 0 on, without gaps, in constant time."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # one uint64 word holds 64 bits
        ranks, total = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            ranks.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.ranks, self.size = ranks, total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys.astype(np.uint64)
        while len(rest):
            n_words = int(len(rest) * _LEVEL_GROWTH) // 64 + 1
            at = _mixed(rest, len(levels) + 1) % np.uint64(64 * n_words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * n_words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at.astype(np.int64)]]
            if len(levels) > 200:
                raise ValueError("keys must be distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some keys that weren't there at the build."""
        found = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for i, words in enumerate(self.levels):
            at = _mixed(keys[rest], i + 1) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            number = self.ranks[i][word] + np.bitwise_count(below)
            found[rest[hit]] = number[hit]
            rest = rest[~hit]
        return found


# ---------------------------------------------------------------- shards


def pack_shard(keys: list[int | None], ids: list[bytes], id_bytes: int) -> list[bytes]:
    """One shard, in parts; records are in the order given, null keys first, equal keys
    together. Each record's ids are little-endian integers of ``id_bytes``.
    """
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], np.int64)
    first = np.flatnonzero(np.r_[True, known[1:] != known[:-1]][: len(known)])
    distinct = known[first].view(np.uint64)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    prints, records = np.zeros(len(first), "<u4"), np.zeros(len(first), "<u4")
    prints[slots], records[slots] = _fingerprints(distinct), nulls + first
    starts = np.zeros(len(keys) + 1, "<u8")
    np.cumsum([len(i) // id_bytes for i in ids], out=starts[1:])
    head = _HEAD.pack(
        MAGIC, id_bytes, len(keys), nulls, len(first), len(index.levels), int(starts[-1])
    )
    sizes = np.array([len(words) for words in index.levels], "<u8")
    parts = [sizes, *index.levels, starts, known.astype("<i8"), prints, records]
    packed = head + b"".join(p.tobytes() for p in parts)
    return [packed, bytes(-len(packed) % 8), *ids]


class Shard:
    """Keyed access to the ids in the bytes of a shard, which may be a mapped file."""

    def __init__(self, buffer):
        magic, width, self.n_docs, self.nulls, n_keys, n_levels, n_ids = _HEAD.unpack_from(
            buffer
        )
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(buffer, kind, count, at)
            at += part.nbytes
            return part

        sizes = take("<u8", n_levels)
        self.index = PerfectHash([take("<u8", int(n)) for n in sizes])
        self.starts = take("<u8", self.n_docs + 1)
        self.keys = take("<i8", self.n_docs - self.nulls)
        self.prints, self.records = take("<u4", n_keys), take("<u4", n_keys)
        at += -at % 8
        self.payload = take(f"<u{width}", n_ids)

    def first_records(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, by the index; -1 for a key that isn't here."""
        keys = keys.astype(np.int64).view(np.uint64)
        slots = self.index.slots(keys)
        found = slots >= 0
        found[found] = self.prints[slots[found]] == _fingerprints(keys[found])
        return np.where(found, self.records[slots * found], -1) if len(slots) else slots

    def ids(self, record: int) -> np.ndarray:
        return self.payload[int(self.starts[record]) : int(self.starts[record + 1])]

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every record with ``key``; usually one, and none for unknown keys."""
        record = int(self.first_records(np.array([key], np.int64))[0])
        out = []
        while 0 <= record < self.n_docs and self.keys[record - self.nulls] == key:
            out.append(self.ids(record))
            record += 1
        return out


def open_shard(path: str) -> Shard:
    """A shard by its path; local files are mapped into memory."""
    system, inner = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return Shard(pa.memory_map(inner).read_buffer())
    with system.open_input_file(inner) as file:
        return Shard(file.read_buffer())


# ---------------------------------------------------------------- encoding


class PieceEncoder:
    """Ids of texts from the ``tokenizers`` library, which sees each piece once.

    Pieces are what stands between spaces (see :mod:`tenuro.llm.pieces`). Up to about
    ``limit`` of them are kept, as integers of ``id_bytes``, then all are forgotten.
    """

    def __init__(self, tokenizer_json: str, id_bytes: int = 4, limit: int = 800_000):
        from tokenizers import Tokenizer

        # Tasks have a core each; the library's own threads would only hold more memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(tokenizer_json)
        self.batch, self.limit = tokenizer.encode_batch_fast, limit
        self.width = f"<u{id_bytes}"
        self.specials = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        # In a byte-level vocabulary the symbol of a space opens a token or isn't in it.
        (space,) = self.batch([" "], add_special_tokens=False)
        symbol = tokenizer.id_to_token(space.ids[0])
        self.opens = np.zeros(tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in tokenizer.get_vocab().items() if t.startswith(symbol)]] = True

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.batch(texts, add_special_tokens=False)
        return [np.array(e.ids, self.width) for e in found]

    def learned(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces, each as it is after a space, for this time and later."""
        plain, odd = [], []
        for piece in pieces:
            # White space at an end would run into the space beside it.
            joins = piece and not piece[0].isspace() and not piece[-1].isspace()
            (plain if joins else odd).append(piece)
        new: dict[str, bytes] = {}
        # Joined by spaces, so that the library takes many at a time: each begins with the
        # token that has its space.
        for at in range(0, len(plain), 500):
            part = plain[at : at + 500]
            (ids,) = self.whole(["".join(f" {piece}" for piece in part)])
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(part):
                odd += part
                continue
            blob, places = ids.tobytes(), [*(cuts * ids.itemsize).tolist(), None]
            for piece, start, stop in zip(part, places, places[1:]):
                new[piece] = blob[start:stop]
        apart = self.whole([f" {piece}" for piece in odd])
        new.update((piece, ids.tobytes()) for piece, ids in zip(odd, apart, strict=True))
        if len(self.known) > self.limit:
            self.known.clear()
        self.known.update(new)
        return new

    def encode(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """The ids of each text as bytes, with ``end`` after them."""
        begun, found, gaps = [], [], []
        unknown: set[str] = set()
        for text in texts:
            ids: list[bytes] = []
            if cuttable(text) and not any(s in text for s in self.specials):
                # What doesn't come after a space, and texts that can't be cut, are
                # encoded apart.
                text, *rest = text.split(" ")
                ids = list(map(self.known.get, rest))
                if None in ids:
                    missing = [(i, rest[i]) for i, known in enumerate(ids) if known is None]
                    unknown.update(piece for _, piece in missing)
                    gaps.append((ids, missing))
            begun.append(text)
            found.append(ids)
        new = self.learned(unknown)
        for ids, missing in gaps:
            for i, piece in missing:
                ids[i] = new[piece]
        return [
            b"".join((b.tobytes(), *ids, end)) for b, ids in zip(self.whole(begun), found)
        ]


@lru_cache(maxsize=2)
def _encoder(tokenizer_json: str, id_bytes: int) -> PieceEncoder:
    """One for each worker, kept from task to task."""
    return PieceEncoder(tokenizer_json, id_bytes)


def write_token_files(
    df: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    shard_ids: int = 16_000_000,
) -> DataFrame:
    """Encode every text, append ``end_id``, and write shards in ascending order of key.

    Returns the manifest: one row a shard, with the place of its first id among all ids
    (``start``). ``key`` is an integer column. Null keys come first, repeated keys stand
    side by side in the order of their texts, a null text counts as empty. ``shard_ids``
    bounds a shard and with it a task's memory, but never splits a document. ``folder``
    is one that all executors reach. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_str(content).get_vocab_size() - 1, end_id)
    id_bytes = 2 if most < 1 << 16 else 4
    shared = spark.sparkContext.broadcast(content)
    root = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, id_bytes)
        end = np.array([end_id], f"<u{id_bytes}").tobytes()
        system, inner = fs.FileSystem.from_uri(root)
        system.create_dir(inner, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def write() -> pa.RecordBatch:
            name = f"shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            with system.open_output_stream(f"{inner}/{name}") as stream:
                for packed in pack_shard(keys, ids, id_bytes):
                    stream.write(packed)
            known = [k for k in keys if k is not None] or [None]
            row = (part, seq, f"{root}/{name}", len(keys), held, known[0], known[-1])
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names
            )

        for batch in batches:
            for rows in slices(batch, "text", 2_000_000):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                found = encoder.encode(texts, end)
                for k, new in zip(rows.column("key").to_pylist(), found):
                    keys.append(k)
                    ids.append(new)
                    held += len(new) // id_bytes
                    if held >= shard_ids:
                        yield write()
                        keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield write()

    types = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
    names = ["part", "seq", "path", "n_docs", "n_ids", "first_key", "last_key"]
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(
        F.col("key").asc_nulls_first(), "text"
    )
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row a shard meets in this window, however large the shards are.
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))
    return manifest.withColumn("start", start)


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: key, ``start``, ``n_tokens`` and ``ids_crc32``, from the files.

    Every key is looked up in its shard's index; null keys have no index and are read
    by position. ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                shard = open_shard(path)
                first = shard.first_records(shard.keys)
                if (shard.keys[first - shard.nulls] != shard.keys).any():
                    raise ValueError(f"{path}: the index doesn't lead to its keys")
                # Records of a repeated key follow the one that the index knows.
                n = len(first)
                repeat = np.arange(n) - (first - shard.nulls) if n else first
                record = np.r_[np.arange(shard.nulls), first + repeat].astype(np.int64)
                crc = [zlib.crc32(shard.ids(r).astype("<u4").tobytes()) for r in record]
                begins = shard.starts[record].astype(np.int64)
                ends = shard.starts[record + 1].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None] * shard.nulls + shard.keys.tolist(), pa.int64()),
                        pa.array(start + begins),
                        pa.array(ends - begins),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[key, "start", "n_tokens", "ids_crc32"],
                )

    spark = manifest.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        manifest.select("path", "start")
        .repartition(tasks, "path")
        .mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files of 16 million ids and read back."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = write_token_files(
        documents,
        public_tokenizers.path("byte_bpe_50k.json"),
        scratch_path(spark, "token-files"),
    )
    return read_token_files(manifest)
