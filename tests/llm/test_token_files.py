import zlib

import numpy as np
import pytest

from tenuro.functions.lineage import scratch_path
from tenuro.llm.token_files import (
    PerfectHash,
    open_shard,
    read_token_files,
    write_token_files,
)
from tests.llm import plain
from tests.llm.conftest import ODD


def expected(rows, end=2):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, start = [], 0
    for key, text in rows:
        ids = [*plain.token_ids(text), end]
        out.append((key, start, len(ids), zlib.crc32(plain.as_bytes(ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [50, 16_000_000])
def test_round_trip_of_odd_rows(spark, odd, shard_ids):
    manifest = write_token_files(
        odd, plain.VOCABULARY, scratch_path(spark, "files"), shard_ids=shard_ids
    )
    got = sorted((tuple(r) for r in read_token_files(manifest).collect()), key=lambda r: r[1])
    assert got == expected(ODD)


def test_keyed_access(spark, texts, documents):
    manifest = write_token_files(
        documents, plain.VOCABULARY, scratch_path(spark, "files"), shard_ids=20_000
    )
    shards = [open_shard(r.path) for r in manifest.collect()]
    for key, text in texts:
        found = [ids for shard in shards for ids in shard.get(key)]
        assert [f.tolist() for f in found] == [[*plain.token_ids(text), 2]]
    assert not any(shard.get(-5) or shard.get(10**12) for shard in shards)


def test_empty_table(spark, nothing):
    manifest = write_token_files(nothing, plain.VOCABULARY, scratch_path(spark, "files"))
    assert manifest.count() == 0 and read_token_files(manifest).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 10_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).integers(0, 2**64, n, np.uint64)
    index = PerfectHash.build(keys)
    assert sorted(index.slots(keys)) == list(range(n)) and index.size == n


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.build(np.array([7, 7], np.uint64))
