import random

import pytest

from tenuro.llm import decontamination as dc
from tests.llm import plain
from tests.llm.conftest import ODD, SF


def expected(rows, items, size=10):
    out = []
    for key, text in rows:
        n_words, n_hit, found = plain.passages(text, items, size)
        digest = plain.sha256(",".join(sorted(found)))
        out.append((key, n_words, n_hit, len(found), digest, n_hit > 0))
    return sorted(out, key=str)


def check(spark, rows, items, documents=None, **options):
    if documents is None:
        documents = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_benchmark_passages(documents, benchmark, **options).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, items, options.get("size", 10))


def made_up(seed):
    rng = random.Random(seed)
    words = ["a", "b", "É", "é", "c1", "the", "of"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 14)))) for i in range(25)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 30)))]
        if rng.random() < 0.6:
            parts.append(rng.choice(items)[1].upper() if rng.random() < 0.3 else rng.choice(items)[1])
        rows.append((i, ", ".join(parts)))
    return rows, items


@pytest.mark.parametrize("seed", range(2))
def test_dense_matches_against_plain_search(spark, seed):
    check(spark, *made_up(seed))


@pytest.mark.parametrize("bits", [6, 12, 26])
def test_without_a_broadcast(spark, monkeypatch, bits):
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(dc, "BITMAP_BITS", bits)
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    check(spark, *made_up(5))


def test_odd_rows(spark, odd, nothing):
    items = [(1, ODD[0][1]), (2, "one"), (3, None), (4, ""), (10, ODD[0][1]), (5, "日本語")]
    check(spark, ODD, items, odd)
    check(spark, ODD, [], odd)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert dc.find_benchmark_passages(nothing, benchmark).count() == 0
    kept = dc.without_benchmark_passages(odd, benchmark)
    assert kept.columns == odd.columns
    clean = [(k, t) for k, t in ODD if not plain.passages(t, items)[1]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)
    none = dc.without_benchmark_passages(odd, benchmark.limit(0))
    assert none.count() == len(ODD)


def test_plan_has_no_python(spark, documents, capsys):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    dc.find_benchmark_passages(documents, benchmark).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("small", [True, False])
def test_words_are_moved_by_no_exchange(spark, conf, capsys, small):
    conf("spark.sql.adaptive.enabled", "false")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = documents.selectExpr("doc_id AS doc", "text", "xxhash64(text) AS k")
    known = spark.createDataFrame([(1,), (2,)], "h long")
    dc._postings(rows, known, [2, 5], 10, small).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == 1 and "Python" not in plan
    # Documents come straight from their scan to what drops their places.
    stream = plan[: plan.index("BroadcastExchange")]
    assert "FileScan parquet" in stream and "Exchange" not in stream
    assert "SortMergeJoin" not in plan
    assert plan.count("regexp_extract_all") <= 2  # on ASCII and on other texts


def test_tables_are_deleted_once_used(spark, documents):
    import os

    from tenuro.functions.lineage import _session_folder

    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    folder = _session_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    for find, left in (
        (dc.find_benchmark_passages, ["hits", "rows"]),
        (dc.without_benchmark_passages, ["contaminated"]),
    ):
        result = find(documents, benchmark)
        new = set(os.listdir(folder)) - before
        assert sorted(name.rpartition("-")[0] for name in new) == left
        assert result.count() > 0
        before |= new
