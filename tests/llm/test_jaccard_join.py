import random

import numpy as np
import pytest

from tenuro.llm import jaccard_join as jj
from tenuro.llm.components import components, joined_groups
from tenuro.llm.shingles import shingle_sets
from tests.llm import plain
from tests.llm.conftest import LONG, ODD


def near_copies(seed=3, groups=12, size=8):
    """Texts in groups of which each member has some words of its own."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, 90))
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words += rng.choices(vocabulary, k=rng.randint(1, 30))
            rows.append((len(rows), " ".join(words)))
    return rows


def check(spark, rows, df=None, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string") if df is None else df
    got = jj.similar_documents(df, **options).collect()
    expected = [(k, *e) for (k, _), e in zip(rows, plain.component_ids(rows))]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(
        expected, key=str
    )


@pytest.mark.parametrize("bits", [12, 20])
def test_near_copies_against_all_pairs(spark, bits):
    check(spark, near_copies(), sketch_bits=bits)


def test_the_product_finds_what_the_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(jj, "_ROUNDS", 0)
    monkeypatch.setattr(jj, "_star_pairs", lambda blocks, real=jj._star_pairs: real(blocks).limit(0))
    check(spark, near_copies(seed=4))


@pytest.mark.parametrize("long", [2, 1000])
def test_the_product_of_long_blocks(spark, monkeypatch, long):
    monkeypatch.setattr(jj, "_star_pairs", lambda blocks, real=jj._star_pairs: real(blocks).limit(0))
    monkeypatch.setattr(jj, "_ROUNDS", 0)
    monkeypatch.setattr(jj, "_PROBED", 2)
    monkeypatch.setattr(jj, "_LONG", long)
    monkeypatch.setattr(jj, "_SHARE", 3)
    check(spark, near_copies(seed=6, groups=6))
    check(spark, common_line(40))


def common_line(n, seed=8):
    """A third of all documents share a line, which is all that some of them have in common."""
    rng = random.Random(seed)
    line = "this line of eight words is very common"
    rows = []
    for i in range(n):
        own = " ".join(rng.choices([f"w{j}" for j in range(400)], k=rng.randint(0, 12)))
        rows.append((i, f"{line} {own}" if i % 3 == 0 else own))
    return rows


@pytest.mark.parametrize("hot", [0, 3])
def test_very_common_n_grams_have_several_places(spark, monkeypatch, hot):
    monkeypatch.setattr(jj, "_HOT", hot)
    monkeypatch.setattr(jj, "_PLACES", 3)
    check(spark, common_line(60))
    check(spark, near_copies(seed=9, groups=4))


def test_the_product_takes_each_pair_once(spark, monkeypatch):
    """All cells that leave a long block are links, and none leaves two."""
    found = []

    def counted(rows, members, real=jj._long_links):
        links = real(rows, members)
        found.extend(tuple(r) for r in links.collect())
        return links

    monkeypatch.setattr(jj, "_star_pairs", lambda blocks, real=jj._star_pairs: real(blocks).limit(0))
    monkeypatch.setattr(jj, "_ROUNDS", 0)
    monkeypatch.setattr(jj, "_PROBED", 2)
    monkeypatch.setattr(jj, "_LONG", 2)
    monkeypatch.setattr(jj, "_long_links", counted)
    check(spark, near_copies(seed=6, groups=4))
    assert found and len(found) == len(set(found))


def test_probes_find_what_the_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(jj, "_star_pairs", lambda blocks, real=jj._star_pairs: real(blocks).limit(0))
    check(spark, near_copies(seed=5, groups=3, size=40))


def test_documents_against_all_pairs(spark, documents, texts):
    check(spark, texts, documents)


def test_odd_rows(spark, odd, nothing):
    check(spark, ODD, odd)
    assert jj.similar_documents(nothing).count() == 0


def test_one_of_each_group_stays(odd, nothing):
    kept = jj.one_of_each_group(odd)
    assert kept.columns == odd.columns
    # The null key is the least of its group; wordless texts all stay.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        map(str, [None, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11])
    )
    assert jj.one_of_each_group(nothing).count() == 0


def test_shingle_sets_have_the_right_sizes():
    rows = [*near_copies(), *ODD, (0, "a b c d e a b c d e a"), (0, "A b\x0bC")]
    texts = [t or "" for _, t in rows]
    sets = list(shingle_sets(texts))
    assert [len(s) for s in sets] == [len(plain.shingles(t)) for t in texts]
    assert np.array_equal(sets[-1], next(shingle_sets([" a  B c"])))
    assert len(next(shingle_sets([LONG * 8]))) == len(plain.shingles(LONG))


@pytest.mark.parametrize("white", [" ", "\t", "\n", "\x0b", "\x0c", "\r"])
def test_words_and_texts_of_over_a_segment(monkeypatch, white):
    blob = "".join(random.Random(2).choices("abcXYZ019+/é", k=1_500_000))
    texts = [
        white.join(["a", "b", "c", blob, "d"]),
        white.join(["a", "b", "c", blob, "d", "e"]),
        white.join([blob, blob[::-1] + white]),
        white.join(f"w{i}" for i in range(200_000)),
    ]
    sets = list(shingle_sets(texts))
    assert [len(s) for s in sets] == [len(plain.shingles(t)) for t in texts] == [1, 2, 1, 199_996]
    monkeypatch.setattr("tenuro.llm.shingles._SEGMENT", 10_000_000)
    assert all(map(np.array_equal, sets, shingle_sets(texts)))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, i) for i in range(300, 400)] + [(5, 5)]
    rng = random.Random(1)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 100) for i in range(100, 181)} | {
        (i, 7) for i in [7, *range(300, 400)]
    }
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_added_to_groups(spark):
    def links(*pairs):
        return spark.createDataFrame(pairs, "a long, b long")

    groups = joined_groups(None, links((4, 3), (3, 9), (20, 21)))
    groups = joined_groups(groups, links((9, 21), (50, 51), (3, 4), (60, 3)))
    groups = joined_groups(groups, links())
    assert {tuple(r) for r in groups.collect()} == {
        *((c, 3) for c in (3, 4, 9, 20, 21, 60)), (50, 50), (51, 50),
    }


def test_tables_are_deleted_once_used(spark, documents):
    import os

    from tenuro.functions.lineage import _session_folder

    folder = _session_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    result = jj.similar_documents(documents)
    left = sorted(name.rpartition("-")[0] for name in set(os.listdir(folder)) - before)
    assert left == ["class-ids", "classes", "component-ids", "groups"]
    assert result.count() == documents.count()


def test_signatures_rule_out_no_link(spark):
    """They differ in no more places than the sets do, also where one is half as long."""
    rng = np.random.default_rng(3)
    rows, sets = [], {}
    for n in (1, 5, 60, 64, 90, 120, 500, 900):
        base = rng.integers(-(2**63), 2**63 - 1, n)
        for changed in (0, n // 10, n // 3, n):
            new = np.unique(np.r_[base[changed:], rng.integers(-(2**63), 2**63 - 1, changed)])
            sets[len(rows)] = set(new.tolist())
            rows.append((len(rows), new.tolist()))
    signed = jj._signatures(spark.createDataFrame(rows, "c long, members array<long>")).collect()
    bits = {r.c: np.array(r.sign, np.int64) for r in signed}
    assert len(bits) == len(rows) and all(64 * len(bits[c]) < 3 * len(s) + 64 for c, s in sets.items())
    for a in sets:
        for b in sets:
            x, y = sorted((bits[a], bits[b]), key=len)
            if len(y) in (len(x), 2 * len(x)):
                y = y if len(x) == len(y) else y[: len(x)] ^ y[len(x) :]
                assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(sets[a] ^ sets[b])


def test_long_blocks_are_joined_without_whole_sets(spark, monkeypatch):
    joined = []

    def seen(pairs, members, real=jj._links):
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        joined.append(("members_a" in plan, pairs.count()))
        return real(pairs, members)

    rows = common_line(90)
    rows_of = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jj, "_star_pairs", lambda blocks, real=jj._star_pairs: real(blocks).limit(0))
    monkeypatch.setattr(jj, "_ROUNDS", 0)
    monkeypatch.setattr(jj, "_PROBED", 2)
    monkeypatch.setattr(jj, "_LONG", 2)
    monkeypatch.setattr(jj, "_links", seen)
    check(spark, rows, rows_of)
    # The stars' pairs, those of long blocks, and those of short ones.
    assert len(joined) == 3 and not any(sets for sets, _ in joined)
    assert 0 < joined[1][1] < 200  # 30 documents share the line: 435 pairs


def test_small_tables_are_written_by_few_tasks(spark):
    edges = spark.createDataFrame([(0, i) for i in range(3001)], "a long, b long")
    settings = {
        "spark.sql.shuffle.partitions": "20",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = joined_groups(None, edges, 4)
        assert {r.g for r in found.collect()} == {0} and found.count() == 3001
        assert len(found.inputFiles()) <= 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
