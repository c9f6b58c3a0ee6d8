import random

import pytest
from pyspark.sql import functions as F

from tenuro.llm import spelling
from tests.llm import plain
from tests.llm.conftest import ODD


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def rows(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture(scope="module")
def counts():
    """Words over few letters, so that many are near, from 1 to 70 letters long."""
    rnd, found = random.Random(3), {}
    for size in [*range(1, 9)] * 60 + [20, 63, 64, 65, 66, 70] * 4:
        word = "".join(rnd.choices("abé÷", k=size))
        for _ in range(3):
            at = rnd.randrange(len(word))
            edit = rnd.choice([word[:at] + rnd.choice("abéÿ") + word[at + 1 :], word[:at] + word[at + 1 :]])
            found[edit or "a"] = rnd.choice([1, 4, 5, 20, 25, 100, 125, 3000])
        found[word] = rnd.choice([1, 5, 25, 125])
    return found


@pytest.mark.parametrize("most_bytes", [32 << 20, 64, 4096])
def test_groups_match_all_edits(spark, counts, most_bytes):
    got = rows(spelling.spelling_groups(table(spark, counts), most_bytes=most_bytes))
    assert got == plain.spelling_groups(counts)
    assert any(root not in (word, form) for word, form, root, *_ in got if form)


def test_words_of_odd_rows(spark, odd):
    many = odd.crossJoin(spark.range(5).select(F.col("id").alias("copy")))
    got = dict(rows(spelling.occurring_words(many)))
    assert got == plain.words_with_slips(ODD * 5)
    got = dict(rows(spelling.occurring_words(many, slip_every=None, least_n=1, held=3)))
    assert got == {w: n for w, n in plain.words_with_slips(ODD * 5, every=1 << 40).items()}
    assert got["x" * 100_000] == 5


def test_a_very_long_word_and_its_neighbour(spark):
    long = "xy" * 50_000
    counts = {long: 30, long[:-1]: 6, long[:-1] + "z": 5, "yy": 5, "xy": 25}
    got = rows(spelling.spelling_groups(table(spark, counts)))
    assert got == {
        (long, None, long, 30, 2, None),
        (long[:-1], long, long, 6, 2, 30),
        (long[:-1] + "z", long, long, 5, 2, 30),
        ("yy", "xy", "xy", 5, 1, 25),
        ("xy", None, "xy", 25, 1, None),
    }


def test_nothing(spark, nothing):
    words = spelling.occurring_words(nothing)
    assert words.count() == 0 and spelling.spelling_groups(words).count() == 0


def test_filters_are_bounded_and_miss_no_word(spark, counts):
    words = table(spark, counts)
    for most_bytes in (4096, 32 << 20):
        filters = spelling.build_filters(words, most_bytes)
        assert sum(s.blocks.nbytes for s in filters.values()) <= max(most_bytes, 64 * len(filters))
        for length, codes, group in spelling._by_length(list(counts)):
            shard = filters[spelling._shard(length)]
            assert len(shard.holds(spelling._sums(codes), length)) == len(group)


def test_factor(spark):
    with pytest.raises(ValueError, match="2 or more"):
        spelling.spelling_groups(table(spark, {"aaaaaa": 5}), factor=1)
