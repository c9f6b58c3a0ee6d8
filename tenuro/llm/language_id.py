"""Language by n-gram filters: which languages have each n-gram of a text?

For each language, the n-grams that are usual in it go into a Bloom filter. The filters
are bit-sliced: a position holds one bit a language, so one lookup tells all languages
that have an n-gram. A text's language is the one that has the largest share of its
n-grams, after the share that the filter would claim by chance is taken off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenuro.functions.lineage import written
from tenuro.llm.common import crc32_of, map_texts, releasing, table

UNKNOWN = "und"
#: Letters, the ends of words included: " th", "the", "he " are those of "the".
GRAM = 3
_SEGMENT = 1_000_000
_GAP = re.compile(r"[\W\d_]")
_HASHES = 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 3-grams of lower-cased texts as integers, and the text that each is from.

    Everything but letters ends a word; a 3-gram has a letter in its middle.
    """
    low = [t.lower() for t in texts]
    joined = "\n" + "\n".join(low) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    held = letter.copy()
    held[1:] |= letter[:-1]  # the first other character after a word stays, as its end
    held[0] = True
    of = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])  # shifted by "\n"
    where = np.flatnonzero(held)
    shown = np.where(letter[where], codes[where], 0).astype(np.uint64)
    if len(shown) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    middle = np.flatnonzero(shown[1:-1]) + 1
    packed = shown[middle - 1] << np.uint64(42) | shown[middle] << np.uint64(21)
    return packed | shown[middle + 1], of[where[middle] - 1]


def segments(text: str) -> Iterator[str]:
    """A long text in parts that end between words, in lower case.

    A part is as long as ``_SEGMENT``, or goes on to the end of a run of letters that it
    would cut; so memory follows the longest run. How a letter is lower-cased may depend on
    those around it, so the whole text is.
    """
    if len(text) <= _SEGMENT:
        yield text
        return
    text, start = text.lower(), 0
    while len(text) - start > _SEGMENT:
        gap = _GAP.search(text, start + _SEGMENT - 1)
        stop = gap.end() if gap else len(text)
        yield text[start:stop]
        start = stop
    yield text[start:]


def _chunks(texts: Sequence[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of texts, about a segment at a time, with the number of their text."""
    numbers: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for part in segments(text):
            numbers.append(i)
            parts.append(part)
            size += len(part)
            if size >= _SEGMENT:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


# ---------------------------------------------------------------- learning


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.concatenate([n for _, n in parts])
    return keys, np.bincount(where, counts, len(keys)).astype(np.int64)


def gram_counts(
    df: DataFrame, text: str = "text", lang: str = "lang", held: int = 400_000
) -> DataFrame:
    """How often each 3-gram occurs in each language: ``lang``, ``gram``, ``n``.

    Tasks add up before they hand rows on, ``held`` entries or so at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def compact() -> None:
            nonlocal size
            for k, parts in found.items():
                found[k] = [_merged(parts)]
            size = sum(len(p[0][0]) for p in found.values())

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for k, ((keys, counts),) in found.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k] * len(keys), pa.string()),
                        pa.array(keys.astype(np.int64)),
                        pa.array(counts),
                    ],
                    names=["lang", "gram", "n"],
                )
            found.clear()
            size = 0

        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in sorted(set(names)):
                for _, parts in _chunks([t for t, n in zip(texts, names) if n == k]):
                    keys, counts = np.unique(grams(parts)[0], return_counts=True)
                    found.setdefault(k, []).append((keys, counts))
                    size += len(keys)
                    if size > held:
                        compact()
                        if size > held // 2:
                            yield from flushed()
        compact()
        yield from flushed()

    labelled = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return (
        labelled.where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(releasing(run), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def usual_grams(
    counts: DataFrame, min_share: float = 2e-5, min_ratio: float = 0.1
) -> DataFrame:
    """The 3-grams that a language counts as its own: ``lang``, ``gram``, ``total``.

    They make up ``min_share`` of the language's 3-grams or more, and ``min_ratio`` of
    the largest such share of any language, so that strays from texts with a wrong label
    stay out. No language has more than ``1 / min_share`` of them, on data of any size.
    """
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    usual = shares.where(F.col("share") >= min_share)
    largest = usual.groupBy("gram").agg(F.max("share").alias("largest"))
    return (
        usual.join(largest, "gram")
        .where(F.col("share") >= min_ratio * F.col("largest"))
        .select("lang", "gram", "total")
    )


class LanguageFilters:
    """Bit-sliced Bloom filters; slice i holds languages 8i to 8i + 7."""

    def __init__(self, own: dict[str, np.ndarray]):
        """``own``: each language's 3-grams; the first languages win ties."""
        self.languages = list(own)
        largest = max((len(g) for g in own.values()), default=0)
        self.size = 1 << max(10, int(16 * largest).bit_length())
        self.slices = np.zeros((-(-len(own) // 8), self.size), np.uint8)
        rates = []
        for i, found in enumerate(own.values()):
            for at in self._positions(found.astype(np.uint64)):
                self.slices[i // 8, at] |= np.uint8(1 << i % 8)
            filled = (self.slices[i // 8] >> np.uint8(i % 8) & 1).mean()
            rates.append(filled**_HASHES)
        self.by_chance = np.array(rates)

    def _positions(self, found: np.ndarray) -> Iterator[np.ndarray]:
        x = found * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        step = (x >> np.uint64(33)) | np.uint64(1)
        for j in range(_HASHES):
            yield ((x + np.uint64(j) * step) & np.uint64(self.size - 1)).astype(np.int64)

    def languages_of(self, found: np.ndarray) -> Iterator[np.ndarray]:
        """For each slice, one byte a 3-gram: the languages that have it."""
        first, *others = self._positions(found)
        for bits in self.slices:
            mask = bits[first]
            for at in others:
                mask &= bits[at]
            yield mask

    def predict(self, texts: Sequence[str]) -> tuple[list[str], list[float]]:
        """The language and its corrected share of each text's 3-grams."""
        total = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(self.languages), len(texts)), np.int64)
        for numbers, parts in _chunks(texts):
            found, of = grams(parts)
            of = np.array(numbers)[of] if len(of) else of
            total += np.bincount(of, minlength=len(texts))
            for s, mask in enumerate(self.languages_of(found)):
                for bit in range(min(8, len(self.languages) - 8 * s)):
                    own = of[(mask >> np.uint8(bit) & 1).astype(bool)]
                    hits[8 * s + bit] += np.bincount(own, minlength=len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        chance = self.by_chance[:, None]
        share = (hits / np.maximum(total, 1) - chance) / (1 - chance)
        best = share.argmax(axis=0)
        score = np.where(total > 0, share.max(axis=0).clip(0, 1), 0.0)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, total)]
        return names, score.tolist()


def fit_language_filters(
    df: DataFrame, text: str = "text", lang: str = "lang", **options: float
) -> LanguageFilters:
    """Learn from all rows that have a text and a language.

    Counts cover every row. Only usual 3-grams come to the driver, of which there are
    50,000 a language at most (see :func:`usual_grams`).
    """
    counts = written(gram_counts(df, text, lang), "gram-counts")
    rows = usual_grams(counts, **options).toPandas()
    order = rows.groupby("lang")["total"].max().sort_index()
    order = order.sort_values(ascending=False, kind="stable")
    own = {k: np.sort(rows["gram"][rows["lang"] == k].to_numpy()) for k in order.index}
    return LanguageFilters(own)


def predict_language(
    df: DataFrame,
    filters: LanguageFilters,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score``, for every row of ``df``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learnt.
    Of languages with the same share the one with more text wins, then the first by name.
    The score is the share of the text's 3-grams that the language has, corrected for
    chance. One row each, also for repeated rows; other columns are left aside.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)
    fields = "lang_pred string, score double"
    return map_texts(df, text, keep, fields, lambda: shared.value.predict, _SEGMENT)


def with_known_language(
    df: DataFrame, filters: LanguageFilters, text: str = "text"
) -> DataFrame:
    """The rows of ``df`` whose text has a language.

    Those that are predicted ``und``, or have no 3-gram of any language beyond chance
    (score 0), go. Columns and texts are as they were.
    """
    name = "language"
    while f"{name}_score" in df.columns or name in df.columns:
        name += "_"
    shared = df.sparkSession.sparkContext.broadcast(filters)
    fields = f"{name} string, {name}_score double"
    found = map_texts(df, text, df.columns, fields, lambda: shared.value.predict, _SEGMENT)
    kept = found.where((F.col(name) != UNKNOWN) & (F.col(f"{name}_score") > 0))
    return kept.select(*df.columns)


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = crc32_of("doc_id") % 4 == 2
    filters = fit_language_filters(documents.where(~held_out))
    found = predict_language(documents, filters)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
