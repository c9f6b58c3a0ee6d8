"""Benchmark passages in documents, by a prefix-filtered join on word shingles.

A document has a window of a benchmark item only if it has every shingle of the window,
so the rarest one will do to look for it: that is the prefix a set join needs when all
must be contained. Shingles of five words (fewer where the window is shorter) are
compared first by a hash. Where the rarest shingle of a window occurs, its place says
where the window would begin and end, and the words in between decide.

All of it is made of DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from tenuro.functions.lineage import discard, written
from tenuro.llm.common import table

#: A run of these is a word, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5
#: Benchmarks of up to so many different shingles or windows are broadcast: 8 bytes and
#: about 100 bytes each.
BROADCAST_SHINGLES, BROADCAST_WINDOWS = 1_000_000, 200_000
#: The bitmap of more shingles has 2**BITMAP_BITS bits, as 64 in a row of 16 bytes: 16 MB.
BITMAP_BITS = 26


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(
        F.lower(text)  # the same on ASCII, and faster
    )
    found = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _shingle_hash(words: Column, at: Column, size: int) -> Column:
    parts = [F.get(words, at + i) for i in range(size)]
    return F.xxhash64(F.lit(size), *parts)


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")  # no word has a space in it


def windows_of(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Different (``item``, ``win``, ``len``): runs of ``size`` words, or a short item."""
    items = benchmark.select(
        F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")
    ).where(F.size("words") > 0)
    length = F.least(F.lit(size), F.size("words"))
    starts = F.sequence(F.lit(0), F.size("words") - length)
    return (
        items.withColumns({"len": length, "at": F.explode(starts)})
        .select("item", _joined(F.slice("words", F.col("at") + 1, F.col("len"))).alias("win"), "len")
        .distinct()
    )


def _shingles_of_windows(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(``win``, ``len``, ``size``, ``offset``, ``h``) of different windows."""
    rows = windows.select("win", "len").distinct()
    rows = rows.withColumns(
        {"words": F.split("win", " "), "size": F.least(F.lit(SHINGLE), F.col("len"))}
    ).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))))
    h = reduce(
        lambda other, n: F.when(
            F.col("size") == n, _shingle_hash(F.col("words"), F.col("offset"), n)
        ).otherwise(other),
        sizes,
        F.lit(None).cast("long"),
    )
    return rows.select("win", "len", "size", "offset", h.alias("h"))


def _bitmap(known: DataFrame) -> DataFrame:
    """(``word``, ``held``): 64 bits at a time, set at the place of each hash.

    2**(BITMAP_BITS - 6) rows at most, made by partial aggregates.
    """
    place = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    one = F.expr("shiftleft(1L, cast(place % 64 as int))")
    return (
        known.select(place.alias("place"))
        .select(F.shiftright("place", 6).alias("word"), one.alias("one"))
        .groupBy("word")
        .agg(F.bit_or("one").alias("held"))
    )


def _postings(
    documents: DataFrame, known: DataFrame, sizes: list[int], size: int, small: bool
) -> DataFrame:
    """Each document once with ``at`` 0, and where it has a shingle of the benchmark.

    ``at`` is eight times the place of the first word, and the number of words. ``around``
    begins at word ``first`` of the document and reaches as far on either side as a window
    with that shingle can. Texts are read and taken apart once, and no word is moved: what
    drops the other places is broadcast, the hashes themselves if there are few, or else a
    bitmap of them, by which a few others pass, too.
    """
    texts = documents.select("doc", "k", words_of(F.col("text")).alias("words"))
    texts = texts.withColumn("n", F.size("words"))
    places = [
        F.when(
            F.col("n") >= m, F.sequence(F.lit(m), (F.col("n") - m) * 8 + m, F.lit(8))
        ).otherwise(F.array().cast("array<int>"))
        for m in sizes
    ]
    at = texts.withColumn("at", F.explode(F.concat(F.array(F.lit(0)), *places)))
    at = at.withColumns({"pos": F.shiftright("at", 3), "size": F.col("at") % 8})
    h = reduce(
        lambda other, m: F.when(
            F.col("size") == m, _shingle_hash(F.col("words"), F.col("pos"), m)
        ).otherwise(other),
        sizes,
        F.lit(None).cast("long"),
    )
    hashed = at.withColumn("h", h)
    if small:
        found = hashed.join(F.broadcast(known.withColumn("hit", F.lit(True))), "h", "left")
    else:
        place = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
        held = F.getbit("held", (place % 64).cast("int")) == 1
        found = (
            hashed.withColumn("word", F.shiftright(place, 6))
            .join(F.broadcast(_bitmap(known)), "word", "left")
            .withColumn("hit", F.when(held, True))
        )
    first = F.greatest(F.col("pos") - (size - F.col("size")), F.lit(0))
    around = F.slice("words", first + 1, F.col("pos") - first + size)
    shown = F.when(F.col("at") > 0, around)
    return found.where("at = 0 OR hit").select(
        "doc", "k", "n", "at", "pos", "h", first.alias("first"), shown.alias("around")
    )


def occurrences(
    documents: DataFrame, windows: DataFrame, size: int, sizes: list[int]
) -> tuple[DataFrame, DataFrame]:
    """(``doc``, ``k``, ``start``, ``stop``, ``win``) of every window in a document, and
    (``doc``, ``k``, ``n``) of every row of ``documents``; both written.
    """
    shingles = written(_shingles_of_windows(windows, sizes), "window-shingles")
    known = written(shingles.select("h").distinct(), "shingles")
    small = known.count() <= BROADCAST_SHINGLES
    postings = written(_postings(documents, known, sizes, size, small), "postings")
    places = postings.where("at > 0")
    rarity = places.groupBy("h").agg(F.count("*").alias("df"))
    prefix = (
        shingles.join(rarity, "h", "left")
        .groupBy("win", "len")
        .agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("rarest")
        )
        # A shingle that no document has rules the window out.
        .where("rarest.df > 0")
        .select("win", "len", "rarest.h", "rarest.offset")
    )
    prefix = written(prefix, "prefixes")
    few = prefix.count() <= BROADCAST_WINDOWS
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n"))
    same = _joined(F.slice("around", start - F.col("first") + 1, F.col("len"))) == F.col("win")
    # The bounds come first: a slice can't begin before its array.
    found = written(
        places.join(F.broadcast(prefix) if few else prefix, "h")
        .where(F.when(inside, same).otherwise(False))
        .select("doc", "k", start.alias("start"), (start + F.col("len")).alias("stop"), "win")
        .distinct(),
        "occurrences",
    )
    rows = written(postings.where("at = 0").select("doc", "k", "n"), "rows")
    discard(shingles, known, postings, prefix)
    return found, rows


def find_benchmark_passages(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 10,
) -> DataFrame:
    """Per document: key, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and
    ``contaminated``.

    A window is ``size`` consecutive words of an item, or a shorter item as a whole. Hit
    words are those inside an occurrence of a window. Items are listed as text, in order,
    with commas, for the digest. Null and empty texts have no words, items without words
    no windows, and a null item id is left out of the list but does hit words. Repeated
    rows give repeated rows: rows are told apart by key and text. Columns other than those
    named are left aside.

    Texts are read once. No word of a document is moved unless it stands by a shingle of
    the benchmark, or, with over a million of those, by one that a bitmap takes for one. The
    hits of one document meet in one task, and there are no more of them than words.
    """
    rows = documents.select(
        F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("k")
    )
    windows = written(windows_of(benchmark, item, item_text, size), "windows")
    short = F.least(F.lit(SHINGLE), F.col("len")).alias("size")
    sizes = sorted(r["size"] for r in windows.select(short).distinct().collect())
    none = F.sha2(F.lit(""), 256)
    if not sizes:
        zero, n_words = F.lit(0).cast("long"), F.size(words_of(F.col("text"))).cast("long")
        return rows.select(
            F.col("doc").alias(key), n_words.alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"),
            none.alias("items_sha256"), F.lit(False).alias("contaminated"),
        )
    found, counted = occurrences(rows, windows, size, sizes)
    before = (
        Window.partitionBy("doc", "k")
        .orderBy("start", "stop")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    fresh = F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), "start"))
    hits = (
        found.select("doc", "k", "start", "stop")
        .distinct()
        .withColumn("fresh", F.greatest(fresh, F.lit(0)))
        .groupBy("doc", "k")
        .agg(F.sum("fresh").alias("n_hit"))
    )
    items = (
        found.select("doc", "k", "win")
        .distinct()
        .join(windows.where("item IS NOT NULL").select("win", "item"), "win")
        .groupBy("doc", "k")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    # Written, so that the large side below is one exchange, which can be split if skewed.
    result = written(
        hits.alias("a")
        .join(items.alias("b"), F.expr("a.doc <=> b.doc AND a.k = b.k"), "left")
        .select("a.doc", "a.k", "n_hit", "items"),
        "hits",
    )
    discard(found, windows)
    return (
        counted.alias("d")
        .join(result.alias("r"), F.expr("d.doc <=> r.doc AND d.k = r.k"), "left")
        .select(
            F.col("d.doc").alias(key),
            F.col("n").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce(F.sha2(F.array_join("items", ","), 256), none).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def without_benchmark_passages(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 10,
) -> DataFrame:
    """The rows of ``documents`` that hold no window of the benchmark, unchanged.

    Windows are those of :func:`find_benchmark_passages`.
    """
    rows = documents.select(
        F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("k")
    )
    windows = written(windows_of(benchmark, item, item_text, size), "windows")
    short = F.least(F.lit(SHINGLE), F.col("len")).alias("size")
    sizes = sorted(r["size"] for r in windows.select(short).distinct().collect())
    if not sizes:
        return documents
    found, counted = occurrences(rows, windows, size, sizes)
    hit = written(found.select("doc", "k").distinct(), "contaminated")
    discard(found, counted, windows)
    columns = documents.columns
    named = {c: f"c{i}" for i, c in enumerate(columns)}  # names of the caller may clash
    return (
        documents.select(
            *(F.col(c).alias(n) for c, n in named.items()), F.xxhash64(text).alias("k")
        )
        .alias("d")
        .join(hit.alias("h"), F.expr(f"d.{named[key]} <=> h.doc AND d.k = h.k"), "left_anti")
        .select(*(F.col(n).alias(c) for c, n in named.items()))
    )


def op4_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return find_benchmark_passages(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "benchmark", "item_id", "text"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[s + 1:s + n], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n,
               unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s
        FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT rid, n, s, array_to_string(w[s + 1:s + n], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS s
        FROM d, sizes WHERE len(w) >= n)
), m AS (
  SELECT DISTINCT rid, dw.n, s, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), h AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, n, s FROM m))
  GROUP BY rid
), i AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""
