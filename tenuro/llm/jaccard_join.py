"""Documents linked by the Jaccard similarity of their word shingles.

The product of the document by n-gram matrix with its transpose counts the n-grams that
two documents share. Only pairs that can reach the least similarity are of interest, so
the product is taken block by block over each document's rarest n-grams, counts are
added up, and a pair is dropped once the sizes and places rule it out. What is left is
verified on whole sets.

Documents with equal sets are one class, and only classes are paired. Large groups of
near copies would still give a product that is quadratic in them. So members of a block
are first compared with one of them, and members that this connects needn't be paired with
each other: the product covers only pairs that aren't connected yet. In long blocks members
are then compared with some drawn from other groups, for the same reason. No link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tenuro.functions.lineage import discard, release, written
from tenuro.llm.common import releasing, slices, table
from tenuro.llm.components import joined_groups
from tenuro.llm.shingles import set_id, shingle_sets

#: Two sets link if ``100 * common >= 75 * together``, so ``7 * common >= 3 * (m + n)``.
#: The numbers below follow from that.
_SKETCH_PART = 4096
#: Blocks from this size on are probed before the product, for so many rounds.
_PROBED, _ROUNDS = 8, 1
#: Members drawn for each block and round, and those that a class is compared with.
_SLOTS, _TRIES = 16, 32
#: Joins with what may be small go through a shuffle: every broadcast passes the driver.
_JOIN = "merge"
#: From this size on, not less than ``_PROBED``, members of a block take signatures to the product.
_LONG = 64
#: N-grams of more documents, by the sketch, are spread over so many places. The sketch
#: counts too many rather than too few, so all other blocks are smaller.
_HOT, _PLACES = 1 << 16, 64
#: Of long blocks, so many members at a time meet all the others in a task.
_SHARE = 1024
_CHUNK = 1_000_000
#: Shingles of all documents for each task that writes a table, where that is fewer tasks than
#: shuffles have: some megabytes of n-grams.
_TASK = 500_000


def _linked(common: Column, m: Column, n: Column) -> Column:
    return 7 * common >= 3 * (m + n)


def _prefix_length(n: int) -> int:
    """So many of a set's rarest n-grams hold one of any set that it links with."""
    return n - (3 * n + 3) // 4 + 1


# ---------------------------------------------------------------- passes over texts


def _with_sketch(documents: DataFrame, bits: int) -> DataFrame:
    """Rows (``doc``, ``k``, ``n``, ``c``) and, with ``part`` set, parts of a sketch.

    ``c`` is the id of the document's set, null for an empty one. The sketch counts the
    documents that have an n-gram, in 2**bits counters; each task gives its sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for part in slices(batch, "text", _CHUNK):
                sizes, ids = [], []
                for members in shingle_sets([t or "" for t in part.column("text").to_pylist()]):
                    sizes.append(len(members))
                    ids.append(set_id(members) if len(members) else None)
                    np.add.at(sketch, members >> np.uint64(64 - bits), 1)
                rows = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        part.column("k"),
                        pa.array(sizes, pa.int64()),
                        pa.array(ids, pa.int64()),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    names=names,
                )
        if not sketch.any():
            return
        parts = sketch.reshape(-1, _SKETCH_PART)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(used), doc_type),
                *[pa.nulls(len(used), pa.int64())] * 3,
                pa.array(used.astype(np.int32)),
                pa.array(
                    [np.minimum(parts[i], 65535).astype("<u2").tobytes() for i in used],
                    pa.binary(),
                ),
            ],
            names=names,
        )

    names = ["doc", "k", "n", "c", "part", "counts"]
    schema = documents.select("doc").schema.add("k", "long").add("n", "long")
    schema = schema.add("c", "long").add("part", "integer").add("counts", "binary")
    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(schema["doc"].dataType)
    return documents.select("doc", "k", "text").mapInArrow(releasing(run), schema)


def _summed_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The counters over all tasks: 2**bits numbers, whatever the size of the corpus."""

    def summing(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                    new = np.frombuffer(counts, kind).astype(np.uint32)
                    sums[part] = np.minimum(sums.get(part, 0) + new, 2**31 - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), pa.int32()),
                    pa.array([x.astype("<u4").tobytes() for x in sums.values()], pa.binary()),
                ],
                names=["part", "counts"],
            )

        return run

    rows = parts.select("part", "counts").where("part IS NOT NULL")
    schema = "part int, counts binary"
    # Each of some tasks sums what it has read before anything is moved.
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4
    summed = rows.coalesce(max(8, tasks)).mapInArrow(summing("<u2"), schema)
    summed = summed.repartition("part")
    total = np.zeros((max(1, (1 << bits) // _SKETCH_PART), _SKETCH_PART), np.int32)
    # A part of the sketch at a time; all are no larger than it.
    for row in summed.mapInArrow(summing("<u4"), schema).toLocalIterator():
        total[row.part] = np.frombuffer(row.counts, "<u4")
    return total.ravel()


def _prefixes(documents: DataFrame, shared: Broadcast[np.ndarray], bits: int) -> DataFrame:
    """(``h``, ``c``, ``n``, ``pos``, ``place``): the rarest n-grams of each class, and
    their ranks.

    The order of n-grams is by their counter, then by hash, the same for all documents. A
    task names a class once; a class may come from several tasks. ``place`` is 0, and for
    n-grams of many documents one of some places from 1 on, by the class.
    """
    hot, places = _HOT, _PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", _CHUNK):
                found: list[tuple[np.ndarray, int, int, np.ndarray]] = []
                for members in shingle_sets([t or "" for t in part.column("text").to_pylist()]):
                    n = len(members)
                    if n == 0 or (c := set_id(members)) in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(c)
                    length = _prefix_length(n)
                    rarity = counts[members >> np.uint64(64 - bits)]
                    order = np.argsort(rarity, kind="stable")[:length]  # members are sorted
                    place = (rarity[order] > hot) * np.int32(1 + c % places)
                    found.append((members[order].view(np.int64), c, n, place))
                if found:
                    lengths = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([f[0] for f in found])),
                            pa.array(np.repeat([f[1] for f in found], lengths)),
                            pa.array(np.repeat([f[2] for f in found], lengths).astype(np.int32)),
                            pa.array(np.concatenate([np.arange(m, dtype=np.int32) for m in lengths])),
                            pa.array(np.concatenate([f[3] for f in found]), pa.int32()),
                        ],
                        names=["h", "c", "n", "pos", "place"],
                    )

    return documents.select("text").mapInArrow(
        releasing(run), "h long, c long, n int, pos int, place int"
    )


def _members(documents: DataFrame, wanted: DataFrame, tasks: int | None = None) -> DataFrame:
    """(``c``, ``members``): the whole sets of wanted classes (``doc``, ``k``, ``c``), kept.

    A filter of fixed size tells most of the other documents, so that few texts are
    shingled once more; a join then tells the rest.
    """
    bits = 23
    spark = documents.sparkSession
    wanted = written(wanted, "wanted", tasks)
    place = F.pmod(F.xxhash64("doc", "k"), F.lit(1 << bits)).cast("int")
    places = wanted.select(place.alias("place")).distinct()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << bits, bool)
        for batch in batches:
            bitmap[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.packbits(bitmap).tobytes()], pa.binary())], names=["bitmap"]
        )

    # One megabyte from each of few tasks, however many classes there are.
    maps = places.coalesce(8).mapInArrow(marked, "bitmap binary").collect()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for row in maps:
        bitmap |= np.frombuffer(row.bitmap, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(known[batch.column("place").to_numpy()]))
            for part in slices(batch, "text", _CHUNK):
                ids, sets = [], []
                for members in shingle_sets([t or "" for t in part.column("text").to_pylist()]):
                    c = set_id(members)
                    if len(members) and c not in seen:
                        ids.append(c)
                        sets.append(members.view(np.int64))
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(c)
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                        names=["c", "members"],
                    )

    found = documents.select(place.alias("place"), "text").mapInArrow(
        releasing(run), "c long, members array<long>"
    )
    members = written(
        found.join(wanted.select("c").distinct(), "c", "left_semi")
        .groupBy("c")
        .agg(F.first("members").alias("members")),
        "members",
        tasks,
    )
    shared.destroy()
    discard(wanted)
    return members


# ---------------------------------------------------------------- blocks


def _band() -> Column:
    """Sets of one band differ in size by a third at most."""
    return F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")


def _blocks(prefixes: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``h``, ``c``, ``n``, ``pos``) of n-grams in two classes or more, after the table
    that it reads.

    ``size`` is the number of its classes, and ``first`` the least of them that has about
    the same number of shingles. N-grams of many documents have several places, whose
    figures are added up.
    """
    rows = prefixes.withColumn("band", _band())
    block = Window.partitionBy("h", "place").orderBy("band", "n", "c")
    within = Window.partitionBy("h", "place", "band").orderBy("n", "c")
    once = rows.withColumn("same", F.lag("c").over(block)).where("same IS NULL OR same <> c")
    local = written(
        once.withColumns(
            {
                "before": F.lag("c").over(block),
                "after": F.lead("c").over(block),
                "size": F.count("*").over(Window.partitionBy("h", "place")),
            }
        )
        .where("before IS NOT NULL OR after IS NOT NULL OR place > 0")
        .withColumns({"first": F.first("c").over(within), "n_first": F.first("n").over(within)})
        .select("h", "c", "n", "pos", "place", "band", "size", "first", "n_first"),
        "blocks",
        tasks,
    )
    columns = ("h", "c", "n", "pos", "size", "first", "n_first")
    spread = local.where("place > 0")
    figures = (
        spread.groupBy("h", "band")
        .agg(F.count("*").alias("n_band"), F.min(F.struct("n_first", "first")).alias("least"))
        .withColumn("size", F.sum("n_band").over(Window.partitionBy("h")))
        .where("size > 1")
        .select("h", "band", "size", "least.first", "least.n_first")
    )
    whole = spread.drop("size", "first", "n_first").join(figures, ["h", "band"])
    return local, local.where("place = 0").select(*columns).union(whole.select(*columns))


def _star_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs worth a try before the product: members with the first of their block.

    Nothing depends on their choice but the size of the product.
    """
    return (
        blocks.where("first <> c AND 4 * n_first >= 3 * n")
        .groupBy(
            F.col("first").alias("a"),
            F.col("n_first").alias("n_a"),
            F.col("c").alias("b"),
            F.col("n").alias("n_b"),
        )
        .agg(F.count("*").alias("common"))
        .where("20 * common >= n_b")
        .select("a", "n_a", "b", "n_b")
    )


def _mixed(blocks: DataFrame, group: DataFrame, tasks: int | None = None) -> DataFrame:
    """Members of blocks of several groups ``g`` (a class without one is its own)."""
    rows = (
        blocks.select("h", "c", "n", "pos", "size")
        .join(group.hint(_JOIN), "c", "left")
        .withColumn("g", F.coalesce("g", "c"))
    )
    several = (
        rows.groupBy("h")
        .agg(F.min("g").alias("low"), F.max("g").alias("high"))
        .where("low < high")
        .select("h")
    )
    return written(rows.join(several.hint(_JOIN), "h", "left_semi"), "mixed-blocks", tasks)


def _shares(size: Column, members: int) -> Column:
    return F.ceil(size / members).cast("int")


def _dealt(name: str, shares: Column) -> Column:
    return F.pmod(F.xxhash64(name), shares).cast("int")


def _probe_pairs(rows: DataFrame, attempt: int) -> DataFrame:
    """Members of mixed blocks with members of other groups, some drawn for each block.

    Each class takes ``_TRIES`` of them at most: what isn't found out here, the product
    finds.
    """
    slot = F.pmod(F.xxhash64("c", F.lit(attempt)), F.lit(_SLOTS))
    draw = F.xxhash64("c", "h", F.lit(attempt))
    drawn = rows.groupBy("h", slot.alias("slot")).agg(
        F.min(F.struct(draw.alias("d"), "c", "n", "pos", "g")).alias("o"),
        _shares(F.min("size"), _PROBED * _SLOTS).alias("shares"),
    )
    # Members of a block are dealt over as many keys as keeps them few; each gets all drawn.
    each = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    drawn = drawn.select("h", "o", each)
    rows = rows.withColumn("share", _dealt("c", _shares(F.col("size"), _PROBED * _SLOTS)))
    small, large = F.least("n", F.col("o.n")), F.greatest("n", F.col("o.n"))
    rest = F.least(F.col("n") - F.col("pos"), F.col("o.n") - F.col("o.pos"))
    met = rows.join(drawn.hint(_JOIN), ["h", "share"]).where(
        F.expr("g <> o.g") & (4 * small >= 3 * large) & _linked(rest, small, large)
    )
    pairs = met.select("c", "n", F.col("o.c").alias("o"), F.col("o.n").alias("n_o")).distinct()
    order = Window.partitionBy("c").orderBy(F.xxhash64("o", F.lit(attempt)))
    return (
        pairs.withColumn("row", F.row_number().over(order))
        .where(F.col("row") <= _TRIES)
        .select(
            F.col("c").alias("a"), F.col("n").alias("n_a"),
            F.col("o").alias("b"), F.col("n_o").alias("n_b"),
        )
    )


def _product_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of the product, between groups, that sizes and places don't rule out.

    ``rows`` are members of mixed blocks.
    """
    # Blocks are cut by size: a set links with larger ones of its band or the next.
    band = _band()
    small = rows.select(
        "h",
        band.alias("band"),
        *(F.col(x).alias(f"{x}_a") for x in ("c", "n", "pos", "g")),
    ).where(7 * (F.col("n_a") - F.col("pos_a")) >= 6 * F.col("n_a"))
    large = rows.select(
        "h",
        F.explode(F.array(band, band - 1)).alias("band"),
        *(F.col(x).alias(f"{x}_b") for x in ("c", "n", "pos", "g")),
    )
    counted = (
        small.join(large, ["h", "band"])
        .where(_can_link())
        .groupBy("c_a", "n_a", "c_b", "n_b")
        .agg(
            F.count("*").alias("common"),
            F.max("pos_a").alias("pos_a"),
            F.max("pos_b").alias("pos_b"),
        )
    )
    # N-grams up to the last one met are counted; of those behind it all may be common.
    most = F.col("common") + F.least(F.expr("n_a - pos_a - 1"), F.expr("n_b - pos_b - 1"))
    return counted.where(_linked(most, F.col("n_a"), F.col("n_b"))).select(
        F.col("c_a").alias("a"), "n_a", F.col("c_b").alias("b"), "n_b"
    )


def _can_link() -> Column:
    """Whether sizes and places let members a and b of a block link, from two groups."""
    rest = F.least(F.expr("n_a - pos_a"), F.expr("n_b - pos_b"))
    return F.expr(
        "g_a <> g_b AND (n_a < n_b OR (n_a = n_b AND c_a < c_b)) AND 4 * n_a >= 3 * n_b"
    ) & _linked(rest, F.col("n_a"), F.col("n_b"))


def _signature_words(band: Column) -> Column:
    """So many 64-bit words have a bit for each shingle of the largest set of a band."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.pow(F.lit(4 / 3), band + 1) / 64)))).cast("int")


def _signatures(members: DataFrame) -> DataFrame:
    """(``c``, ``sign``): of each place that shingles are hashed to, whether an odd number
    of the set's is there.

    Two signatures differ in no more places than the sets do in shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = []
            for members, words in zip(batch.column("members"), batch.column("words").to_pylist()):
                places = members.values.to_numpy().view(np.uint64) % np.uint64(64 * words)
                odd = np.bincount(places.view(np.int64), minlength=64 * words) & 1
                signs.append(np.packbits(odd.astype(bool), bitorder="little").view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), pa.array(signs, pa.list_(pa.int64()))], names=["c", "sign"]
            )

    words = members.withColumn("n", F.size("members")).withColumn("words", _signature_words(_band()))
    return words.select("c", "members", "words").mapInArrow(
        releasing(run), "c long, sign array<long>"
    )


def _long_links(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The links (``a``, ``b``) of the product within long mixed blocks.

    A signature takes about a bit a shingle, so it goes with each member of a block, and of
    the many pairs of a block few but the links leave it, which whole sets tell.
    """
    full = rows.join(_signatures(members), "c").withColumns(
        {"band": _band(), "shares": _shares(F.col("size"), _SHARE)}
    )
    names = ("c", "n", "pos", "g", "sign")
    key = ["h", "band", "share"]
    small = full.select(
        "h", "band", _dealt("c", F.col("shares")).alias("share"),
        *(F.col(x).alias(f"{x}_a") for x in names),
    ).where(7 * (F.col("n_a") - F.col("pos_a")) >= 6 * F.col("n_a"))
    # As in the product of short blocks, for this band and the one below, where signatures
    # may be half as long.
    half = _signature_words(F.col("band"))
    folded = F.zip_with(
        F.slice("sign", F.lit(1), half),
        F.slice("sign", half + 1, half),
        lambda x, y: x.bitwiseXOR(y),
    )
    large = (
        full.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
        .withColumn("sign", F.when(F.size("sign") > half, folded).otherwise(F.col("sign")))
        .select(
            "h", "band", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
            *(F.col(x).alias(f"{x}_b") for x in names),
        )
    )
    differing = F.aggregate(
        F.zip_with("sign_a", "sign_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, bits: total + bits,
    )
    # Sets that link differ in a seventh of (m + n) shingles at most.
    pairs = (
        small.join(large, key)
        .where(_can_link() & (7 * differing <= F.col("n_a") + F.col("n_b")))
        .select(F.col("c_a").alias("a"), "n_a", F.col("c_b").alias("b"), "n_b")
        .distinct()
    )
    return _links(pairs, members)


def _links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The links (``a``, ``b``) among candidate pairs, by their whole sets."""
    left = members.select(F.col("c").alias("a"), F.col("members").alias("members_a"))
    right = members.select(F.col("c").alias("b"), F.col("members").alias("members_b"))
    common = F.size(F.array_intersect("members_a", "members_b"))
    return (
        pairs.join(left.hint(_JOIN), "a")
        .join(right.hint(_JOIN), "b")
        .where(_linked(common, F.col("n_a"), F.col("n_b")))
        .select("a", "b")
    )


def _verified(pairs: DataFrame, members: DataFrame, tasks: int | None = None) -> DataFrame:
    return written(_links(pairs, members), "links", tasks)


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("c")).union(pairs.select("b"))


def _linked_classes(
    rows: DataFrame, places: DataFrame, sketch: np.ndarray, bits: int, tasks: int | None = None
) -> DataFrame:
    """(``c``, ``g``): each linked class and its component.

    ``places`` (``c``, ``doc``, ``k``) has a document of each class. Tables are deleted
    once they have been used, and written by ``tasks`` at most.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(sketch)
    local, blocks = _blocks(_prefixes(rows, shared, bits), tasks)
    shared.destroy()
    release(spark)
    is_long = F.col("size") >= _LONG
    pairs = written(_star_pairs(blocks), "pairs", tasks)
    probed = blocks.where(F.col("size") >= _PROBED)
    wanted = _both(pairs).union(probed.select("c")).distinct()
    members = _members(rows, places.join(wanted, "c"), tasks)
    links = _verified(pairs, members, tasks)
    connected = joined_groups(None, links, tasks)
    discard(pairs, links)
    release(spark)
    for attempt in range(_ROUNDS):
        mixed = _mixed(probed, connected, tasks)
        links = _verified(_probe_pairs(mixed, attempt), members, tasks)
        more = joined_groups(connected, links, tasks)
        discard(mixed, links, connected)
        connected = more
    release(spark)
    mixed = _mixed(blocks, connected, tasks)
    discard(local)
    long_links = written(_long_links(mixed.where(is_long), members), "links", tasks)
    pairs = written(_product_pairs(mixed.where(~is_long)), "pairs", tasks)
    discard(members, mixed)
    release(spark)
    rest = _members(rows, places.join(_both(pairs).distinct(), "c"), tasks)
    links = _verified(pairs, rest, tasks)
    found = joined_groups(connected, links.union(long_links), tasks)
    discard(pairs, rest, links, long_links, connected)
    return found


def similar_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", sketch_bits: int = 22
) -> DataFrame:
    """Per document: key, ``k``, ``n_shingles``, ``group`` and ``component_id``.

    Shingles are five consecutive words, or all words of a shorter text; sets link if at
    least 75 % of their union is common. ``group`` names the connected component (null for
    a text without words, which links with nothing), and ``component_id`` is its least
    key, null only if all its keys are. ``k`` is a hash of the text: rows with the same
    key and text can't be told apart and repeat in the result. Null texts have no words.
    Columns other than those named are left aside. An empty table gives an empty result.

    ``sketch_bits`` sets the size of the sketch that orders n-grams by rarity (4 bytes a
    counter, sent to every executor). More bits tell rare n-grams apart in a larger
    corpus; results don't depend on them.
    """
    rows = documents.select(
        F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("k")
    )
    first = written(_with_sketch(rows, sketch_bits), "classes")
    sketch = _summed_sketch(first, sketch_bits)
    found = first.where("part IS NULL").select("doc", "k", "n", "c")
    shingles = found.agg(F.sum("n")).first()[0] or 0
    cores = documents.sparkSession.sparkContext.defaultParallelism
    tasks = max(2 * cores, shingles // _TASK)
    classes = written(
        found.where("c IS NOT NULL")
        .groupBy("c")
        .agg(F.min("doc").alias("least"), F.min(F.struct("doc", "k")).alias("place"))
        .select("c", "least", "place.doc", "place.k"),
        "class-ids",
        tasks,
    )
    release(documents.sparkSession)
    group = _linked_classes(rows, classes.select("c", "doc", "k"), sketch, sketch_bits, tasks)
    grouped = classes.join(group, "c", "left").select(
        "c", "least", F.coalesce("g", "c").alias("g")
    )
    least = grouped.groupBy("g").agg(F.min("least").alias("component"))
    # Written, so that the large side below is one exchange, which can be split if skewed.
    ids = written(grouped.join(least, "g").select("c", "g", "component"), "component-ids", tasks)
    return found.join(ids, "c", "left").select(
        F.col("doc").alias(key),
        "k",
        F.col("n").alias("n_shingles"),
        F.col("g").alias("group"),
        F.when(F.col("c").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component_id"),
    )


def one_of_each_group(
    documents: DataFrame, key: str = "doc_id", text: str = "text", sketch_bits: int = 22
) -> DataFrame:
    """The rows of ``documents``, but one of each component: the one of least key.

    Of rows with the same key in a component one text stays, of repeated rows any one.
    Texts without words link with nothing, so all of them stay.
    """
    found = similar_documents(documents, key, text, sketch_bits).where("group IS NOT NULL")
    chosen = written(
        found.groupBy("group")
        .agg(F.min(F.struct(F.col(key).alias("doc"), "k")).alias("chosen"))
        .select("chosen.*"),
        "chosen",
    )
    wordless = ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    columns = documents.columns
    named = {c: f"c{i}" for i, c in enumerate(columns)}  # names of the caller may clash
    rows = documents.select(
        *(F.col(c).alias(n) for c, n in named.items()),
        F.xxhash64(text).alias("k"),
        wordless.alias("wordless"),
    )
    kept = (
        rows.where(~F.col("wordless"))
        .alias("d")
        .join(
            chosen.alias("s"),
            F.expr(f"d.{named[key]} <=> s.doc AND d.k = s.k"),
            "left_semi",
        )
    )
    order = Window.partitionBy(named[key], "k").orderBy(named[key], "k")
    once = kept.withColumn("row", F.row_number().over(order)).where("row = 1").drop("row")
    both = once.union(rows.where("wordless"))
    return both.select(*(F.col(n).alias(c) for c, n in named.items()))


def op7_shingle_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return similar_documents(documents).select("doc_id", "n_shingles", "component_id")
