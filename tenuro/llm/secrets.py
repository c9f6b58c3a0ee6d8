"""Secrets in text: known forms, and strings that a primed compressor can't explain.

A string in a sensitive context is compressed after the code around it, with a dictionary
of the parts of identifiers. The bytes it adds are held against those that random strings
of its length and alphabet add in the same place: names are made of known parts and add
much less, secrets as much.
"""

from __future__ import annotations

import json
import random
import re
import string
from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import accumulate
from statistics import fmean

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenuro.functions.lineage import discard, written
from tenuro.llm.common import map_texts, table

KINDS = ("assign", "access", "hex", "novel")
SPANS = "array<struct<kind:string,start:int,stop:int>>"
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)",
    re.I | re.A,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A match can only begin where a run does; saying so keeps long runs linear.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: Words that make their surroundings sensitive (fixed values).
SENSITIVE = (
    "key", "secret", "token", "passw", "pwd", "credential", "auth", "bearer", "private",
    "login", "session", "signature", "connection",
)
# Inside a run "=" parts a name from its value; at the end it is padding.
_CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
    r"|[A-Za-z0-9+/_-]{15}=(?![A-Za-z0-9+/_=-])|[A-Za-z0-9+/_-]{14}==(?![A-Za-z0-9+/_=-]))"
    r"(?![A-Za-z0-9+/_-])"
)
_SENSITIVE = re.compile("|".join(SENSITIVE), re.I | re.A)
_ASSIGNED = re.compile(r"[:=]|bearer|-----BEGIN", re.I | re.A)
_WORD = re.compile(r"[^\W_]")
_NOT_PART = re.compile(r"[^A-Za-z0-9+/_.-]")
#: What may be another secret, and so is left out of the code around one.
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: From this length on strings are compressed faster, and random ones of this length tell
#: what longer ones would add.
_LARGE = 4096


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of the known forms; those that are too short are dropped."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [
            ("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8
        ]
    if "AKIA" in text:
        found += [
            ("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16
        ]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


@lru_cache(maxsize=4096)
def _random_strings(letters: str, length: int, n: int) -> list[bytes]:
    """The same ``n`` strings on each call."""
    rng = random.Random(f"{letters}:{length}")
    return ["".join(rng.choices(letters, k=length)).encode() for _ in range(n)]


def alphabet(text: str) -> str:
    """Of lower-cased text: digits, a to f, or all letters where others occur, and signs."""
    held = set(text)
    found = string.digits if held & set(string.digits) else ""
    if held & set(string.ascii_lowercase[6:]):
        found += string.ascii_lowercase
    elif held & set("abcdef"):
        found += "abcdef"
    return found + "".join(sorted(held - set(string.digits + string.ascii_lowercase)))


class Novelty:
    """What a string adds to the compressed code around it, as a share of what random
    strings of its length and alphabet add. ASCII is assumed, and case is left aside.
    """

    def __init__(self, dictionary: bytes, around: int = 128, samples: int = 8):
        self.around, self.samples = around, samples
        raw = dictionary or b"\0" * 8
        # The higher level finds the parts of names; it would take long for large strings.
        self.small, self.large = (
            zstandard.ZstdCompressor(
                level=level,
                dict_data=zstandard.ZstdCompressionDict(
                    raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
                write_checksum=False,
                write_content_size=False,
            ).compress
            for level in (19, 3)
        )

    def __call__(self, text: str, start: int, stop: int) -> float:
        before = _LONG_RUN.sub(" ", text[max(0, start - self.around) : start])
        after = _LONG_RUN.sub(" ", text[stop : stop + self.around])
        around = f"{after}\n{before}".lower().encode()
        value = text[start:stop].lower()
        length = min(len(value), _LARGE)
        compress = self.small if length < _LARGE else self.large
        alone = len(compress(around))

        def added(more: bytes) -> int:
            return len(compress(around + more)) - alone

        others = _random_strings(alphabet(value), length, self.samples)
        expected = max(1, fmean(map(added, others))) * len(value) / length
        return added(value.encode()) / expected


class _Line:
    """Whether a line has had a sensitive word and a sign of assignment so far."""

    def __init__(self):
        self.word = self.sign = False

    def read(self, text: str, start: int, stop: int) -> bool:
        self.word = self.word or _SENSITIVE.search(text, start, stop) is not None
        self.sign = self.sign or _ASSIGNED.search(text, start, stop) is not None
        return self.word and self.sign


def novel_spans(
    text: str, taken: Sequence[tuple[str, int, int]], novelty: Novelty, least: float
) -> list[tuple[str, int, int]]:
    """Candidates in a sensitive context, not inside one of ``taken``, of that novelty.

    A candidate has 16 characters or more. Its context is all of its line that stands
    before it, however long; for the first of a line also the line before, or, where that
    ends with a candidate in a sensitive context, the context of that one. A line is read
    once, whatever the number of its candidates.
    """
    spans = sorted((a, b) for _, a, b in taken)
    begins, ends = [a for a, _ in spans], [0, *accumulate((b for _, b in spans), max)]
    found = []
    line, read = _Line(), 0  # the current line, and up to where it has been read
    last, carried = 0, False  # where the last candidate ends; whether it was sensitive
    for match in _CANDIDATE.finditer(text):
        start, stop = match.span()
        above = False
        end = text.rfind("\n", read, start)
        if end >= 0:
            begin = text.rfind("\n", read, end)
            if begin >= 0:
                line = _Line()
            above = line.read(text, max(read, begin + 1), end)
            goes_on = carried and begin < last and not _WORD.search(text, last, end)
            # Only the first word of a line belongs to what is above it.
            above = (above or goes_on) and not _WORD.search(text, end, start)
            line, read = _Line(), end + 1
        further = carried and not _NOT_PART.search(text, last, start)  # of a dotted string
        sensitive = line.read(text, read, start) or above or further
        read, last, carried = start, stop, sensitive
        inside = ends[bisect_right(begins, start)] >= stop
        if sensitive and not inside and novelty(text, start, stop) >= least:
            found.append(("novel", start, stop))
    return found


def vocabulary_words(path: str, most: int = 16_000) -> list[str]:
    """The words of a tokenizer file in lower case, the least frequent first.

    Those of four letters or more, and of them the ``most`` with the least ids: a larger
    dictionary makes each match dearer.
    """
    with open(path, encoding="utf-8") as file:
        ids: dict[str, int] = json.load(file)["model"]["vocab"]
    words = (t.lstrip("\u0120").lower() for t in sorted(ids, key=ids.__getitem__))
    kept = dict.fromkeys(w for w in words if 4 <= len(w) <= 20 and w.isascii() and w.isalpha())
    return list(kept)[:most][::-1]


def identifier_dictionary(
    df: DataFrame, text: str = "text", size: int = 2_000, vocabulary_path: str | None = None
) -> bytes:
    """Parts of identifiers: those that are frequent in the corpus, then those of a public
    vocabulary if a path is given; of both the most frequent last, where they are cheapest.

    Parts are words of four letters or more as they stand between signs, digits and changes
    of case, so that no random string becomes one. Those that are one in ten times ``size``
    or more, of which there are no more than that on data of any size, come to the driver,
    and ``size`` of them are used (of 20 letters at most, so 40 KB). Counts cover all texts.
    """
    found = F.regexp_extract_all(
        F.col(text), F.lit(r"[A-Z]?[a-z]{3,19}|[A-Z]{4,20}"), F.lit(0)
    )
    counted = written(
        df.where(F.col(text).isNotNull())
        .select(F.explode(found).alias("word"))
        .groupBy(F.lower("word").alias("word"))
        .agg(F.count("*").alias("n")),
        "identifiers",
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    usual = counted.where(F.col("n") * 10 * size >= total).collect()
    discard(counted)
    usual.sort(key=lambda row: (row.n, row.word))
    words = vocabulary_words(vocabulary_path) if vocabulary_path else []
    return "".join([*(row.word for row in usual[-size:]), *words]).encode()


def find_secrets(
    df: DataFrame,
    dictionary: bytes,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    least_novelty: float = 0.805,
) -> DataFrame:
    """Columns ``keep`` and ``spans``: kind, start, stop (code points), by start.

    Known forms, and strings of the novelty that random ones have, in a sensitive context
    (see :func:`novel_spans`). Spans of the second kind may reach beyond ones of the first.
    One row each, also for repeated rows; a null or empty text has an empty array. Other
    columns are left aside, whatever their names.
    """
    order = {kind: i for i, kind in enumerate(KINDS)}

    def prepare() -> Callable[[list[str]], list[list]]:
        novelty = Novelty(dictionary)

        def spans(value: str) -> list[dict]:
            plain = plain_spans(value)
            found = plain + novel_spans(value, plain, novelty, least_novelty)
            found.sort(key=lambda s: (s[1], order[s[0]], s[2]))
            return [{"kind": k, "start": a, "stop": b} for k, a, b in found]

        return lambda texts: [[spans(t) for t in texts]]

    return map_texts(df, text, keep, f"spans {SPANS}", prepare)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ","
    )


def op8_novel_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets in every document."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    words = identifier_dictionary(
        documents, vocabulary_path=public_tokenizers.path("byte_bpe_50k.json")
    )
    found = find_secrets(documents, words)
    plain = F.filter("spans", lambda s: s.kind != "novel")
    counts = {
        f"n_{kind}": _count(F.col("spans"), kind)
        for kind in KINDS
    }
    return found.select(
        "doc_id",
        *(counts[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(plain), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        counts["n_novel"].alias("n_novel"),
    )
