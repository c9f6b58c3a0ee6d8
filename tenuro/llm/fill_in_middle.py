"""Fill-in-the-middle texts by piece tables.

A document is never copied to be rearranged. It is a list of descriptors over two
buffers that don't change, its text and the sentinels. A cut splits the descriptor it
falls into, an arrangement permutes descriptors, the inverse permutation restores them,
and hashes and outputs are streamed from them piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenuro.llm.common import map_texts, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: Sentinels and parts of the text (0 prefix, 1 middle, 2 suffix) in the order of a form.
ARRANGEMENTS: dict[str, tuple[str | int, ...]] = {
    "psm": (PREFIX, 0, SUFFIX, 2, MIDDLE, 1),
    "spm": (SUFFIX, 2, PREFIX, 0, MIDDLE, 1),
}
#: Characters that are hashed or joined at a time.
_STEP = 1 << 20


class Piece(NamedTuple):
    """``length`` characters from ``start`` on of buffer 0 (text) or 1 (sentinels)."""

    buffer: int
    start: int
    length: int


class PieceTable:
    """A text as descriptors over buffers, none of which is ever changed."""

    def __init__(self, *buffers: str, pieces: Sequence[Piece] | None = None):
        self.buffers = buffers
        self.pieces = [Piece(0, 0, len(buffers[0]))] if pieces is None else list(pieces)

    def cut(self, *places: int) -> PieceTable:
        """The same text with a border between descriptors at each place.

        A place that is given twice, or at an end, makes an empty descriptor, so that n
        places always make n descriptors more.
        """
        pieces = self.pieces
        for place in sorted(places, reverse=True):
            at = 0
            while at < len(pieces) - 1 and place > pieces[at].length:
                place -= pieces[at].length
                at += 1
            buffer, start, length = pieces[at]
            if not 0 <= place <= length:
                raise ValueError("a cut lies outside the text")
            halves = Piece(buffer, start, place), Piece(buffer, start + place, length - place)
            pieces = [*pieces[:at], *halves, *pieces[at + 1 :]]
        return PieceTable(*self.buffers, pieces=pieces)

    def permuted(self, order: Sequence[int]) -> PieceTable:
        """The descriptors in another order; descriptor ``order[i]`` comes to place i."""
        return PieceTable(*self.buffers, pieces=[self.pieces[i] for i in order])

    def interleaved(self, buffer: int, starts: Sequence[Piece]) -> PieceTable:
        """A descriptor of another buffer before each of the table's own."""
        pieces = [p for pair in zip(starts, self.pieces, strict=True) for p in pair]
        return PieceTable(*self.buffers, pieces=pieces)

    def stream(self) -> Iterator[str]:
        for buffer, start, length in self.pieces:
            text = self.buffers[buffer]
            for at in range(start, start + length, _STEP):
                yield text[at : min(at + _STEP, start + length)]

    def sha256(self) -> str:
        """Of the text in UTF-8, streamed from the descriptors."""
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part.encode())
        return digest.hexdigest()

    def text(self) -> str:
        return "".join(self.stream())


def _parts(form: str) -> list[int]:
    """The order of prefix, middle and suffix in a form."""
    return [p for p in ARRANGEMENTS[form] if isinstance(p, int)]


def _inverse(order: Sequence[int]) -> list[int]:
    return sorted(range(len(order)), key=order.__getitem__)


def arranged(text: str, form: str, first: int, second: int) -> PieceTable:
    """``text`` cut at two places and arranged as ``form``; ``plain`` leaves it whole."""
    whole = PieceTable(text, SENTINELS)
    if form == "plain":
        return whole
    marks = [
        Piece(1, SENTINELS.index(m), len(m)) for m in ARRANGEMENTS[form] if isinstance(m, str)
    ]
    return whole.cut(first, second).permuted(_parts(form)).interleaved(1, marks)


def restored(output: str, form: str) -> PieceTable:
    """The text that ``output`` was made from, by its form alone.

    The parts hold no sentinel, so the first one after each part ends it.
    """
    if form == "plain":
        return PieceTable(output)
    marks = [m for m in ARRANGEMENTS[form] if isinstance(m, str)]
    pieces, start = [], len(marks[0])
    if not output.startswith(marks[0]):
        raise ValueError(f"not an output of form {form}")
    for mark in marks[1:]:
        end = output.index(mark, start)
        pieces.append(Piece(0, start, end - start))
        start = end + len(mark)
    pieces.append(Piece(0, start, len(output) - start))
    return PieceTable(output, pieces=pieces).permuted(_inverse(_parts(form)))


def decided(
    key: str, text: str, seed: int = 1, rate: int = 90, spm_rate: int = 20
) -> tuple[str, int, int]:
    """Form and both cuts of a document, from a hash of its key.

    ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of those become ``spm``. Empty texts
    and those with a sentinel in them stay plain.
    """
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", 0, 0
    size = len(text) + 1
    first, second = sorted((h1 % size, h2 % size))
    return "spm" if h4 % 100 < spm_rate else "psm", first, second


def fill_in_middle(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    seed: int = 1,
    rate: int = 90,
    spm_rate: int = 20,
    with_texts: bool = True,
) -> DataFrame:
    """Every text cut in three and arranged to have its middle last.

    Gives columns ``keep``, ``n`` (code points of the text), ``form`` (``plain``, ``psm``
    or ``spm``), ``prefix_chars`` and ``middle_chars`` (null if plain), ``output_sha256``,
    ``restored_sha256`` (of the text rebuilt from output and form), and with
    ``with_texts`` also ``output`` and ``pieces``, the descriptors of the output. One row
    for each, repeated rows too; rows with the same key and text get the same cuts. A null
    text counts as empty, a null key as an empty key. Other columns are left aside, and an
    empty table gives an empty result. Memory follows the longest text.
    """
    key_name = "_key" if "_key" not in (*keep, text) else f"_key_of_{'_'.join(keep)}"
    fields = (
        "n long, form string, prefix_chars long, middle_chars long, "
        "output_sha256 string, restored_sha256 string"
    )
    if with_texts:
        fields += (
            ", output string, pieces array<struct<buffer: int, start: long, length: long>>"
        )

    def prepare():
        def measure(texts: list[str], keys: list[str]) -> list[list]:
            rows = []
            for value, name in zip(texts, keys):
                form, first, second = decided(name, value, seed, rate, spm_rate)
                result = arranged(value, form, first, second)
                output = result.text()
                cuts = (None, None) if form == "plain" else (first, second - first)
                row = (
                    len(value), form, *cuts,
                    result.sha256(), restored(output, form).sha256(),
                )
                pieces = [p._asdict() for p in result.pieces]
                rows.append((*row, output, pieces) if with_texts else row)
            return [list(column) for column in zip(*rows, strict=True)]

        return measure

    keyed = df.select(
        *dict.fromkeys([*keep, text]),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key_name),
    )
    return map_texts(keyed, text, keep, fields, prepare, with_columns=(key_name,))


def op13_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut, arranged and restored, as digests."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return fill_in_middle(documents, with_texts=False)


OP13_SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS t,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), numbers AS (
    SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
           CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM hashed
), forms AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                     OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parts AS (
    SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s
    FROM forms
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
