"""Personal data, also where it is disguised, by spans of the source text.

Plain identifiers are found in the text itself. For disguised ones the text is rewritten
by transducers: look-alike characters become ASCII, spelled digits become digits, and
"at" and "dot" in their disguises become ``@`` and ``.``. Each transducer remembers
which source characters its output came from, so that a span of the rewritten text can
be traced back through all of them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from copy import copy
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenuro.llm.common import map_texts, table

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,stop:int,disguised:boolean>>"
Span = tuple[int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

# ---------------------------------------------------------------- plain identifiers


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    Looks at the surroundings of each ``@`` only, so long runs of letters cost nothing.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def ips(text: str) -> Iterator[Span]:
    for match in _IP.finditer(text):
        parts = [p.lstrip("0") for p in match[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield match.span()


def passes_luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = _NOT_DIGITS.sub("", match[0])
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                yield match.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGITS.sub("", match[0])) <= 15:
                yield match.span()


_FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {
    "email": emails,
    "ip": ips,
    "card": cards,
    "phone": phones,
}

# ---------------------------------------------------------------- transducers

# Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
    "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "А": "A", "В": "B", "Е": "E",
    "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: How digits are spelled.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
}
#: How often the digit after the word counts.
REPEATED = {"double": 2, "triple": 3}


def _plain_character(c: str) -> str:
    """The ASCII character that ``c`` stands for, or ``c``."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "！" <= c <= "～":  # full width forms
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None)
    return c if digit is None else str(digit)


_DISGUISED_CHARACTERS = re.compile(
    "["
    + re.escape("".join(LOOKALIKES) + INVISIBLE)
    + "！-～"
    + "".join(  # the digits of other scripts, from the Unicode tables
        chr(c) for c in range(0x80, 0x20000) if unicodedata.decimal(chr(c), None) is not None
    )
    + "]"
)
_REPEATED = "(?:(?:" + "|".join(REPEATED) + r")[\s-]{1,3})"
_DIGIT_WORD = f"(?:{_REPEATED}?(?:" + "|".join(SPELLED) + "))"
# What stands between the words of a number: no end of a line.
_BETWEEN = r"[ \t\r\f\v,-]"
_DIGIT_RUN = re.compile(
    rf"(?<![A-Za-z])(?:plus{_BETWEEN}{{1,3}})?(?:{_DIGIT_WORD}{_BETWEEN}{{1,3}}){{2,}}{_DIGIT_WORD}(?![A-Za-z])",
    re.I | re.A,
)
_DIGIT_WORDS = re.compile(rf"plus|{_DIGIT_WORD}", re.I | re.A)
# Also shorter runs and those with figures among them; what adjoins them decides.
_FIGURE = rf"(?:{_DIGIT_WORD}|{_REPEATED}[0-9](?![0-9])|[0-9]++)"
_MIXED_RUN = re.compile(
    rf"(?<![A-Za-z0-9])(?:plus{_BETWEEN}{{1,3}})?{_FIGURE}(?:{_BETWEEN}{{1,3}}{_FIGURE})*(?![A-Za-z])",
    re.I | re.A,
)
_FIGURES = re.compile(_FIGURE, re.I | re.A)
_BEFORE_RUN = re.compile(
    r"(?:\.|(?:\+|(?<![A-Za-z])dot)[\s)\]}>(-]{0,8}|[0-9][\s().-]{1,3})\Z", re.I | re.A
)
_AFTER_RUN = re.compile(
    r"\.[0-9A-Za-z]|[\s(\[{<]{0,8}dot(?![A-Za-z])|[\s().-]{1,3}[0-9]", re.I | re.A
)
# Whatever makes a word part of a longer run or adjoins one, and maybe more.
_NEAR = "(?:[0-9]|dot|plus|" + "|".join([*REPEATED, *SPELLED]) + ")"
_NEAR_BEFORE = re.compile(rf"(?:[.+]|{_NEAR})[\s,()\[\]{{}}<>.+-]{{0,8}}\Z", re.A)
_NEAR_AFTER = re.compile(rf"\.|[\s,()\[\]{{}}<>.-]{{0,8}}{_NEAR}", re.A)
_BRACKETED = re.compile(
    r"\s{0,3}[(\[{<]\s{0,3}(at|dot|@|\.)\s{0,3}[)\]}>]\s{0,3}", re.I | re.A
)
_BRACKETS = re.compile(r"[(\[{<]\s{0,3}(?:at|dot|@|\.)\s{0,3}[)\]}>]", re.I | re.A)
# Words between spaces, dashes or underscores.
_SPOKEN_DOT = re.compile(
    r"(?<=[A-Za-z0-9])(?:\s{1,3}dot\s{1,3}|\s{0,3}[_-]dot[_-]\s{0,3})(?=[A-Za-z0-9])", re.I | re.A
)
# "at" alone is a common word, so it counts only before a host with a rewritten dot.
_SPOKEN_AT = re.compile(
    r"(?<=[A-Za-z0-9])(?:\s{1,3}at\s{1,3}|\s{0,3}[_-]at[_-]\s{0,3})"
    r"(?=([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))",
    re.I | re.A,
)
#: Characters that are rewritten as dots.
_DOTS = "\uff0e" + "".join(c for c, plain in LOOKALIKES.items() if plain == ".")


class Rewriting:
    """A text and, by pieces, the places of the source it came from."""

    def __init__(self, text: str):
        self.text = text
        self.steps: list[tuple[list[int], list[tuple[int, int, bool]]]] = []

    def replace(self, pattern: re.Pattern, output: Callable[[re.Match], str]) -> None:
        """One transducer: what ``pattern`` finds becomes ``output``."""
        self.edit((*m.span(), output(m)) for m in pattern.finditer(self.text))

    def edit(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """One transducer: from start to stop the text becomes another, in order."""
        made: list[str] = []
        starts: list[int] = []  # of pieces, in the new text
        sources: list[tuple[int, int, bool]] = []  # their place before; copied or not
        done = length = 0
        for start, stop, new in edits:
            if new == self.text[start:stop]:
                continue
            for piece, a, b, copied in (
                (self.text[done:start], done, start, True),
                (new, start, stop, False),
            ):
                if piece:
                    made.append(piece)
                    starts.append(length)
                    sources.append((a, b, copied))
                    length += len(piece)
            done = stop
        if not done:
            return
        made.append(self.text[done:])
        starts.append(length)
        sources.append((done, len(self.text), True))
        self.text = "".join(made)
        self.steps.append((starts, sources))

    def source(self, start: int, stop: int, since: int = 0) -> tuple[int, int, bool]:
        """The span of the source, and whether anything in it was rewritten.

        With ``since``, by that step or later ones, and the span of the text it took.
        """
        changed = False
        for starts, sources in reversed(self.steps[since:]):
            first, last = bisect_right(starts, start) - 1, bisect_right(starts, stop - 1) - 1
            a, _, copied_first = sources[first]
            b, b_end, copied_last = sources[last]
            changed |= last > first or not copied_first
            start = a + (start - starts[first] if copied_first else 0)
            stop = b + stop - starts[last] if copied_last else b_end
        return start, stop, changed


def _spelled(words: str) -> str:
    """The digits of a digit word, or figure, with what says how often it counts."""
    *often, digit = re.split(r"[\s-]+", words.lower())
    return SPELLED.get(digit, digit) * (REPEATED[often[0]] if often else 1)


def _digits(match: re.Match) -> str:
    words = _DIGIT_WORDS.findall(match[0])
    return "".join("+" if w.lower() == "plus" else _spelled(w) for w in words)


def _may_have_mixed_runs(low: str) -> bool:
    """Whether a digit word of a text in lower case has company. Looks at those alone."""
    for word in SPELLED:
        start = low.find(word)
        while start >= 0:
            stop = start + len(word)
            if not (low[max(0, start - 1) : start] + low[stop : stop + 1]).isalpha() and (
                _NEAR_BEFORE.search(low[max(0, start - 16) : start])
                or _NEAR_AFTER.match(low[stop : stop + 16])
            ):
                return True
            start = low.find(word, stop)
    return False


def _mixed_digits(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits for runs of two figures or more, or with a figure, "+" or dot beside them.

    Single figures are joined to one number, and a space parts it from longer ones.
    """
    for run in _MIXED_RUN.finditer(text):
        start, stop = run.span()
        tokens = [(*m.span(), _spelled(m[0])) for m in _FIGURES.finditer(text, start, stop)]
        if all(text[a] == figure[0] for a, _, figure in tokens):
            continue  # no words
        if len(tokens) == 1 and start == tokens[0][0]:
            if not _BEFORE_RUN.search(text[max(0, start - 12) : start]) and not _AFTER_RUN.match(
                text[stop : stop + 12]
            ):
                continue
        if start < tokens[0][0]:
            yield start, tokens[0][0], "+"
        for i, (a, b, figure) in enumerate(tokens):
            if i:
                end = tokens[i - 1][1]
                # Numbers of several figures stay apart from what is beside them.
                apart = any(len(f) > 1 and f == text[x:y] for x, y, f in (tokens[i - 1], tokens[i]))
                yield end, a, " " if apart else ""
            yield a, b, figure


def _with_ascii(text: str) -> Rewriting:
    """The text with look-alike characters undone."""
    out = Rewriting(text)
    if not text.isascii():
        out.replace(
            _DISGUISED_CHARACTERS,
            lambda m: "" if m[0] in INVISIBLE else _plain_character(m[0]),
        )
    return out


def rewrite(
    text: str, mixed: bool = False, ascii_text: Rewriting | None = None
) -> Rewriting | None:
    """The text with its disguises undone; None if it has none.

    Spelled digits are undone in runs of three words or more. With ``mixed``, they are
    also in shorter ones and among figures; None if that makes no difference.
    ``ascii_text`` saves the first step, of characters, where it has been done.
    """
    out = copy(ascii_text or _with_ascii(text))
    out.steps = list(out.steps)
    low = out.text.lower()
    if mixed:
        if not _may_have_mixed_runs(low):
            return None
        before = out.text
        out.edit(_mixed_digits(before))
        if out.text == before or out.text == _DIGIT_RUN.sub(_digits, before):
            return None
    elif sum(map(low.count, SPELLED)) >= 3:
        out.replace(_DIGIT_RUN, _digits)
    bracketed = any(c in low for c in "([{<") and _BRACKETS.search(low) is not None
    if bracketed:
        out.replace(_BRACKETED, lambda m: "@" if m[1].lower() in ("at", "@") else ".")
    if "dot" in low:
        out.replace(_SPOKEN_DOT, lambda _: ".")
    if bracketed or "dot" in low or any(c in text for c in _DOTS):

        def at_sign(match: re.Match) -> str:
            host, start = match[1], match.start(1)
            dots = (start + i for i, c in enumerate(host) if c == ".")
            return "@" if any(out.source(d, d + 1)[2] for d in dots) else match[0]

        out.replace(_SPOKEN_AT, at_sign)
    return out if out.steps else None


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """Spans (kind, start, stop, disguised) by kind, then start.

    Plain ones are all there; a disguised one is added unless it is one of its kind or lies
    inside one. It may overlap plain ones, of which it has the part that isn't disguised.
    """
    found = [(kind, a, b, False) for kind, find in _FINDERS.items() for a, b in find(text)]
    ascii_text = _with_ascii(text)
    for mixed in (False, True):
        rewritten = rewrite(text, mixed, ascii_text)
        if rewritten is not None:
            _add_disguised(found, rewritten)
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _add_disguised(found: list[tuple[str, int, int, bool]], rewritten: Rewriting) -> None:
    """Adds what is disguised and not inside a span of its kind that is ``found`` already."""
    for kind, find in _FINDERS.items():
        taken = sorted((a, b) for k, a, b, _ in found if k == kind)
        begins = [a for a, _ in taken]
        ends = [0, *accumulate((b for _, b in taken), max)]
        for span in find(rewritten.text):
            a, b, changed = rewritten.source(*span)
            # Of the spans that begin at a or before, does any end at b or after?
            if changed and ends[bisect_right(begins, a)] < b:
                found.append((kind, a, b, True))


def masked(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, from the first start to the last stop.
    """
    spans = sorted((a, b, kind) for kind, a, b, _ in find_spans(text))
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)  # of overlapping spans the first names them all
    return "".join([*out, text[done:]])


# ---------------------------------------------------------------- on tables


def find_pii(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` and ``spans``: kind, start, stop (code points) and ``disguised``.

    One row each, also for repeated rows; a null or empty text has an empty array. Other
    columns are left aside, whatever their names. Time and memory follow the length of
    the text.
    """

    def measure(texts: list[str]) -> list[list]:
        names = ("kind", "start", "stop", "disguised")
        return [[[dict(zip(names, s)) for s in find_spans(t)] for t in texts]]

    return map_texts(df, text, keep, f"spans {SPANS}", lambda: measure)


def mask_pii(df: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """All columns of ``df``, with personal data in ``text`` replaced by its kind.

    A null text stays null. The column ``length``, if named, gets the new number of
    characters where the text has changed.
    """
    others = [c for c in df.columns if c != text]
    new = "masked"
    while new in df.columns:
        new += "_"
    done = map_texts(
        df, text, df.columns, f"{new} string", lambda: lambda ts: [[masked(t) for t in ts]]
    )
    result = F.when(F.col(text).isNotNull(), F.col(new))
    columns = {c: F.col(c) for c in others} | {text: result}
    if length is not None:
        columns[length] = F.when(
            F.col(new) != F.col(text), F.char_length(new).cast(df.schema[length].dataType)
        ).otherwise(F.col(length))
    return done.select(*(columns[c].alias(c) for c in df.columns))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ","
    )


def op10_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data in every document."""
    found = find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))
    plain = F.filter("spans", lambda s: ~s.disguised)
    counts = {
        f"n_{kind}": _count(plain, kind)
        for kind in KINDS
    }
    return found.select(
        "doc_id",
        *(c.alias(name) for name, c in counts.items()),
        F.sha2(_joined(plain), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
