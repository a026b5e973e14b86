"""One consistent form of a text: the plain form, its words and its folded key.

*Plain form*: what a reader sees.  Unseen characters are gone, special spaces are ordinary spaces, compatibility
forms are ordinary letters (NFKC), a letter and its accent are one character, and a look-alike letter inside a word
that has basic Latin letters is the basic Latin letter it imitates.  Case, punctuation, accents, tabs, line breaks and
the number of spaces stay.

*Words*: of the plain form in lower case, the longest runs of letters and digits, and single symbols that are neither
space nor punctuation.

Nulls stay null; a text without words has an empty list of words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets that look like basic Latin letters, in the order of the Latin ones.
LOOKALIKES = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ",
    "I": "ІΙӀꓲ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜᎷꓟ", "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ",
    "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "Ѵꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ",
    "Y": "ҮΥꓬ", "Z": "ΖᏃꓜ",
    "a": "аαɑ", "b": "Ьᖯ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "f": "ք", "g": "ɡց", "h": "һհ", "i": "іιıɩ", "j": "јϳ",
    "k": "κк", "l": "ӏ", "m": "ᴍ", "n": "ոп", "o": "оοօᴏ", "p": "рρ", "q": "ԛզ", "r": "гᴦ", "s": "ѕꜱ", "t": "τт",
    "u": "υսᴜ", "v": "νѵᴠ", "w": "ԝѡᴡ", "x": "хχ", "y": "уүγ", "z": "ᴢ",
}

_SEEN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# Default-ignorable characters whose category is not Cf.
_UNSEEN_RANGES = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2060, 0x206F), (0x3164, 0x3164),
                  (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))


def _ranges(points: list[int]) -> str:
    """A regular expression's class body for sorted code points."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        a, b = f"\\U{points[i]:08x}", f"\\U{points[j]:08x}"
        out.append(a if i == j else f"{a}-{b}")
        i = j + 1
    return "".join(out)


class _Tables:
    def __init__(self) -> None:
        unseen, space, punct = [], [], []
        for p in chain(range(0x20000), range(0xE0000, 0xE1000)):  # beyond these planes are only letters and unassigned points
            kind = unicodedata.category(chr(p))
            if (kind == "Cf" and p not in _SEEN_FORMAT) or (kind == "Cc" and not chr(p).isspace()) or any(a <= p <= b for a, b in _UNSEEN_RANGES):
                unseen.append(p)
            elif kind == "Zs" and p != 0x20:
                space.append(p)
            elif kind[0] == "P":
                punct.append(p)
        self.latin = {ord(x): latin for latin, alike in LOOKALIKES.items() for x in alike}
        self.first = dict.fromkeys(unseen) | dict.fromkeys(space, " ")
        alike = _ranges(sorted(self.latin))
        # Precomposed letters whose base is a look-alike, such as Cyrillic yo, count as look-alikes too.
        built = [p for p in range(0x370, 0x530) if (d := unicodedata.normalize("NFD", chr(p))) != chr(p) and ord(d[0]) in self.latin]
        built += [p for p in range(0x1F00, 0x2000) if (d := unicodedata.normalize("NFD", chr(p))) != chr(p) and ord(d[0]) in self.latin]
        self.odd = re.compile(f"[{_ranges(sorted(unseen + space))}]")
        self.alike = re.compile(f"[{alike}{_ranges(built)}]")
        marks = _ranges([p for p in range(0x300, 0x370)])
        self.word = re.compile(f"(?:[^\\W_]|[{marks}])+")
        self.basic = re.compile("[A-Za-z]")
        p = _ranges(punct)
        # Underscores are punctuation; they are spaces before these run.
        self.words = re.compile(f"\\w+|[^\\w\\s{p}]")
        self.pieces = re.compile(f"\\w+|[^\\w\\s{p}]|\n|[.!?](?=\\s)")


_ASCII_UNSEEN = re.compile("[\x00-\x08\x0e-\x1b\x7f]")
_ASCII_WORDS = re.compile(r"[a-z0-9]+|[$+<=>^`|~]")
_ASCII_PIECES = re.compile(r"[a-z0-9]+|[$+<=>^`|~]|\n|[.!?](?=\s)")


@cache
def tables() -> _Tables:
    """Character tables, built once in each Python process."""
    return _Tables()


def plain_form(text: str) -> str:
    """The plain form of a text."""
    if text.isascii():
        return _ASCII_UNSEEN.sub("", text) if _ASCII_UNSEEN.search(text) else text
    t = tables()
    if t.odd.search(text):
        text = text.translate(t.first)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
        if t.odd.search(text):
            text = unicodedata.normalize("NFKC", text.translate(t.first))
    if t.alike.search(text):
        text = t.word.sub(_latin, text)
    return text


def _latin(m: re.Match[str]) -> str:
    word, t = m[0], tables()
    if word.isascii() or not t.alike.search(word) or not t.basic.search(word):
        return word
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(t.latin))


def words_of(text: str | None) -> list[str]:
    """The words of a text."""
    if not text:
        return []
    low = plain_form(text).lower()
    return _ASCII_WORDS.findall(low) if low.isascii() else tables().words.findall(low.replace("_", " "))


def pieces_of(text: str | None) -> list[str]:
    """Words with the marks that end a line or a sentence between them."""
    if not text:
        return []
    low = plain_form(text).lower()
    return _ASCII_PIECES.findall(low) if low.isascii() else tables().pieces.findall(low.replace("_", " "))


_PARTS = re.compile(r"[\n|]")


def _is_field(part: str) -> bool:
    """Whether a line is ``name: value``: a word stands before its first colon and something after it.  A name may be of any
    length and of any words."""
    name, _, value = part.partition(":")
    return bool(value.strip()) and any(c.isalnum() for c in name)


def record_fields(text: str) -> list[str] | None:
    """The fields of a record card (three or more ``name: value``, parted by line breaks or ``|``), else None.  Prose whose
    every line has a colon between words is a card too, which only says that its lines may come in any order."""
    if text.count(":") < 3:
        return None
    parts = [p for p in _PARTS.split(text) if p.strip()]
    return parts if len(parts) >= 3 and all(map(_is_field, parts)) else None


def fold(text: str) -> str:
    """Full case folding of the plain form, with every run of white space as one space: equal for texts that differ in
    look, case or spacing at most; texts of equal plain form always have equal keys."""
    return " ".join(unicodedata.normalize("NFKC", plain_form(text).casefold()).split())


def parts(batch: pa.RecordBatch, text: int, rows: int = 2000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``chars`` characters of column ``text``; a longer text is a slice
    by itself."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    o = 0
    while o < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[o - 1] if o else 0) + chars, side="right"))
        part = batch.slice(o, max(1, min(rows, most - o)))
        o += part.num_rows
        yield part


def per_distinct(values: pa.Array | pa.ChunkedArray, f, kind: pa.DataType) -> pa.Array:
    """Apply ``f`` once to each distinct value of an Arrow array; null stays null."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    coded = values.dictionary_encode()
    done = pa.array([f(x) for x in coded.dictionary.to_pylist()], kind)
    return done.take(coded.indices)


def column(f, returns: T.DataType, kind: pa.DataType):
    """A column function from a Python function of one string, run once for each distinct value of an Arrow batch."""

    @F.arrow_udf(returns)
    def run(values: pa.Array) -> pa.Array:
        return per_distinct(values, f, kind)

    def of(col: Column | str) -> Column:
        return run(F.col(col) if isinstance(col, str) else col)

    of.__doc__ = f.__doc__
    return of


plain = column(plain_form, T.StringType(), pa.string())
folded = column(fold, T.StringType(), pa.string())
words = column(words_of, T.ArrayType(T.StringType()), pa.list_(pa.string()))
word_line = column(lambda t: None if t is None else " ".join(words_of(t)), T.StringType(), pa.string())
