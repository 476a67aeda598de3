"""Normalising and reading short official texts. All are column expressions on strings; null in, null out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folded() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Characters that decompose: to one letter with marks, to one ASCII character in any way, and to several."""
    marked, single, several = {}, {}, {}
    for code in [*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0x2000, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != c:
            marked[c] = base[0]
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single[c] = plain
        elif plain:
            several[c] = plain
    return marked, single, several


_MARKED, _SINGLE, _SEVERAL = _folded()
#: Letters of Western Europe, which are replaced one by one: that is far less work than to look up each character of a text.
_WESTERN = {c: _SINGLE.get(c, "") for c in map(chr, range(0xC0, 0x100)) if c not in _SEVERAL}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without_marks(text: Column) -> Column:
    """Letters without their marks, whether these are part of the letter or follow it."""
    return F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())), r"\p{Mn}+", "")


def ascii_of(text: Column) -> Column:
    """Compatible ASCII characters: letters without marks, º as o, ½ as 12, ﬁ as fi, … as three dots; all others go."""
    plain = lambda t: F.octet_length(t) == F.length(t)
    some = "[" + "".join(_SEVERAL) + "]"

    def rest(t: Column) -> Column:
        wide = t
        for char, said in _SEVERAL.items():
            wide = F.replace(wide, F.lit(char), F.lit(said))
        wide = F.when(t.rlike(some), wide).otherwise(t)
        return F.regexp_replace(F.translate(wide, "".join(_SINGLE), "".join(_SINGLE.values())), r"[^\x00-\x7F]", "")

    def western(t: Column, first: int, then: Callable[[Column], Column]) -> Column:
        for code in range(first, first + 32):
            if (char := chr(code)) in _WESTERN:
                t = F.replace(t, F.lit(char), F.lit(_WESTERN[char]))
        return let(t, lambda t: F.when(plain(t), t).otherwise(then(t)))

    # small letters first, as most texts have no others
    return F.when(plain(text), text).otherwise(western(text, 0xE0, lambda t: western(t, 0xC0, rest)))


def fold(text: Column) -> Column:
    """Without marks, in lower case."""
    return F.lower(without_marks(text))


def norm(text: Column) -> Column:
    """Compatible ASCII characters only, single spaces, trimmed, in upper case."""
    return F.upper(F.trim(F.regexp_replace(ascii_of(text), r"\s+", " ")))


def clean(text: Column) -> Column:
    """`norm`, with runs of letters and digits only, joined by spaces."""
    return F.array_join(F.regexp_extract_all(norm(text), F.lit("[A-Z0-9]+"), F.lit(0)), " ")


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of `clean` with over two characters that aren't stop words."""
    words = F.array_distinct(F.split(clean(text), " "))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop) if stop else F.length(w) > 2)


def contains_folded(text: Column, needle: str) -> Column:
    return F.contains(fold(text), fold(F.lit(needle)))


def first_filled(*texts: Column) -> Column:
    """The first text that has more than blanks."""
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts])


def excerpt(text: Column, most: int) -> Column:
    """A text of `most` characters at most, with dots where it was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def html_text(html: Column) -> Column:
    """Text of markup: tags to spaces, the five named entities, single spaces."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def numbers(text: Column, least: int = 3, most: int = 6) -> Column:
    """Distinct numbers of so many digits, leading zeros dropped, in order."""
    found = F.regexp_extract_all(text, F.lit(rf"(?<!\d)\d{{{least},{most}}}(?!\d)"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("long"))))


def locale_amount(text: Column) -> Column:
    """`21,676,278.41` and `1'000,237.56` as decimals; other shapes are null."""
    digits = F.regexp_replace(F.trim(text), r"[',\s]", "")
    return F.when(F.trim(text).rlike(r"^\d{1,3}([',]?\d{3})*(\.\d+)?$"), digits.try_cast("decimal(18,2)"))


def page_list(text: Column) -> Column:
    """`49-56; 78` as a list of pages; inverted ranges are dropped."""
    parts = F.split(F.regexp_replace(text, r"\s", ""), "[;,]")
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    high = lambda p: F.coalesce(F.regexp_extract(p, r"^\d+-(\d+)$", 1).try_cast("int"), low(p))
    valid = F.filter(parts, lambda p: p.rlike(r"^\d+(-\d+)?$") & (high(p) >= low(p)))
    return F.flatten(F.transform(valid, lambda p: F.sequence(low(p), high(p))))


def verdict(text: Column) -> Column:
    """si, no or pend from free text; null where nothing is said. Pending words win over a yes or no."""
    t = norm(text)
    return (
        F.when(t.isNull() | (t == ""), None)
        .when(t.rlike("POR VERIFICAR|PENDIENTE"), "pend")
        .when(t.rlike(r"\bNO\b"), "no")
        .when(t.rlike(r"\bSI\b|\bCUMPLE\b"), "si")
    )
