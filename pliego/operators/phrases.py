"""Whether a page holds a phrase in one piece, though its letters were misread, and the phrase's own terms within it.

A page is compared by its letters and digits alone (`letters`). A phrase counts as found where a window of
its length is as like it as `least` asks (indel similarity). Such a window differs by few edits, so of
one piece more than edits at least one stands in it unchanged: pages without any piece are put aside by
Spark's own functions, and only windows around unchanged pieces are measured, each page in its task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from pliego.functions.similarity import ratio
from pliego.functions.text import norm

# Likeness of a phrase and of a term, letters that a phrase, a page and a term to be likened must have, least slack.
PHRASE, TERM = 90, 88
PHRASE_LETTERS, PAGE_LETTERS, TERM_LETTERS = 8, 40, 6
SLACK = 2


def letters(text: Column) -> Column:
    return F.regexp_replace(norm(text), "[^A-Z0-9]", "")


def edits(size: int, least: float = PHRASE) -> int:
    """Most single edits between a phrase of so many letters and a window of at most that length which is like it."""
    return math.floor(2 * size * (100 - least) / 100 + 1e-9)


def pieces(phrase: Column, least: float = PHRASE) -> Column:
    """A phrase cut into one piece more than `edits`, of which one at least stands unchanged in any window like it."""
    size = F.length(phrase)
    count = F.floor(2 * size * (100 - least) / 100 + 1e-9).cast("int") + 1
    edge = lambda i: F.floor(i * size / count).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(phrase, edge(i) + 1, edge(i + 1) - edge(i)))


def best_window(phrase: str, text: str, least: float = PHRASE) -> tuple[int, int, float] | None:
    """Start, end and likeness of the best window (the first of equals) that reaches `least`."""
    size, most = len(phrase), edits(len(phrase), least)
    bounds = [i * size // (most + 1) for i in range(most + 2)]
    starts = set()
    for a, b in zip(bounds, bounds[1:], strict=False):
        at = text.find(phrase[a:b]) if b > a else -1
        while at >= 0:
            starts.update(range(at - a - most, at - a + most + 1))
            at = text.find(phrase[a:b], at + 1)
    found = None
    for s in sorted(starts):
        start, end = max(s, 0), min(s + size, len(text))
        if end > start:
            score = ratio(phrase, text[start:end])
            if score >= least and (found is None or score > found[2]):
                found = start, end, score
    return found


def slack(size: int, least: float = PHRASE) -> int:
    """How many letters may have been put into a phrase of that size that still is found."""
    return max(SLACK, math.ceil(2 * size * (100 - least) / least))


def has_term(term: str, window: str) -> bool:
    """The term stands in the window, or, if it is long enough, a stretch of its size or up to `slack` more is like it."""
    if term in window:
        return True
    if len(term) < TERM_LETTERS:
        return False
    sizes = range(len(term), len(term) + slack(len(term)) + 1)
    whole = any(ratio(term, window[i : i + n]) >= TERM for n in sizes for i in range(max(len(window) - n + 1, 0)))
    return whole or best_window(term, window, TERM) is not None


HIT = StructType().add("start", "integer").add("end", "integer").add("score", "double").add("missing", ArrayType(StringType()))


@F.pandas_udf(HIT)
def _look(text: pd.Series, phrase: pd.Series, terms: pd.Series, literal: pd.Series) -> pd.DataFrame:
    out = []
    for t, p, own, at in zip(text, phrase, terms, literal, strict=True):
        own = [w for w in (own if own is not None else []) if w]
        found = None if t is None or p is None else (int(at), int(at) + len(p), 100.0) if at >= 0 else best_window(p, t)
        if found is None:
            out.append((None, None, None, own))
            continue
        room = slack(len(p))
        window = t[max(0, found[0] - room) : max(found[1], found[0] + len(p)) + room]
        out.append((*found, [w for w in own if not has_term(w, window)]))
    frame = pd.DataFrame(out, columns=["start", "end", "score", "missing"])
    return frame.astype({"start": "Int32", "end": "Int32", "score": "float64"})


def find_phrase(rows: DataFrame, text: str, phrase: str, terms: str) -> DataFrame:
    """Add state, start, end, score and missing to rows of a page's text, a phrase and its terms (an array).

    States: no_phrase (under 8 letters), unreadable (a page of under 40 letters: no judgement), absent,
    other (found, but the terms in `missing` aren't in it) and found. Places are among the page's letters; the
    window of a found phrase reaches a few letters further on either side when terms are looked for.
    Nulls count as empty; without terms a found phrase is enough. Rows stay as many as they were.
    """
    own = [c for c in rows.columns if c not in ("state", "start", "end", "score", "missing")]
    empty = lambda c: letters(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    wanted = F.transform(F.coalesce(F.col(f"`{terms}`"), F.array().cast("array<string>")), lambda w: letters(F.coalesce(w, F.lit(""))))
    read = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), empty(text).alias("text"), empty(phrase).alias("phrase"), wanted.alias("terms"))
    judged = read.withColumn("state", F.when(F.length("phrase") < PHRASE_LETTERS, "no_phrase").when(F.length(F.regexp_replace("text", "[0-9]", "")) < PAGE_LETTERS, "unreadable"))
    likely = F.col("state").isNull() & F.exists(pieces(F.col("phrase")), lambda p: F.contains(F.col("text"), p))
    looked = judged.withColumn("hit", _look(F.when(likely, F.col("text")), "phrase", "terms", F.expr("locate(phrase, text) - 1")))
    state = F.coalesce("state", F.when(F.col("hit.start").isNull(), "absent").when(F.size("hit.missing") > 0, "other").otherwise("found"))
    return looked.select(*[F.col("row")[c].alias(c) for c in own], state.alias("state"), *[F.col(f"hit.{c}").alias(c) for c in ("start", "end", "score", "missing")])
