"""Phrases that pages should hold: each page is asked for letters of its own, misread, or for those of another page."""

from __future__ import annotations

from pyspark.sql import functions as F

from pliego.functions.text import html_text
from pliego.operators import phrases
from pliego.plans.base import query


def claims(t):
    """(page_id, text, phrase, terms): pages with a phrase of 45 letters of which two are misread; every third page's is the one before's."""
    pages = t("pages").select("page_id", html_text(F.col("html")).alias("text"))
    whole = F.substring(phrases.letters(F.col("text")), 30, 45)
    misread = F.concat(F.substring(whole, 1, 11), F.lit("0"), F.substring(whole, 13, 17), F.substring(whole, 31, 15))
    given = pages.select((F.col("page_id") + F.when((F.col("page_id") + 1) % 3 == 0, 1).otherwise(0)).alias("page_id"), misread.alias("phrase"), F.array(F.substring(whole, 1, 9), F.substring(whole, 10, 8), F.substring(whole, 35, 5)).alias("terms"))
    return pages.join(given, "page_id")


@query()
def page_phrases(t):
    """Whether each page holds its phrase in one piece, where, and the terms that it lacks."""
    return phrases.find_phrase(claims(t), "text", "phrase", "terms").select("page_id", "phrase", "state", "start", "end", F.round("score", 6).alias("score"), F.array_join("missing", ",").alias("missing"))
