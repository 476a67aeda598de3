"""Whether a process, a company or a place is the one that a certificate speaks of: signals of three values, and verdicts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What signals say, and verdicts.
FOR, AGAINST, UNKNOWN = "a_favor", "en_contra", "sin_dato"


def _said(rule_for: Column, rule_against: Column | None = None) -> Column:
    out = F.when(F.coalesce(rule_for, F.lit(False)), FOR)
    if rule_against is not None:
        out = out.when(F.coalesce(rule_against, F.lit(False)), AGAINST)
    return out.otherwise(UNKNOWN)


def entity_signal(score: Column) -> Column:
    """From a similarity of names: 85 and more speaks for it, under 60 against it, between them neither."""
    return _said(score >= 85, score < 60)


def awardee_signal(issuer: Column, awardees: Column) -> Column:
    """The issuer's tax number among the awardees'. It never contradicts."""
    return _said(F.array_contains(awardees, issuer))


def object_signal(expected: Column, found: Column) -> Column:
    """The kind of service expected and found; `otro` and nothing at all are unknown."""
    known = (F.coalesce(expected, F.lit("")) != "") & ~F.coalesce(found, F.lit("")).isin("", "otro")
    return _said(known & (expected == found), known & (expected != found))


def time_signal(start: Column, end: Column, signed: Column, valid_from: Column, valid_to: Column, slack: int = 15) -> Column:
    """Against: signed over `slack` days after the start, or no day shared with the term. For: a day shared, or without a term the signature alone."""
    late = F.datediff(signed, start) > slack
    term = valid_from.isNotNull() & valid_to.isNotNull() & end.isNotNull()
    shared = F.datediff(F.least(end, valid_to), F.greatest(start, valid_from)) + 1
    return (
        F.when(start.isNull() | (signed.isNull() & (valid_from.isNull() | valid_to.isNull())), UNKNOWN)
        .when(F.coalesce(late, F.lit(False)), AGAINST)
        .when(term & (shared <= 0), AGAINST)
        .when(term | signed.isNotNull(), FOR)
        .otherwise(UNKNOWN)
    )


def amount_signal(a: Column, b: Column, tolerance: float = 0.20) -> Column:
    """Amounts that differ by a fifth of the larger at most speak for it; others say nothing."""
    return _said(F.abs(a - b) <= F.lit(tolerance) * F.greatest(a, b))


def process_verdict(entity: Column, awardee: Column, object_: Column, contracts: Column) -> Column:
    """Any strong signal against contradicts; several contracts leave it open; two strong ones for it, the awardee's included, confirm it."""
    strong = F.array(entity, awardee, object_)
    agree = F.size(F.filter(strong, lambda s: s == FOR))
    return (
        F.when(F.array_contains(strong, AGAINST), "CONTRADICE")
        .when(contracts > 1, "POR_CONFIRMAR")
        .when((agree >= 2) & (awardee == FOR), "CONFIRMADO")
        .otherwise("POR_CONFIRMAR")
    )


def selected(processes: DataFrame, case: str, kind: str, id_: str, wanted: Column) -> DataFrame:
    """The one process of the wanted kind of each case: (case, id, n, state): selected, ambiguous or none."""
    of_kind = F.when(F.col(kind) == wanted, F.col(id_))
    counted = processes.groupBy(case).agg(F.count_distinct(of_kind).alias("n"), F.min(of_kind).alias("only"))
    state = F.when(F.col("n") == 1, "selected").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return counted.select(case, F.when(F.col("n") == 1, F.col("only")).alias(id_), "n", state.alias("state"))


def only_best(scored: DataFrame, case: str, id_: str, score: str) -> DataFrame:
    """The id with the best score of each case, null if several ids share it: (case, id, score)."""
    best = scored.groupBy(case).agg(F.max(score).alias("best"))
    top = scored.join(best, case).where(F.col(score) == F.col("best")).groupBy(case).agg(F.count_distinct(id_).alias("n"), F.min(id_).alias("m"), F.max(score).alias(score))
    return top.select(case, F.when(F.col("n") == 1, F.col("m")).alias(id_), score)


def exact_or_only_active(matches: DataFrame, case: str, id_: str, equal: Column, active: Column) -> DataFrame:
    """The only match of the same name of each case, else the only active one of these, else null: (case, id)."""
    rows = matches.where(equal).withColumn("active", active)
    found = rows.groupBy(case).agg(F.count("*").alias("n"), F.min(id_).alias("only"), F.count_if("active").alias("actives"), F.min(F.when(F.col("active"), F.col(id_))).alias("live"))
    return found.select(case, F.when(F.col("n") == 1, F.col("only")).when(F.col("actives") == 1, F.col("live")).alias(id_))


def card_bonus(near: Column, official: Column, department: Column, others: Column, hints: Column, entity: Column) -> Column:
    """What an official card adds to a candidate's score: the official name's lead, the department, the entity's name.

    `department` is the card's, `others` the candidate's own; `entity` a similarity. Only both departments together contradict.
    """
    name = F.greatest(F.coalesce(official, F.lit(0.0)) - F.coalesce(near, F.lit(0.0)), F.lit(0.0))
    known = (F.size(hints) > 0) & department.isNotNull()
    place = F.when(known & F.array_contains(hints, department), 10).when(known & others.isNotNull() & ~F.array_contains(hints, others), -10).otherwise(0)
    return F.round(name + place + F.when(F.coalesce(entity, F.lit(0.0)) >= 90, 15).otherwise(0), 1)


def promoted(evidence: DataFrame, case: str, id_: str, positive: str, most: int = 3) -> DataFrame:
    """Cases with `most` candidates at most of which exactly one has official evidence: (case, id)."""
    found = evidence.groupBy(case).agg(F.count_distinct(id_).alias("n"), F.count_distinct(F.when(F.col(positive), F.col(id_))).alias("good"), F.min(F.when(F.col(positive), F.col(id_))).alias(id_))
    return found.where((F.col("n") <= most) & (F.col("good") == 1)).select(case, id_)


def offsets(owners: DataFrame, group: str, at: str, owner_at: str) -> DataFrame:
    """The commonest step from a row's place to that of the row whose words it uses: (group, step, times, judged, pattern).

    pattern: the step occurs twice or more and in most rows of the group that were judged. Of equally common steps the
    smaller one counts, of these the positive one. Groups without a row of another's words are absent.
    """
    step = (F.col(owner_at) - F.col(at)).alias("step")
    judged = owners.groupBy(group).agg(F.count("*").alias("judged"))
    counted = owners.where(F.col(owner_at) != F.col(at)).groupBy(group, step).agg(F.count("*").alias("times"))
    best = counted.groupBy(group).agg(F.max_by(F.struct("step", "times"), F.struct("times", -F.abs("step"), "step")).alias("m"))
    out = best.join(judged, group).select(group, "m.step", "m.times", "judged")
    return out.withColumn("pattern", (F.col("times") >= 2) & (2 * F.col("times") > F.col("judged")))


def word_owner(said: DataFrame, own: DataFrame, group: str, at: str) -> DataFrame:
    """Whose words each row of a group uses: (group, at, owner_at), its own place if any word is its own.

    `said` and `own`: (group, at, word), the words of each row's text and those that belong to one row alone.
    Of others the one with most words counts, then the nearest, then the upper one. Rows without own words, and
    rows that use nobody's, are absent.
    """
    keyed = own.select(group, F.col(at).alias("owner_at"), "word").distinct()
    judged = own.select(group, at).distinct()
    hits = said.select(group, at, "word").distinct().join(judged, [group, at]).join(keyed, [group, "word"]).groupBy(group, at, "owner_at").agg(F.count("*").alias("n"))
    mine = F.col("owner_at") == F.col(at)
    rank = F.struct(mine.alias("mine"), "n", (-F.abs(F.col("owner_at") - F.col(at))).alias("near"), (-F.col("owner_at")).alias("upper"))
    return hits.groupBy(group, at).agg(F.max_by("owner_at", rank).alias("owner_at"))


def position_match(words: DataFrame, required: DataFrame, case: str, id_: str) -> DataFrame:
    """The requirement that shares most words with a position: (case, id, score), id null where two share the best score.

    The score is the number of shared words and their share of the requirement's.
    """
    sizes = required.select(id_, "word").distinct().groupBy(id_).agg(F.count("*").alias("size"))
    shared = words.select(case, "word").distinct().join(required.select(id_, "word").distinct(), "word").groupBy(case, id_).agg(F.count("*").alias("shared"))
    scored = shared.join(sizes, id_).withColumn("score", F.round(F.col("shared") + F.col("shared") / F.col("size"), 9))
    return only_best(scored, case, id_, "score")
