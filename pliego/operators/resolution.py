"""Resolving a name to one record: candidate scores, vetoes and gates, all of them columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score(similarity: Column, same_number: Column, same_place: Column, sector_words: Column, years_apart: Column) -> Column:
    """Similarity with bonuses. A null signal is unknown and neither adds nor takes away."""
    number = F.when(same_number.isNull(), 0).when(same_number, 40).otherwise(-15)
    place = F.when(same_place.isNull(), 0).when(same_place, 15).otherwise(-10)
    return similarity + number + place + F.when(F.coalesce(sector_words, F.lit(False)), 5).otherwise(0) + F.when(years_apart <= 3, 8).otherwise(0)


def veto(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that fires, null if none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def decide(candidates: DataFrame, case: str, guard: float = 4.0, sure: float = 90.0, likely: float = 70.0) -> DataFrame:
    """One row per case: (case, candidate, score, rivals, via).

    `candidates`: (case, candidate, score, hits, needed, veto). Vetoed candidates never win. A rival
    within `guard` makes the decision abstain; else enough words in common and a good score resolve it.
    """
    w = Window.partitionBy(case)
    free = F.when(F.col("veto").isNull(), F.col("score"))
    ranked = candidates.withColumn("free", free).withColumn("best", F.max("free").over(w))
    ranked = ranked.withColumn("rivals", (F.count_if(F.col("best") - F.col("free") <= guard).over(w) - 1).cast("long"))
    top = ranked.withColumn("rn", F.row_number().over(w.orderBy(F.desc_nulls_last("free"), "candidate"))).where("rn = 1")
    via = (
        F.when(F.col("free").isNull(), "VETADO")
        .when(F.col("rivals") > 0, "EMPATE")
        .when((F.col("hits") >= F.col("needed")) & (F.col("free") >= likely), "NOMBRE")
        .when((F.col("hits") >= F.col("needed")) | ((F.col("free") >= sure) & (F.col("hits") >= 1)), "PROBABLE")
        .otherwise("REVISION")
    )
    return top.select(case, "candidate", F.col("free").alias("score"), F.greatest("rivals", F.lit(0).cast("long")).alias("rivals"), via.alias("via"))


def inherit(rows: DataFrame, id_: str, group: str, code: str, alike) -> DataFrame:
    """Rows without a code take it from the earliest row with one of their group that `alike(a, b)` accepts: (id, code, source).

    `alike` gets the structs of both rows. Only rows that had a code give it on, so the order of rows without one doesn't
    matter. Groups are folios or projects: a group's rows with a code meet its rows without one, so keep groups small.
    """
    have = rows.where(F.col(code).isNotNull()).select(group, F.struct("*").alias("giver"))
    lack = rows.where(F.col(code).isNull()).select(group, F.struct("*").alias("taker"))
    found = lack.join(have, group).where(alike(F.col("taker"), F.col("giver"))).groupBy(F.col(f"taker.{id_}").alias(id_))
    best = found.agg(F.min(F.struct(F.col(f"giver.{id_}").alias("source"), F.col(f"giver.{code}").alias(code))).alias("m")).select(id_, f"m.{code}", "m.source")
    own = rows.where(F.col(code).isNotNull()).select(id_, code, F.lit(None).cast("long").alias("source"))
    rest = rows.where(F.col(code).isNull()).select(id_).join(best, id_, "left").select(id_, code, "source")
    return own.unionByName(rest)


def certainty(private: Column, cited: Column, code: Column, parts: Column, resolved: Column, official: Column, inferred: Column) -> Column:
    """How sure it is which work is meant, the first that holds: a private one, a cited code, several works, official evidence, a name."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(private), "privada")
        .when(yes(cited) & code.isNotNull(), "citado")
        .when(parts > 1, F.when(resolved == 0, "sin_identificar").otherwise("multi_obra"))
        .when(yes(official), "confirmado_mef")
        .when(yes(inferred) & ~yes(cited) & code.isNotNull(), "inferido")
        .otherwise("sin_identificar")
    )


def route(declared: Column, override: Column, text: Column) -> Column:
    """By documents or by works: what is declared, else overridden, else what the text says."""
    said = F.when(F.lower(text).rlike("expediente t[eé]cnico|estudio definitivo"), "expediente").otherwise("obra")
    return F.coalesce(declared, override, said)


def days_verdict(days: Column, least: Column, provisional: Column) -> Column:
    """Under the minimum: NO CUMPLE, or POR VERIFICAR while days are provisional or one of both is unknown."""
    return F.when(days.isNull() | least.isNull() | F.coalesce(provisional, F.lit(False)), "POR VERIFICAR").when(days < least, "NO CUMPLE").otherwise("CUMPLE")
