"""Money, percentages, tranches and three-valued verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(amount: Column) -> Column:
    """A double or text as an exact amount with two decimals, rounded half up."""
    return F.round(amount.cast("decimal(18,4)"), 2).cast("decimal(18,2)")


def rounded_even(x: Column, places: int) -> Column:
    """A double rounded to so many decimals, halves to even, where the double times its power of ten is what counts (as DuckDB has it).

    Spark's `bround` goes by the shortest decimals instead: for 255.45000000000002, 2554.5 tenths, it has 255.5 and this 255.4.
    """
    power = 10.0**places
    return F.when(F.abs(x * power) < float("inf"), F.rint(x * power) / power).otherwise(x)


def tranche(percent: Column, tranches: list[tuple[float, float, bool, float]]) -> Column:
    """Points of the tranche (low, high, whether high belongs to it, points) that holds a percentage; null if none does."""
    out = F.lit(None).cast("double")
    for low, high, closed, points in reversed(tranches):
        inside = (percent >= low) & ((percent <= high) if closed else (percent < high))
        out = F.when(inside, F.lit(float(points))).otherwise(out)
    return out


def tranche_faults(probes: DataFrame, tranches: DataFrame) -> DataFrame:
    """Probes (percent) that don't fall into exactly one row of `tranches` (low, high, closed): with their hits."""
    inside = "percent >= low and (percent < high or (closed and percent = high))"
    hits = probes.join(F.broadcast(tranches), F.expr(inside), "left").groupBy("percent").agg(F.count("low").alias("hits"))
    return hits.where("hits <> 1")


def three_valued(condition: Column, verified: Column) -> Column:
    """SI, NO or POR VERIFICAR: what isn't known, or not verified, never condemns."""
    return F.when(condition.isNull(), "POR VERIFICAR").when(condition, "SI").when(F.coalesce(verified, F.lit(False)), "NO").otherwise("POR VERIFICAR")


def amount_verdict(confirmed: Column, most: Column, required: Column) -> Column:
    """CUMPLE if the confirmed amount suffices, NO CUMPLE if even all amounts don't, else POR VERIFICAR."""
    return F.when(confirmed >= required, "CUMPLE").when(most < required, "NO CUMPLE").otherwise("POR VERIFICAR")


def minimum_days(amount: Column, unit: Column) -> Column:
    """A requirement in days, rounded up: years have 365, months 30."""
    factor = F.when(unit == "anios", 365).when(unit == "meses", 30).when(unit == "dias", 1)
    return F.ceil(amount.cast("decimal(18,6)") * factor).cast("long")


def worst(severity: Column) -> Column:
    """A job's verdict from its findings' severities (an aggregate); nothing found is confiable."""
    rank = F.max(F.when(severity == "CRITICA", 3).when(severity == "ALERTA", 2).when(severity == "ADVERTENCIA", 1).otherwise(0))
    return F.when(rank == 3, "no_confiable").when(rank == 2, "revisar").otherwise("confiable")
