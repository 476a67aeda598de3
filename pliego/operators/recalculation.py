"""Recalculating declared figures: days and flags of periods, totals, scores, and the codes of what can't be recalculated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.functions.dates import hard_date, inclusive_days, month_edge

# The emergency's first and last day; days of a month and of a year.
COVID = ("2020-03-16", "2020-06-30")
MONTH, YEAR = 30, 365


def touches_covid(start: Column, end: Column) -> Column:
    """Whether a period has a day of the emergency, its first and last day included."""
    first, last = (F.lit(d).cast("date") for d in COVID)
    return (start <= last) & (end >= first)


def date_code(text: Column) -> Column:
    """Why a date can't be used: missing, still to be verified, or only part of one; null where it can."""
    t = F.upper(F.trim(text))
    return F.when(hard_date(text).isNotNull(), None).when(t.isNull() | (t == ""), "SIN_FECHA").when(t.startswith("POR VERIFICAR"), "FECHA_CENTINELA").otherwise("FECHA_PARCIAL")


def fields(rows: DataFrame, start: str, end: str, licence: str, whole_months: bool = False) -> DataFrame:
    """The rows with dias, meses, anios, incluye_covid, anterior_colegiatura and the codes of what is missing.

    With `whole_months` a date that only gives its month is that month's edge, and `deduced` says so. A period
    that ends before it starts gives nothing. To begin on the day of the licence isn't to begin before it.
    """
    edge = month_edge if whole_months else lambda t, last: hard_date(t)
    a, b, c = edge(F.col(start), False), edge(F.col(end), True), hard_date(F.col(licence))
    dated = rows.withColumns({"_a": a, "_b": b, "_c": c})
    code = F.when(F.col("_a").isNull(), date_code(F.col(start))).when(F.col("_b").isNull(), date_code(F.col(end))).when(F.col("_b") < F.col("_a"), "PERIODO_INVERTIDO")
    dated = dated.withColumn("motivo", code)
    good = F.col("motivo").isNull()
    days = F.when(good, inclusive_days(F.col("_a"), F.col("_b")))
    inverted = F.coalesce(F.col("motivo") == "PERIODO_INVERTIDO", F.lit(False))
    early_code = F.when(F.col("_a").isNull() | inverted, F.col("motivo")).when(F.col("_c").isNull(), F.when(F.trim(F.coalesce(F.col(licence), F.lit(""))) == "", "SIN_COLEGIATURA").otherwise(date_code(F.col(licence))))
    return dated.withColumns(
        {
            "dias": days.cast("long"),
            "meses": F.bround(days / MONTH, 2),
            "anios": F.bround(days / YEAR, 2),
            "incluye_covid": F.when(good, F.when(touches_covid(F.col("_a"), F.col("_b")), "SI").otherwise("NO")),
            "anterior_colegiatura": F.when(early_code.isNull(), F.when(F.col("_a") < F.col("_c"), "SI").otherwise("NO")),
            "motivo_colegiatura": early_code,
            "deduced": F.when(good, hard_date(F.col(start)).isNull() | hard_date(F.col(end)).isNull()),
        }
    ).drop("_a", "_b", "_c")


def discrepancy(declared: Column, found: Column, tolerance: int = 1) -> Column:
    """DIAS_DISCREPANTE where both are known and over `tolerance` apart, SIN_DIAS where neither is."""
    return F.when(F.abs(declared - found) > tolerance, "DIAS_DISCREPANTE").when(declared.isNull() & found.isNull(), "SIN_DIAS")


def totals(rows: DataFrame, key: str, days: str, declared: str) -> DataFrame:
    """Totals by key: (key, n, total, motivo, cuadra). A total needs every addend; else it is null and TOTAL_INCOMPLETO.

    cuadra: the declared total is within one day for each addend; null where either is unknown.
    """
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(days), F.lit(0)) == 0).alias("missing"), F.sum(days).alias("sum"), F.max(declared).alias("declared"))
    total = F.when(F.col("missing") == 0, F.col("sum"))
    return found.select(key, "n", total.alias("total"), F.when(F.col("missing") > 0, "TOTAL_INCOMPLETO").alias("motivo"), (F.abs(F.col("declared") - total) <= F.col("n")).alias("cuadra"))


def score_bounds(factors: DataFrame, key: str, score: str, least: str, most: str, conditional: str, applies: str) -> DataFrame:
    """Bounds of scores by key: (key, minimo, maximo, estado, total).

    A factor's bounds are its confirmed and its largest possible score, else its score; a known upper bound alone has 0
    below it. A bound that nobody knows leaves maximo null. Without a condition the score is final, and total is it.
    """
    low, high = F.coalesce(F.col(least), F.col(score)), F.coalesce(F.col(most), F.col(score))
    low = F.when(low.isNull() & high.isNotNull(), F.lit(0.0)).otherwise(low)
    used = factors.where(F.coalesce(F.col(applies), F.lit(True))).select(key, low.alias("low"), high.alias("high"), (F.col(score).isNull() | F.col(conditional) | low.isNull() | high.isNull()).alias("open"))
    everything = factors.select(key).distinct()
    sums = used.groupBy(key).agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.bool_or(F.col("low").isNull() | F.col("high").isNull()).alias("unbounded"), F.bool_or("open").alias("open"))
    out = everything.join(sums, key, "left")
    low, high, open_ = F.round(F.coalesce("low", F.lit(0.0)), 6), F.round(F.coalesce("high", F.lit(0.0)), 6), F.coalesce("open", F.lit(False))
    return out.select(key, low.alias("minimo"), F.when(~F.coalesce("unbounded", F.lit(False)), high).alias("maximo"), F.when(open_, "condicionado").otherwise("definitivo").alias("estado"), F.when(~open_, low).alias("total"))


def plausible(day: Column, number_year: Column, contract: Column, today: Column) -> Column:
    """Why a resolution's date can't be right, null if it can: its number's year (December before and January after count), the contract, today, 2000."""
    year_ok = number_year.isNull() | (F.year(day) == number_year) | ((F.year(day) == number_year - 1) & (F.month(day) == 12)) | ((F.year(day) == number_year + 1) & (F.month(day) == 1))
    return F.when(day.isNull(), "SIN_FECHA").when(~year_ok, "ANIO").when(day < contract, "CONTRATO").when(day > today, "FUTURA").when(F.year(day) < 2000, "RANGO")


def validity(issued: Column, expires: Column, offer: Column) -> Column:
    """A certificate on the day of the offer: vigente, vencido, or por_verificar where dates are missing or it was issued later."""
    return F.when(offer.isNull() | expires.isNull() | F.coalesce(issued > offer, F.lit(False)), "por_verificar").when(expires < offer, "vencido").otherwise("vigente")


def documents(required: Column, present: Column, complete: Column) -> Column:
    """A required document that is missing is NO_CUMPLE only if the extraction was complete, else it is to be looked at."""
    missing = required & ~F.coalesce(present, F.lit(False))
    return F.when(missing & F.coalesce(complete, F.lit(False)), "NO_CUMPLE").when(missing, "REVISION_MANUAL").otherwise("CUMPLE")
