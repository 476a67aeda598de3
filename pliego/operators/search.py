"""Search of a catalogue by code or by name, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.functions.text import clean, norm

# Words of names that don't tell them apart.
STOP = (
    "DE", "DEL", "LA", "LAS", "EL", "LOS", "Y", "EN", "A", "CON", "PARA", "POR", "DISTRITO", "PROVINCIA", "DEPARTAMENTO", "REGION", "LOCALIDAD", "CENTRO", "POBLADO", "SALUD", "PUESTO", "EDUCATIVA",
    "INSTITUCION", "IE", "I", "E", "N", "NO", "S", "SERVICIO", "SERVICIOS", "MEJORAMIENTO", "AMPLIACION", "CONSTRUCCION", "CREACION", "RECUPERACION", "INSTALACION",
)


def tokens(text: Column) -> Column:
    """Distinct words of three letters or more that tell names apart."""
    return F.filter(F.array_distinct(F.regexp_extract_all(norm(text), F.lit("[A-Z0-9]+"), F.lit(0))), lambda w: (F.length(w) > 2) & ~w.isin(*STOP))


def valid_query(text: Column, limit: int) -> Column:
    """The trimmed text of a query, an error where it has under 2 or over 200 characters; a limit is from 1 to 50."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be from 1 to 50")
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t).between(2, 200), t).otherwise(F.raise_error(F.lit("a query has 2 to 200 characters")))


def refused(asked: DataFrame, q: str) -> DataFrame:
    """Queries that `search` doesn't answer, and why: (q, reason), reason one of short, long and common (no word that tells names apart)."""
    t = F.trim(F.coalesce(F.col("text"), F.lit("")))
    reason = F.when(F.length(t) < 2, "short").when(F.length(t) > 200, "long").when(~t.rlike(r"^\d+$") & (F.size(tokens(t)) == 0), "common")
    return asked.select(q, reason.alias("reason")).where("reason is not null")


def passes(filters: list[str], asked: str = "asked_") -> Column:
    """All filters that are given (columns `asked_<name>`) are contained in the fields of those names, in whatever case and marks."""
    out = F.lit(True)
    for name in filters:
        wanted = F.col(f"{asked}{name}")
        out = out & (wanted.isNull() | (F.trim(wanted) == "") | F.contains(norm(F.coalesce(F.col(name), F.lit(""))), norm(wanted)))
    return out


def _passing(filters: list[str]) -> Column:
    """`passes`, of fields and wishes that were normed (`field_<name>`, `wish_<name>`) once a row, not once a pair; no wish is null."""
    out = F.lit(True)
    for name in filters:
        out = out & (F.col(f"wish_{name}").isNull() | F.contains(F.col(f"field_{name}"), F.col(f"wish_{name}")))
    return out


def candidates(asked: DataFrame, catalogue: DataFrame, q: str, id_: str, first: int = 6, places: int = 20_000, enough: int = 60_000) -> DataFrame:
    """Candidates of each query (q, text) in a catalogue (id, name): (q, id, token), token: the number of the word that found it.

    A query's words are taken from the rarest on (ties by the word), the `first` of them; words with over `places`
    places are left out; no further word is taken once there are over `enough` candidates. So a query meets
    `first * places` rows at most, whatever the catalogue: words are dropped before they meet any row.
    """
    listed = catalogue.select(id_, F.explode(tokens(F.col("name"))).alias("w"))
    known = listed.groupBy("w").agg(F.count("*").alias("places"))
    words = asked.select(q, F.explode(tokens(F.col("text"))).alias("w")).join(known, "w")
    ranked = words.withColumn("token", F.row_number().over(Window.partitionBy(q).orderBy("places", "w")).cast("long")).where((F.col("token") <= first) & (F.col("places") <= places))
    found = ranked.select(q, "w", "token").join(listed, "w").groupBy(q, id_).agg(F.min("token").alias("token"))
    counts = found.groupBy(q, "token").agg(F.count("*").alias("new"))
    before = counts.withColumn("before", F.sum("new").over(Window.partitionBy(q).orderBy("token")) - F.col("new")).where(F.col("before") <= enough)
    return found.join(before.select(q, "token"), [q, "token"]).select(q, id_, "token")


def keyed(catalogue: DataFrame, code: str, second: str | None) -> DataFrame:
    """Rows of a catalogue with the code that finds them (`key_`): their own, and their second one where it is no row's own."""
    own = catalogue.withColumn("key_", F.col(code))
    if second is None:
        return own
    others = catalogue.withColumn("key_", F.col(second)).where("key_ <> ''")
    return own.unionByName(others.join(own.select("key_").distinct(), "key_", "left_anti"))


def by_code(asked: DataFrame, catalogue: DataFrame, q: str, id_: str, code: str, filters: list[str], second: str | None = None) -> DataFrame:
    """Queries of digits that are the code of a row which passes the filters, or, if no row has that code, its second code: (q, id)."""
    digits = asked.where(F.trim("text").rlike(r"^\d+$")).withColumnsRenamed({f: f"asked_{f}" for f in filters})
    return digits.join(keyed(catalogue, code, second), F.trim("text") == F.col("key_")).where(passes(filters)).select(q, id_)


def search(asked: DataFrame, catalogue: DataFrame, q: str, id_: str, code: str, filters: list[str], limit: int, score, least: float = 60.0, second: str | None = None) -> DataFrame:
    """(q, id, score, rank_, via) of the best rows for each query (q, text, filters): by code (or `second` code) where it is one, else by name.

    Queries that are null, short or long have no rows here; `refused` tells them. Letters and digits of names
    are scored by `score(text, name)`. Filters apply to the best min(500, max(10 * limit, 50)) of them; of what
    passes the best `limit` stay, ties by code, those without one last, and then by id.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be from 1 to 50")
    trimmed = F.trim(F.coalesce(F.col("text"), F.lit("")))
    asked = asked.withColumn("text", trimmed).where(F.length("text").between(2, 200))
    codes = asked.select(q, F.trim("text").alias("c")).join(keyed(catalogue, code, second).select(F.col("key_").alias("c")).distinct(), "c", "left_semi").where(F.col("c").rlike(r"^\d+$"))
    exact = by_code(asked, catalogue, q, id_, code, filters, second).select(q, id_, F.lit(100.0).alias("score"), F.lit(1).cast("long").alias("rank_"), F.lit("codigo").alias("via"))
    named = asked.join(codes.select(q), q, "left_anti")
    pairs = candidates(named.select(q, "text"), catalogue.select(id_, "name"), q, id_).select(q, id_)
    # what hangs on one side only is worked out before rows meet, and pairs stay narrow
    wishes = [F.when(F.trim(f) != "", norm(F.col(f))).alias(f"wish_{f}") for f in filters]
    fields = [norm(F.coalesce(F.col(f), F.lit(""))).alias(f"field_{f}") for f in filters]
    whole = pairs.join(named.select(q, clean(F.col("text")).alias("said_"), *wishes), q).join(catalogue.select(id_, code, clean(F.col("name")).alias("known_"), *fields), id_)
    rated = whole.select(q, id_, code, score(F.col("said_"), F.col("known_")).alias("score"), _passing(filters).alias("passes_")).where(F.col("score") >= least)
    order = [F.desc("score"), F.coalesce(F.col(code), F.lit("~")), F.col(id_)]
    place = lambda: F.row_number().over(Window.partitionBy(q).orderBy(*order)).cast("long")
    near = rated.withColumn("n", place()).where(F.col("n") <= min(500, max(10 * limit, 50)))
    best = near.where("passes_").withColumn("rank_", place()).where(F.col("rank_") <= limit)
    return exact.unionByName(best.select(q, id_, F.round("score", 1).alias("score"), "rank_", F.lit("nombre").alias("via")))
