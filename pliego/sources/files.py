"""Readers of files whose columns, versions or documents have to be checked before use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class MissingColumns(ValueError):
    """Required columns that no alias of the input gives."""


def aliased(rows: DataFrame, aliases: dict[str, list[str]], required: set[str] = frozenset()) -> DataFrame:
    """Columns under their logical names: for each the first alias that is present, whatever its case.

    Optional columns without an alias are null strings. Columns with no logical name are left out.
    Raises MissingColumns before any row is read if a required one is absent.
    """
    present: dict[str, str] = {}
    for c in rows.columns:
        present.setdefault(c.strip().lstrip("\ufeff").lower(), c)
    chosen = {name: next((present[a.lower()] for a in [name, *others] if a.lower() in present), None) for name, others in aliases.items()}
    absent = sorted(name for name in required if chosen.get(name) is None)
    if absent:
        raise MissingColumns(", ".join(absent))
    return rows.select(*[(F.col(f"`{c}`") if c is not None else F.lit(None).cast("string")).alias(name) for name, c in chosen.items()])


def tagged_csv(spark: SparkSession, files: dict[str, str], aliases: dict[str, list[str]], required: set[str] = frozenset()) -> DataFrame:
    """Rows of several CSV files (gzip too), each with its file's tag and name; all values are strings.

    The header of each file is checked by itself, so a file without a required column stops the load.
    """
    parts = []
    for tag, path in files.items():
        read = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
        named = read.select("*", F.col("_metadata.file_name").alias("source_file"))
        parts.append(aliased(named, aliases | {"source_file": []}, required).withColumn("tag", F.lit(tag)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def json_documents(rows: DataFrame, column: str, schema: StructType, required: list[str]) -> DataFrame:
    """Each document with its parsed value and what is wrong with it: a list of paths, empty if it is valid.

    A text that isn't JSON is wrong as a whole ("$"); a null text too. A required path that is absent,
    null or of another type is listed.
    """
    whole = StructType([*schema.fields]).add("_corrupt", "string")
    parsed = F.from_json(F.col(column), whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = rows.withColumn("document", parsed)
    broken = F.col("document").isNull() | F.col("document._corrupt").isNotNull()
    absent = F.filter(F.array(*[F.when(F.col(f"document.{p}").isNull(), F.lit(f"$.{p}")) for p in required]), lambda x: x.isNotNull())
    errors = F.when(broken, F.array(F.lit("$"))).otherwise(absent.cast("array<string>"))
    return read.withColumns({"errors": errors, "document": F.col("document").dropFields("_corrupt")})


def contract_errors(document: Column, enums: dict[str, list[str]], ranges: dict[str, tuple[float, float]], most: int = 30) -> Column:
    """The first `most` faults of a parsed document, as `$.path: reason`: values outside a list, numbers outside a range. Nulls are no faults."""
    field = lambda path: reduce(Column.getField, path.split("."), document)
    rules = [F.when(~field(p).isin(*values), F.lit(f"$.{p}: not in list")) for p, values in enums.items()]
    rules += [F.when(~field(p).between(low, high), F.lit(f"$.{p}: out of range")) for p, (low, high) in ranges.items()]
    return F.slice(F.array_compact(F.array(*rules)), 1, most)


def tri_state(answers: Column, failed: Column) -> Column:
    """no_answer if the source failed or gave null, none if it gave an empty list, found otherwise."""
    return F.when(failed | answers.isNull(), "no_answer").when(F.size(answers) == 0, "none").otherwise("found")


def script_arrays(html: Column, name: str) -> Column:
    """The items of the first `var name = [ ... ];` of a page, as an array of JSON texts; null if it is absent or not JSON."""
    body = F.regexp_extract(html, rf"(?s)var\s+{name}\s*=\s*(\[.*?\])\s*;", 1)
    return F.from_json(F.nullif(body, F.lit("")), "array<string>")


def table_cells(html: Column) -> Column:
    """For each table row of a page its cells' texts: tags out, blanks joined. Rows without cells are left out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1))
    plain = F.transform(cells, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))))
    return F.filter(plain, lambda r: F.size(r) > 0)


def keyed_paths(files: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Rows of a binaryFile scan with the numbers that their file names hold; names that don't match are left out."""
    found = [F.regexp_extract("path", pattern, i + 1).cast("int").alias(n) for i, n in enumerate(names)]
    return files.where(F.col("path").rlike(pattern)).select("*", *found)
