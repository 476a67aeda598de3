"""Every query of the library by name, with the SQL that it must agree with."""

from pliego.plans import choices, details, entity_names, evidences, features, identities, loads, periods, phrasing, recalculated, resolving, searching, texts  # noqa: F401
from pliego.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
