"""All queries over the driver's tables and their SQL."""

from . import extended, mechanisms, reference

QUERIES, ORACLE_SQL = reference.QUERIES, reference.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "extended", "mechanisms", "reference"]
