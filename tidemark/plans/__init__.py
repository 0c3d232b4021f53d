"""All queries by name, and the SQL that checks them."""

from . import catalog, operations

QUERIES = catalog.QUERIES | operations.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | operations.ORACLE_SQL
