"""All registered document queries and their SQL; importing a module of queries registers them."""

from leafmill.plans import archives, overlays, queries, requests, structures

MODULES = (archives, overlays, queries, requests, structures)
QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL
