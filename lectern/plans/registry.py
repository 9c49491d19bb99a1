"""All queries of the library's own operators, by name, with the SQL that checks them."""

from __future__ import annotations

from . import drawn_queries, record_queries, text_queries

QUERIES = {**text_queries.QUERIES, **record_queries.QUERIES, **drawn_queries.QUERIES}
ORACLE_SQL = {**text_queries.ORACLE_SQL, **record_queries.ORACLE_SQL, **drawn_queries.ORACLE_SQL}
FLAGSHIP = text_queries.sections
