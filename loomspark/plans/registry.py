"""All registered queries of the library's own operators with their DuckDB equivalents."""

from loomspark.plans import knowledge, relational, service

QUERIES: dict = {**relational.QUERIES, **knowledge.QUERIES, **service.QUERIES}
ORACLE_SQL: dict[str, str] = {**relational.ORACLE_SQL, **knowledge.ORACLE_SQL, **service.ORACLE_SQL}
