"""All core queries and their SQL."""

from wavemill.plans import data_checks, engine, engine_sql, stored

QUERIES = engine.QUERIES | stored.QUERIES | data_checks.QUERIES
SQL = engine_sql.SQL | stored.SQL | data_checks.SQL
