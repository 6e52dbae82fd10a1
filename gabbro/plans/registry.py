"""All query keys of the reference's operators, with their DuckDB oracles."""

from __future__ import annotations

from gabbro.plans import catalog, expressions, gold, platform, records, scale, star

QUERIES: dict = gold.QUERIES | platform.QUERIES | star.QUERIES | expressions.QUERIES | catalog.QUERIES | records.QUERIES | scale.QUERIES
ORACLE_SQL: dict = gold.ORACLE_SQL | platform.ORACLE_SQL | star.ORACLE_SQL | expressions.ORACLE_SQL | catalog.ORACLE_SQL | records.ORACLE_SQL | scale.ORACLE_SQL
