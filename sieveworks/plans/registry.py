"""All registered queries of the catalogue operators, with their SQL."""

from __future__ import annotations

from sieveworks.plans import auditing, changing, comparing, listening, matching, releasing, remembering, shopping, sounding, trying, voting

_MODULES = (listening, matching, voting, auditing, changing, sounding, releasing, remembering, trying, shopping, comparing)
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
