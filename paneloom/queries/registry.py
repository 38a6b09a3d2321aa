"""All queries of the core, by name."""

from __future__ import annotations

from . import analytics, extended, factors, language, problem_sql, problems, relational, research, statistics, streams

MODULES = (factors, language, relational, statistics, analytics, streams, extended, research)


def queries() -> dict:
    found = dict(problems.QUERIES)
    for m in MODULES:
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(problem_sql.SQL)
    for m in MODULES:
        found |= m.SQL
    return found
