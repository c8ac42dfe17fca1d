"""All queries of the library, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import oracles, queries, queries_logs, queries_rules

QUERIES = queries.QUERIES | queries_logs.QUERIES | queries_rules.QUERIES
ORACLES = oracles.ORACLES | queries_logs.ORACLES | queries_rules.ORACLES
