"""Named queries: one for each operator, with SQL that says the same."""

from __future__ import annotations

from . import host, parity, replication


def queries() -> dict:
    return replication.QUERIES | parity.queries() | host.QUERIES


def oracle_sql() -> dict[str, str]:
    return replication.ORACLES | parity.oracle_sql() | host.ORACLES
