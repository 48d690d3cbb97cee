"""SQL twins of the registered queries, for an independent SQL engine."""

from __future__ import annotations

SQL: dict[str, str] = {}

from tallywatt.catalog import run_oracle, telemetry_oracle  # noqa: E402

SQL.update(telemetry_oracle.SQL)
SQL.update(run_oracle.SQL)
