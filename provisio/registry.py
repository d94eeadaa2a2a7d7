"""Every query by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, and SQL for the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


from provisio.plans import agreement, analysis, approval, calibration, catalog, evidence, exposure, features, forecast, gates, handoff, inventory, items, landing, ledger, names, news, panels, resolution, risk, runreport, selection, signals, sources, training  # noqa: E402, F401
