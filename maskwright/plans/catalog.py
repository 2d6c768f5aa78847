"""Every registered query of the de-identification engine, with its SQL oracle."""

from __future__ import annotations

from . import detection, endtoend, governance, lifecycle, measures, service

_MODULES = (detection, endtoend, lifecycle, governance, measures, service)


def queries() -> dict:
    return {name: run for m in _MODULES for name, run, _ in m.QUERIES}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, _, sql in m.QUERIES if sql}
