"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "register_plans",
    "reaction_plans",
    "coverage_plans",
    "wording_plans",
    "capture_plans",
    "scan_plans",
    "report_plans",
    "audit_plans",
    "stream_plans",
)

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = import_module(f"recordlens.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
