"""Named query plans; importing the modules registers them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("relational", "aggregates", "changelog", "catalogue", "study", "quality", "streams", "sources", "library")


def _load():
    for name in MODULES:
        import_module(f"sparkloom.plans.{name}")
    return import_module("sparkloom.plans.registry")


def queries() -> dict:
    return dict(_load().QUERIES)


def oracles() -> dict:
    return dict(_load().ORACLES)
