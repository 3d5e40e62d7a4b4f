"""Registered queries: importing the modules below fills the registry."""

from __future__ import annotations

import importlib

MODULES = ("basics", "timeseries", "joins", "aggregates", "evaluation", "matrices", "serving", "learning", "streams", "landing")


def load():
    from terrasig.plans import registry

    for m in MODULES:
        try:
            importlib.import_module(f"terrasig.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"terrasig.plans.{m}":
                raise
    return registry.QUERIES, registry.CHECKS
