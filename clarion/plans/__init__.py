"""Registered query plans: each module exposes ``REG`` (queries + oracle SQL)."""

from __future__ import annotations

import importlib

PLAN_MODULES = ["tabular", "raster", "clusters", "explain", "models", "stream"]


def registries():
    for name in PLAN_MODULES:
        yield importlib.import_module(f"clarion.plans.{name}").REG


def all_queries() -> dict:
    out = {}
    for reg in registries():
        out.update(reg.queries)
    return out


def all_oracles() -> dict:
    out = {}
    for reg in registries():
        out.update(reg.oracles)
    return out
