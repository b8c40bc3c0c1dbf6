"""Imports every binding module so the registry is complete."""

from __future__ import annotations

import importlib

MODULES = ["bind_agg", "bind_derive", "bind_profile", "bind_stats", "bind_prep",
           "bind_metrics", "bind_models", "bind_explain", "bind_sources"]


def load_all() -> None:
    for m in MODULES:
        try:
            importlib.import_module(f"scorelens.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"scorelens.plans.{m}":
                raise
