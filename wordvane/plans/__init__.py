"""Queries, by theme. modules() imports them all, so that they register themselves."""

from __future__ import annotations

import importlib

THEMES = ("dialogue", "tables", "measures", "procedural", "keypoints", "inference", "durability", "internals", "contracts", "selection")


def modules() -> list:
    return [importlib.import_module(f"wordvane.plans.{t}") for t in THEMES]
