"""Registered queries: each pairs operators with a comparison statement."""

from __future__ import annotations

import importlib
import importlib.util

MODULES = (
    "scans", "validation", "joining", "graphs", "evaluation", "evidence", "sequences", "selection",
    "samples", "spectra", "signals", "streams", "extensions",
)


def load_all() -> None:
    """Import every query module once."""
    for name in MODULES:
        if importlib.util.find_spec(f"wavelane.plans.{name}"):
            importlib.import_module(f"wavelane.plans.{name}")
