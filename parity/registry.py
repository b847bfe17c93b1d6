"""Imports every check module, in reading order."""

from importlib import import_module

from parity.common import ORACLES, QUERIES  # noqa: F401

MODULES = ("ingest", "staging", "marts", "panels", "causal", "design", "response", "media", "monitor", "solvers", "stream")
for _name in MODULES:
    try:
        import_module(f"parity.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"parity.{_name}":
            raise
