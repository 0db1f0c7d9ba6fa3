"""Every operator bound to the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("foundation", "drift", "rules", "history", "perturbation", "learning", "streams")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), attribute))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
