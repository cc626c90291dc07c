"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("formatting", "repeated_lines", "batches", "tokens", "encodings", "residue", "truncation", "mainbody", "packing")


def _modules():
    return [import_module(f"marlspike.llm.{name}") for name in MODULES]


def queries() -> dict:
    return {name: f for module in _modules() for name, f in vars(module).items() if name[0] == "p" and name[1].isdigit() and callable(f)}


def oracles() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
