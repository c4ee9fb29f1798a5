"""Registered queries over the supplied tables, each with its SQL check where SQL can say it."""

import importlib

from searchloom.plans.registry import ORACLES, QUERIES


MODULES = ("source", "gate", "compare", "review", "experiment", "ledger", "page", "rule", "assertion", "tagging", "planning", "stream")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"searchloom.plans.{name}_queries")


__all__ = ["ORACLES", "QUERIES", "load_all"]
