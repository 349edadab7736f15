"""Registered queries by subject; importing this package registers them all."""

import importlib

MODULES = ["ledger", "sources", "corpus", "evaluation", "layout", "casework", "sampling", "streams"]
for _name in MODULES:
    importlib.import_module(f"docketry.plans.{_name}")
