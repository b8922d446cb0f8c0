"""Registered queries, one module per area."""

import importlib
import pkgutil

from cohortia.queries.registry import ORACLES, QUERIES


def load_all():
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        if m.startswith("q_"):
            importlib.import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
