"""All named queries."""

from importlib import import_module
from pkgutil import iter_modules

from doseweave.catalog.registry import QUERIES, SQL

for _module in sorted(m.name for m in iter_modules(__path__)):
    import_module(f"{__name__}.{_module}")

__all__ = ["QUERIES", "SQL"]
