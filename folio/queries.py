"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans
from .plans.registry import QUERIES, SQL

for _m in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"{plans.__name__}.{_m.name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
