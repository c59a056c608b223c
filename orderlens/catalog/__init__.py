"""Every registered query over the driver tables, with its reference SQL."""

from . import base_sql  # noqa: F401
from .registry import ORACLES, QUERIES, complete

_GROUPS = ("cleaning", "customers", "products", "behaviour", "pairs", "signals", "serving",
           "dashboards", "profiling", "quality", "state", "live")


def _load() -> None:
    import importlib
    import importlib.util
    for group in _GROUPS:
        if importlib.util.find_spec(f"{__name__}.{group}"):
            importlib.import_module(f"{__name__}.{group}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return {name: complete(sql) for name, sql in ORACLES.items()}
