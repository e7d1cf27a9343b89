"""The operators applied to the given tables."""

from importlib import import_module

MODULES = ("sensors", "context", "forecasts", "keyed", "documents", "geo", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
