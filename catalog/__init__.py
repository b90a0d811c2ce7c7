"""Query catalogue: binds the given tables to the library's operators."""

import importlib
import pkgutil


def load():
    """Import every ``sec_*`` module so that it registers its queries."""
    from catalog import registry
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        if m.startswith("sec_"):
            importlib.import_module(f"catalog.{m}")
    return registry
