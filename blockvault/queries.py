"""All registered queries of the engine; importing the plans registers them."""

from __future__ import annotations

from . import registry
from .plans import catalog, chunks, codecs, content, intervals, names, store, trees, verification  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
