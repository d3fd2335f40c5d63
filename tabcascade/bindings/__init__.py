"""The operators bound to the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from tabcascade.bindings import (
    aggregate,
    clean,
    inference,
    learn,
    planted,
    prepare,
    relational,
    sampling,
    scores,
    sources,
)
from tabcascade.bindings.base import REGISTRY

__all__ = ["REGISTRY", "aggregate", "clean", "inference", "learn", "planted", "prepare", "relational", "sampling", "scores", "sources"]
