"""The registered queries: every operator applied to the driver's tables."""

from . import (  # noqa: F401  (importing a module registers its queries)
    comparison,
    diagnosing,
    features,
    reporting,
    rewarding,
    sampling,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
