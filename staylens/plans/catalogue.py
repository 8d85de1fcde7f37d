"""All registered queries."""

from staylens.plans import (  # noqa: F401
    booking_queries,
    content_queries,
    growing_queries,
    rating_queries,
    value_queries,
)
from staylens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
