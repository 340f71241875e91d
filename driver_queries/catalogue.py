"""All registered queries."""

from driver_queries import (  # noqa: F401
    display_queries,
    feature_queries,
    file_queries,
    fixture_queries,
    lineup_queries,
    lookup_queries,
    model_queries,
    read_queries,
    stats_queries,
)
from driver_queries.registry import ORACLES, QUERIES  # noqa: F401
