"""DataFrame operators: projections, filters, lookups, statistics, ranking, line-ups, models."""
