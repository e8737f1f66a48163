"""DataFrame operators: joins and aggregates, windows, global ranks, profiles, curves, models."""
