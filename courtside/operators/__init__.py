"""Reusable DataFrame operators: ordered passes, ranks, range joins, reshaping, statistics."""
