"""Reusable DataFrame operators: latest per key, intervals, as-of joins, ranks, nesting."""
