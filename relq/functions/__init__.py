"""Expressions: predicates, arithmetic, aggregates, windows, subqueries."""

from .expr import Expr, Window, dense_rank, fragment, lag, lead, literal, now, percentile, rank, row_number, scalar, scalar_count, scalar_first

__all__ = ["Expr", "Window", "dense_rank", "fragment", "lag", "lead", "literal", "now", "percentile", "rank", "row_number", "scalar", "scalar_count", "scalar_first"]
