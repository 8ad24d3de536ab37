"""Rows of one query, read lazily."""

from .rows import RowStream

__all__ = ["RowStream"]
