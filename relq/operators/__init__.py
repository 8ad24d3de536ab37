"""Query values and what can be done with them."""

from .query import Combined, CommonTable, Query, Raw, Recursive, combine

__all__ = ["Combined", "CommonTable", "Query", "Raw", "Recursive", "combine"]
