"""Query values to Spark plans."""

from .compiler import compile_query

__all__ = ["compile_query"]
