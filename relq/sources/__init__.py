"""Declared entities, where their rows are, and a versioned store that can be written."""

from .entity import Catalog, Columns, Entity, Field, belongs_to, has_many, has_one

__all__ = ["Catalog", "Columns", "Entity", "Field", "belongs_to", "has_many", "has_one"]
