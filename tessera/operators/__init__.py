"""The relational verbs as functions of DataFrames."""

from .relational import aggregate, filter_rows, join, project

__all__ = ["aggregate", "filter_rows", "join", "project"]
