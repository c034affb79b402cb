"""Registered queries and their SQL counterparts."""

from . import analytics, business, decisions, fields, layout, lines, reviews, scalars, streams, texts
from .registry import FLAGSHIP, QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "analytics", "business", "decisions", "fields", "layout", "lines", "reviews", "scalars", "streams", "texts"]
