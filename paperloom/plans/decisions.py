"""Queries over runs, fields, proposals: gates, codes, labels, reports."""

from __future__ import annotations

from ..operators import quality, reports
from .bind import bind

SOURCES = {"runs": "runs", "fields": "field_rows", "proposals": "proposals", "items": "items_full", "manifest": "invoices", "attempts": "attempts"}

for _statement in (*quality.STATEMENTS, *reports.STATEMENTS):
    bind(_statement, **{n: SOURCES[n] for n in _statement.inputs})
