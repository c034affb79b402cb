"""Queries over recognized lines and field candidates."""

from __future__ import annotations

from ..operators import fields
from .bind import CLASSIFIED, bind

SOURCES = {"lines": CLASSIFIED, "candidates": "candidates", "proposals": "proposals", "runs": "runs", "customers": "customer"}

#: Its generated code is too large to compile, so it is slow over whole tables;
#: tests run it on a small input.
SLOW = ("ext02_line_candidates",)

for _statement in fields.STATEMENTS:
    if _statement.name not in SLOW:
        bind(_statement, **{n: SOURCES[n] for n in _statement.inputs})
