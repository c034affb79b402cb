"""Queries over parties, geometry, tables and payloads."""

from __future__ import annotations

from ..operators import layout, parties, payloads
from .bind import CLASSIFIED, bind

SOURCES = {"lines": CLASSIFIED, "cells": "ocr_lines", "items": "items_full", "rows": "strategy_rows", "runs": "runs", "fields": "field_rows", "proposals": "proposals", "candidates": "candidates"}

for _statement in (*parties.STATEMENTS, *layout.STATEMENTS, *payloads.STATEMENTS):
    bind(_statement, **{n: SOURCES[n] for n in _statement.inputs})
