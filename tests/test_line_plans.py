"""Queries that fold each line once, however many of their steps read it."""

import pytest

from paperloom.functions.predicates import with_predicates
from paperloom.operators import fields

from .test_statements import lines, named


@pytest.mark.parametrize("module,name", [(fields, "jon10_safe_header")])
def test_lines_are_read_once(spark, module, name):
    rows = with_predicates(lines(spark, ("Acme Trading LLC", 40, 40)))
    plan = named(module, name)(lines=rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1
