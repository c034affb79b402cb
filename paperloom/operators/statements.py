"""Operators that are one SQL statement over named inputs.

``$name`` stands for an input table; the text uses the macros of
``functions.dialect``. Called with DataFrames, a statement gives a DataFrame,
so Catalyst plans it together with what comes before and after.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.dialect import duck, spark, split_methods


class Statement:
    """A named operator."""

    def __init__(self, name: str, about: str, sql: str, plan: str = ""):
        """``plan`` is what Spark runs instead where the same rows come from a
        better order of steps."""
        self.name, self.about, self.sql, self.plan = name, about, sql.strip(), plan.strip() or sql.strip()
        self.inputs = sorted(set(re.findall(r"\$([a-z_]+)", sql)))

    def __call__(self, **tables: DataFrame) -> DataFrame:
        if sorted(tables) != self.inputs:
            raise TypeError(f"{self.name} takes {', '.join(self.inputs)}")
        text = spark(self.plan).replace("{", "{{").replace("}", "}}")
        text = re.sub(r"\$([a-z_]+)", r"{\1}", text)
        session = next(iter(tables.values())).sparkSession
        split_methods(session)
        return session.sql(text, **tables)

    def duck(self) -> str:
        """The same statement for DuckDB, inputs as ``in_name``."""
        return re.sub(r"\$([a-z_]+)", r"in_\1", duck(self.sql))


def rate(condition: str) -> str:
    """Share of rows for which a condition holds, nulls left out, four digits."""
    return f"round(avg(case when {condition} then 1.0e0 when not ({condition}) then 0.0e0 end), 4)"


def shared(part: str, whole: str) -> str:
    """A ratio at four digits; null over nothing."""
    return f"round(cast({part} as double) / nullif(cast({whole} as double), 0), 4)"
