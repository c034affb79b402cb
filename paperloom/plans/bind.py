"""Binds statements to fixture views: a query and, from the same text, its SQL."""

from __future__ import annotations

from ..functions.predicates import STAGES, predicate_sql, with_predicates
from ..operators.statements import Statement
from .fixtures import VIEWS, load, with_views
from .registry import QUERIES, SQL


#: The lines with all predicates, as a source.
LINES, CLASSIFIED = "lines", "classified"


def source(spark, sf_dir: str, name: str):
    return with_predicates(load(spark, sf_dir, LINES)) if name == CLASSIFIED else load(spark, sf_dir, name)


def bind(statement: Statement, **sources: str) -> None:
    """Register ``statement``; a source names a view or table of its input."""

    def run(spark, sf_dir):
        return statement(**{n: source(spark, sf_dir, s) for n, s in sources.items()})

    run.__name__, run.__doc__ = statement.name, statement.about
    QUERIES[statement.name] = run
    views = [LINES if s == CLASSIFIED else s for s in sources.values() if s in (*VIEWS, CLASSIFIED)]
    inputs = [f"{predicate_sql(LINES)}, {CLASSIFIED} as (select * from p{len(STAGES) - 1})"] if CLASSIFIED in sources.values() else []
    inputs += [f"in_{n} as (select * from {s})" for n, s in sources.items()]
    head = (with_views(*views) + ", " if views else "with ") + ", ".join(inputs)
    SQL[statement.name] = f"{head}, result as ({statement.duck()}) select * from result"

