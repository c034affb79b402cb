"""Operators for building training corpora: one module per operator, plus the
thin queries that apply each of them to its whole table (see ``queries``)."""
